"""SentencePiece pieces: n-best segmentation, encoding and exact decoding.

The vocabulary is a public SentencePiece model, read as it is. A text is "▁" and the text with "▁" for each blank. Its lattice has an edge for
each piece found in it, with the score of the model's file where that is a log probability (unigram models). The scores in the file of a
merge model are ranks (0, -1, -2, ...) and no probabilities: a sum of them says nothing on a segmentation. There a piece's log
probability follows from its rank by Zipf's law, score = -log(rank + ZIPF). A character that no piece covers is an edge of its UTF-8
byte pieces, each with the least score less BYTE_PENALTY. A "▁" that is in the text itself goes by its bytes, and no normaliser is
applied, so that decoding gives every text back exactly. Scores are multiples of 2 ** -16: sums are exact, and ties are ties.

Segmentation: a forward Viterbi pass gives each position's best score (and its second, for the gap). Those scores are exact heuristics
for a backward A* search from the end: hypotheses leave the queue in the order of their complete scores, of equal ones the nearest to
the start first, so the first n that reach the start are the n best, and ties are not searched in breadth.

Pieces never cross some borders: where no piece holds two neighbouring characters, the lattice falls apart. It is searched in such
segments, each once in a worker's cache. The n best of a text come from its segments: only the n - 1 segments with the
smallest gaps between best and second can differ from their best, and those are combined by another best-first search.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import re
import string
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, kept, slices
from .tokenizer import load
from .words import U

N_BEST = 4
#: Bytes of text that are encoded before their rows are passed on.
SLICE_BYTES = 1 << 20
ZIPF, BYTE_PENALTY = 2.7, 10.0
BLANK = "▁"
#: Stands for a BLANK that is in the text: a lone surrogate, which no text holds.
_LITERAL = "\ud800"
#: Entries of a generation of a worker's caches, bytes of one entry on average at most, and characters of the longest word that is kept there.
CACHE, ENTRY_BYTES, CACHED = 60_000, 400, 256
#: Characters of the longest segment that is worked out together with others; the base of hashes of characters.
BATCHED, _BASE = 64, 0x9E3779B97F4A7C15
#: Characters of a segment from which on Viterbi scores are kept in packed arrays.
LONG = 4_096


class Cache:
    """The latest entries and those before them: a full generation becomes the old one, and what is asked for again stays. Entries and bytes are bounded."""

    def __init__(self, most: int = CACHE):
        self.new, self.old, self.most, self.most_bytes, self.bytes = {}, {}, most, most * ENTRY_BYTES, 0

    def get(self, key: str):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value):
        if len(key) > CACHED:  # rare, and as large as texts can be
            return value
        self.bytes += 200 + 6 * len(key)
        if len(self.new) >= self.most or self.bytes > self.most_bytes:
            self.old, self.new, self.bytes = self.new, {}, 0
        self.new[key] = value
        return value


class Pieces:
    def __init__(self, source: bytes, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=source)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        bytes_ = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        try:
            model.nbest_encode_as_ids("a", 1)
            score = {i: float(model.get_score(i)) for i in normal}  # a unigram model: log probabilities
        except RuntimeError:
            score = {i: -float(np.log(r + ZIPF)) for r, i in enumerate(normal)}
        exact = lambda x: round(x * 65536) / 65536
        self.scores = {i: exact(x) for i, x in score.items()}
        self.byte_ids, self.byte_score = [bytes_[b] for b in range(256)], exact(min(score.values()) - BYTE_PENALTY)
        self.edges = {names[i]: ((i,), self.scores[i]) for i in normal}
        self.longest = max(map(len, self.edges))
        # tries, character by character, from a piece's front and from its back: nodes are (children, ids or None where it is only a prefix, score, length)
        self.trie, self.back = self._trie(lambda p: p), self._trie(lambda p: p[::-1])
        self.odd: dict[str, tuple] = {}  # nodes of characters that go by their bytes
        # the front trie as a sorted table: hash of a prefix -> id of the piece that it is, or -1
        nodes = {p[:n]: -1 for p in self.edges for n in range(1, len(p))} | {p: ids[0] for p, (ids, _) in self.edges.items()}
        hashes = np.array([self._hash(p) for p in nodes], U)
        order = np.argsort(hashes)
        self.nodes, self.node_ids = hashes[order], np.array(list(nodes.values()), np.int64)[order]
        self.score_of = np.zeros(n)
        self.score_of[normal] = [self.scores[i] for i in normal]
        self.single = np.array(sorted(ord(p) for p in self.edges if len(p) == 1), np.uint32)
        self.inner = {p[i : i + 2] for p in self.edges for i in range(len(p) - 1)}
        self.raw = [b""] * n  # what decoding an id gives
        for i in normal:
            self.raw[i] = names[i].replace(BLANK, " ").encode()
        for b, i in bytes_.items():
            self.raw[i] = bytes([b])
        # a word: blanks and what follows up to the next blank, line end or border between marks (ASCII punctuation that no
        # piece holds next to a letter) and letters. Where pieces have a blank after something else, it is the whole text.
        ascii_, pairs = set(string.punctuation), [p for p in self.inner if p[0] != BLANK]
        glue = {c for p in pairs if (p[0] in ascii_) != (p[1] in ascii_) for c in p} & ascii_
        k, g = (re.escape("".join(sorted(x))) for x in (ascii_ - glue, glue))
        run = f"(?:[^{BLANK}\n{k}{g}]+" + (f"|[{k}]+)" if k else ")")
        if any(p[1] == BLANK or "\n" in p for p in pairs):
            self.words = re.compile("(?s).+")
        elif g:
            self.words = re.compile(f"{BLANK}*{run}(?:[{g}]+{run}?)*|{BLANK}*(?:[{g}]+{run}?)+|{BLANK}+|\n")
        else:
            self.words = re.compile(f"{BLANK}*{run}|{BLANK}+|\n")
        # of words and of their segments: a word of one segment is there once
        self.memo, self.near = Cache(cache), Cache(cache // 10)

    def _trie(self, order: Callable[[str], str]) -> dict[str, tuple]:
        root: dict[str, list] = {}
        for p, edge in self.edges.items():
            children, node = root, None
            for c in order(p):
                node = children.setdefault(c, [{}, None, 0.0, 0])
                children = node[0]
            node[1:] = *edge, len(p)
        fixed = lambda nodes: {c: (fixed(children), *rest) for c, (children, *rest) in nodes.items()}
        return fixed(root)

    # ---- many segments at once

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def viterbi_all(self, texts: list[str]) -> list[tuple[bytes, float, float]]:
        """(packed ids, score, gap) of segments of which every character is a piece: viterbi() for all of them together, start by start."""
        n = np.array([len(t) for t in texts])
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        begins, seg = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        until = (begins + n)[seg]
        # edges: every stretch that is a piece, found by lengthening what is a prefix of one
        live, h, found = np.arange(len(cp)), np.zeros(len(cp), U), []
        for length in range(1, self.longest + 1):
            fits = live + length <= until[live]
            live, h = live[fits], h[fits]
            if not len(live):
                break
            h = h * U(_BASE) + cp[live + length - 1] + U(1)
            at = np.minimum(np.searchsorted(self.nodes, h), len(self.nodes) - 1)
            known = self.nodes[at] == h
            live, h, ids = live[known], h[known], self.node_ids[at[known]]
            piece = ids >= 0
            found.append((live[piece], np.full(int(piece.sum()), length), ids[piece]))
        start, length, ids = (np.concatenate(v) for v in zip(*found, strict=True))
        place = start - begins[seg[start]]
        order = np.lexsort((length, place))
        start, length, ids, place = start[order], length[order], ids[order], place[order]
        # positions: one more than characters in each segment
        source = start + seg[start]
        target, score = source + length, self.score_of[ids]
        first, last = begins + np.arange(len(n)), begins + np.arange(len(n)) + n
        one, two, back = np.full(len(cp) + len(n), -1e300), np.full(len(cp) + len(n), -1e300), np.full(len(cp) + len(n), -1)
        one[first] = 0.0
        cuts = np.searchsorted(place, np.arange(int(n.max()) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, t = source[a:b], target[a:b]  # one start in each segment, so targets differ
            new, old = one[s] + score[a:b], one[t]
            better = new > old
            two[t] = np.where(better, np.maximum(old, two[s] + score[a:b]), np.maximum(two[t], new))
            one[t] = np.where(better, new, old)
            back[t] = np.where(better, np.arange(a, b), back[t])
        # from the ends back, all segments together
        own, at, steps = np.arange(len(n)), last.copy(), []
        while len(own):
            edge = back[at]
            steps.append((own, ids[edge]))
            at = source[edge]
            more = at != first[own]
            own, at = own[more], at[more]
        own, number = np.concatenate([o for o, _ in steps]), np.repeat(np.arange(len(steps)), [len(o) for o, _ in steps])
        order = np.lexsort((-number, own))
        data = np.concatenate([i for _, i in steps])[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(own, minlength=len(n))) * 4).tolist()
        gap = np.where(two[last] > -1e299, one[last] - two[last], np.inf)
        return [(data[a:b], s, g) for a, b, s, g in zip([0, *ends[:-1]], ends, one[last].tolist(), gap.tolist(), strict=True)]

    def warm(self, texts: list[str]) -> list[list[str]]:
        """The words of texts; those that the cache does not know are worked out together."""
        words = [self.prepared(t) for t in texts]
        new, old = self.memo.new, self.memo.old
        missing = set(itertools.chain.from_iterable(words)).difference(new).difference(old)
        splits = {w: self._split(w) for w in missing if len(w) <= CACHED}
        parts = set(itertools.chain.from_iterable(splits.values())).difference(new).difference(old)
        parts = [p for p in parts if len(p) <= BATCHED]
        if parts:
            cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
            odd = self.single[np.minimum(np.searchsorted(self.single, cp), len(self.single) - 1)] != cp
            n = np.array([len(p) for p in parts])
            plain = np.flatnonzero(~np.logical_or.reduceat(odd, np.cumsum(n) - n))
            parts = [parts[i] for i in plain.tolist()]
            for at in range(0, len(parts), 1 << 14):
                some = parts[at : at + (1 << 14)]
                for p, found in zip(some, self.viterbi_all(some), strict=True):
                    self.memo.put(p, found)
        for w, split in splits.items():
            if len(split) > 1:
                self._joined(w, split)
        return words

    # ---- one segment

    def _bytes(self, c: str) -> tuple:
        """The node of a character that no piece covers."""
        node = self.odd.get(c)
        if node is None:
            if len(self.odd) > CACHE:
                self.odd.clear()
            raw = (BLANK if c == _LITERAL else c).encode()
            node = self.odd[c] = (None, tuple(self.byte_ids[b] for b in raw), self.byte_score * len(raw), 1)
        return node

    def edges_to(self, text: str, e: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of all edges that end at e."""
        children = self.back
        for s in range(e - 1, max(-1, e - 1 - self.longest), -1):
            node = children.get(text[s])
            if node is None:
                break
            children, ids, score, _ = node
            if ids is not None:
                yield s, ids, score
        if text[e - 1] not in self.edges:
            _, ids, score, _ = self._bytes(text[e - 1])
            yield e - 1, ids, score

    def forward(self, text: str) -> tuple[Sequence[float], Sequence[float], list]:
        """Of each position its best score, its second best, and the node of the best edge that ends there."""
        n, low = len(text), -1e300
        one, two, back = ([low] * (n + 1), [low] * (n + 1), [None] * (n + 1)) if n < LONG else (array("d", [low]) * (n + 1), array("d", [low]) * (n + 1), [None] * (n + 1))
        one[0] = 0.0
        trie, single, longest = self.trie, self.edges, self.longest
        for s in range(n):
            first, second, children, e = one[s], two[s], trie, s
            for c in text[s : s + longest]:
                node = children.get(c)
                if node is None:
                    break
                children, ids, score, _ = node
                e += 1
                if ids is None:
                    continue
                new = first + score
                best = one[e]
                if new > best:
                    other = second + score
                    two[e] = best if best > other else other
                    one[e] = new
                    back[e] = node
                elif new > two[e]:
                    two[e] = new
            if text[s] not in single:
                node = self._bytes(text[s])
                new, e = first + node[2], s + 1
                if new > one[e]:
                    two[e] = max(one[e], second + node[2])
                    one[e] = new
                    back[e] = node
                elif new > two[e]:
                    two[e] = new
        return one, two, back

    def viterbi(self, text: str) -> tuple[list[int], float, float]:
        """(ids, score, gap to the second best) of a segment: one forward pass that keeps each position's two best scores."""
        one, two, back = self.forward(text)
        parts, at = [], len(text)
        while at:
            node = back[at]
            parts.append(node[1])
            at -= node[3]
        return [i for ids in reversed(parts) for i in ids], one[-1], one[-1] - two[-1] if two[-1] > -1e299 else np.inf

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations of a segment, best first; fewer if there are no more.

        A* from the end: a hypothesis at `at` has the score g of what it has read and best[at] still to come, exactly. A position is left at
        most n times: what reaches it later is in none of the n best.
        """
        best = self.forward(text)[0]
        order = itertools.count()
        queue = [(-best[-1], len(text), next(order), 0.0, None)]
        left: Counter[int] = Counter()
        out = []
        while queue and len(out) < n:
            f, at, _, g, link = heapq.heappop(queue)
            if at == 0:
                ids = []
                while link is not None:
                    ids.extend(link[0])
                    link = link[1]
                out.append((-f, tuple(ids)))
                continue
            left[at] += 1
            if left[at] > n:
                continue
            for s, ids, score in self.edges_to(text, at):
                heapq.heappush(queue, (-(best[s] + score + g), s, next(order), g + score, (ids, link)))
        return out

    # ---- whole texts

    def _split(self, word: str) -> list[str]:
        """The segments of a word."""
        inner = self.inner
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in inner]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _part(self, text: str) -> tuple[bytes, float, float]:
        """(packed ids, score, gap to the second best) of a segment."""
        found = self.memo.get(text)
        if found is None:
            ids, score, gap = self.viterbi(text)
            found = self.memo.put(text, (struct.pack(f"<{len(ids)}I", *ids), score, gap))
        return found

    def _word(self, word: str) -> tuple[bytes, float, float]:
        found = self.memo.get(word)
        if found is None:
            split = self._split(word)
            found = self._part(word) if len(split) == 1 else self._joined(word, split)
        return found

    def _joined(self, word: str, split: list[str]) -> tuple[bytes, float, float]:
        """What is known of a word of several segments, from theirs."""
        ids, scores, gaps = zip(*[self._part(p) for p in split], strict=True)
        return self.memo.put(word, (b"".join(ids), sum(scores), min(gaps)))

    def prepared(self, text: str) -> list[str]:
        """The words of a text's lattice; an empty text has none."""
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, _LITERAL)
        return self.words.findall(BLANK + text.replace(" ", BLANK))

    def encode(self, text: str, n: int = N_BEST, words: list[str] | None = None) -> tuple[bytes, list[float], list[str]]:
        """(packed ids of the best segmentation, scores of the n best, the words). words: what prepared() gives, where it is known."""
        words = self.prepared(text) if words is None else words
        if not words:
            return b"", [0.0], words
        new, word = self.memo.new.get, self._word
        found = list(map(new, words))
        if not all(found):
            found = [f or word(w) for f, w in zip(found, words, strict=True)]
        ids, scores, gaps = zip(*found, strict=True)
        total = float(sum(scores))
        best = [total]
        if n > 1:
            best = [s for s, _ in self._combined(words, gaps, total, n)]
        return b"".join(ids), best, words

    def _near(self, text: str, n: int) -> list[float]:
        """Scores of a segment's n best."""
        key = f"{n} {text}"
        found = self.near.get(key)
        if found is None:
            found = self.near.put(key, [s for s, _ in self.n_best(text, n)])
        return found

    def _combined(self, words: list[str], gaps: Sequence[float], total: float, n: int) -> list[tuple[float, dict[int, int]]]:
        """(score, {(word, segment): which of its n best}) of the n best segmentations of all words."""
        values = np.array(gaps)
        near = np.argpartition(values, n - 2)[: n - 1].tolist() if len(values) >= n > 1 else range(len(values))
        spots = [((i, j), p) for i in near if gaps[i] < np.inf for j, p in enumerate(self._split(words[i]))]
        spots = heapq.nsmallest(n - 1, spots, key=lambda x: self._part(x[1])[2])
        lists = [(key, self._near(p, n)) for key, p in spots]
        lists = [(key, [x[0] - v for v in x]) for key, x in lists]
        queue, seen, out = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
        while queue and len(out) < n:
            loss, choice = heapq.heappop(queue)
            out.append((total - loss, {key: c for (key, _), c in zip(lists, choice, strict=True) if c}))
            for i, (_, x) in enumerate(lists):
                if choice[i] + 1 < len(x):
                    more = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(queue, (loss - x[choice[i]] + x[choice[i] + 1], more))
        return out

    def segmentations(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """(score, ids) of the n best segmentations of a whole text."""
        words = self.prepared(text)
        if not words:
            return [(0.0, [])]
        rows = [self._word(w) for w in words]
        out = []
        for score, changed in self._combined(words, [r[2] for r in rows], float(sum(r[1] for r in rows)), n):
            ids = []
            for i, w in enumerate(words):
                for j, p in enumerate(self._split(w)):
                    ids.extend(self.n_best(p, changed.get((i, j), 0) + 1)[-1][1])
            out.append((score, ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the blank put in front is taken away."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


def pieces(source: bytes, cache: int = CACHE) -> Pieces:
    """A worker's own. Its caches are hundreds of thousands of tuples that stay: the search for cycles, which there are none of, is put off."""
    gc.set_threshold(200_000, 50, 100)
    return kept(("pieces", hash(source), cache), lambda: Pieces(source, cache))


def encoded(docs: DataFrame, model: str, n: int = N_BEST, cache: int = CACHE) -> DataFrame:
    """doc_id, ids (best segmentation), n_tokens, n_best_scores (best first), decoded (the text that the ids give back) of every row.

    A null or empty text has no ids, the score 0 and decodes to an empty text. Repeated rows are encoded as often as they are there.
    """
    source = docs.sparkSession.sparkContext.broadcast(load(model)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(source.value, cache)
        for x in slices(batches, most=SLICE_BYTES):
            packed, scores, decoded = [], [], []
            texts = [t or "" for t in col(x, "text").to_pylist()]
            for text, words in zip(texts, of.warm(texts), strict=True):
                ids, best, _ = of.encode(text, n, words)
                packed.append(ids)
                scores.append(best)
                decoded.append(of.decode(np.frombuffer(ids, "<u4")))
            cuts = np.append(0, np.cumsum([len(p) // 4 for p in packed]))
            ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), ids, pa.array(np.diff(cuts)), pa.array(scores, pa.list_(pa.float64())), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "n_best_scores", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_best_scores array<double>, decoded string")


def digests(docs: DataFrame, model: str, n: int = N_BEST, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), score, n_best, gap (best to last of the n best), decoded_sha256 (of the decoded text)."""
    source = docs.sparkSession.sparkContext.broadcast(load(model)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        of = pieces(source.value, cache)
        for x in slices(batches, most=SLICE_BYTES):
            out = []
            texts = [t or "" for t in col(x, "text").to_pylist()]
            for text, words in zip(texts, of.warm(texts), strict=True):
                ids, best, _ = of.encode(text, n, words)
                back = of.decode(np.frombuffer(ids, "<u4"))
                out.append((len(ids) // 4, zlib.crc32(ids), best[0], len(best), best[0] - best[-1], hashlib.sha256(back.encode()).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), *(pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_tokens", "ids_crc32", "score", "n_best", "gap", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, score double, n_best int, gap double, decoded_sha256 string")
