"""Byte-level BPE encoding and decoding by a rank file: a segment tree holds the leftmost least pair rank of a pre-token.

A text is split by the tokenizer's pattern. A pre-token that is itself a token is done. Of any other each byte begins as a part of its own, and
leaf i of the tree is the rank of part i and the next live part (none: infinite). The root is the leftmost of the least ranks. A merge
joins that part with its right neighbour and changes three leaves at most: the part's own, its left neighbour's and that of the part that has
gone. Each is a logarithmic walk, so a run of a million letters takes n log n steps.

Pre-tokens of up to FOREST bytes that a slice of texts needs are worked out together: their trees are the rows of one array, and each step
makes one merge in every row that has one left. Longer ones have a tree each.

A worker keeps what it knows of pre-tokens it has met, up to CACHE of them and never long ones, in two generations of which the older goes when the
younger is full: time only, ids are the same. A text is taken
through in stretches of STRETCH pre-tokens, so what is held does not grow with its length. Decoding joins the ids' bytes;
every text comes back byte for byte.

Null and empty texts have no ids. Special tokens have no meaning: their strings are ordinary text. Rows that repeat, and null doc_ids, go each by
its own text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, kept, release_memory, slices
from .tokenizer import load

#: Pre-tokens that a worker remembers; characters of the longest of them; pre-tokens of a text that are worked on at once.
CACHE, CACHED_CHARS, STRETCH = 600_000, 48, 1 << 16
#: Bytes of the longest pre-token that shares an array of trees; trees in such an array.
FOREST, TREES = 32, 1 << 14
_NONE = 1 << 62
_NO_RANK = np.iinfo(np.int64).max


class RankTree:
    """The parts of a pre-token's bytes, and a segment tree over them with the leftmost least rank of two live neighbours at its root."""

    def __init__(self, data: bytes, ranks: dict[bytes, int]):
        n = len(data)
        self.data, self.ranks = data, ranks
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.size = size = 1 << (n - 1).bit_length()
        # a rank in the high bits, its position in the low ones: the least number is the leftmost least rank
        leaves = [r << 32 | i if (r := ranks.get(data[i : i + 2], -1)) >= 0 else _NONE for i in range(n - 1)]
        self.tree = tree = [_NONE] * size + leaves + [_NONE] * (size - n + 1)
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def _put(self, i: int, value: int) -> None:
        tree, i = self.tree, i + self.size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    def _rank(self, i: int) -> None:
        """Leaf i anew, from part i and the live part after it."""
        j = self.after[i]
        r = self.ranks.get(self.data[i : self.after[j]], -1) if j < len(self.data) else -1
        self._put(i, r << 32 | i if r >= 0 else _NONE)

    def merge(self) -> bool:
        """One merge at the root's position; False where no pair of neighbours has a rank."""
        least = self.tree[1]
        if least == _NONE:
            return False
        i = least & 0xFFFFFFFF
        j = self.after[i]
        k = self.after[i] = self.after[j]
        if k < len(self.data):
            self.before[k] = i
        self._put(j, _NONE)
        self._rank(i)
        if self.before[i] >= 0:
            self._rank(self.before[i])
        return True

    def parts(self) -> Iterator[bytes]:
        i = 0
        while i < len(self.data):
            yield self.data[i : self.after[i]]
            i = self.after[i]


class Pairs:
    """The token that two neighbouring tokens become, for arrays of them: a hash table of every split of every token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.shift = 64 - max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << (64 - self.shift), -1, np.int64), np.full(1 << (64 - self.shift), _NO_RANK, np.int64)
        left, new = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slots(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]
            placed = self.keys[at] == left  # of several that want a free slot the last has got it
            self.values[at[placed]] = new[placed]
            left, new, at = left[~placed], new[~placed], (at[~placed] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_NO_RANK where two tokens do not join."""
        keys = a << 32 | b
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NO_RANK)
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.keys) - 1)
            found = self.keys[at[on]]
            hit = found == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out


def forest(words: list[bytes], size: int, pairs: Pairs, of_byte: np.ndarray) -> list[list[int]]:
    """The ids of words of 2 to `size` bytes (a power of two): RankTree's merges, one in each word at a time, in arrays."""
    n = len(words)
    lengths = np.array([len(w) for w in words])
    raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
    place = np.arange(size)
    # flat arrays; a word has one column more, for what is behind its end and in front of its start
    wide = size + 1
    ids = np.zeros((n, wide), np.int64)
    ids[:, :size] = of_byte[raw]
    after, before = np.broadcast_to(np.arange(1, wide + 1), (n, wide)).copy(), np.broadcast_to(np.arange(-1, size), (n, wide)).copy()
    tree = np.full((n, 2 * size), _NO_RANK)
    live = place[:-1] < lengths[:, None] - 1
    first = np.full((n, size - 1), _NO_RANK)
    first[live] = pairs.ranks(ids[:, :-2][live], ids[:, 1:-1][live])
    ranked = first != _NO_RANK
    tree[:, size : 2 * size - 1][ranked] = (first * size + place[:-1])[ranked]
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        base, at = rows * (2 * size), at + size
        tree[base + at] = values
        while at[0] > 1:  # all leaves are as far from their root
            at = at >> 1
            here = base + at
            tree[here] = np.minimum(tree[here + at], tree[here + at + 1])

    def rank(rows: np.ndarray, at: np.ndarray) -> None:
        """Leaves anew, from the parts there and the live parts after them."""
        cell = rows * wide
        to = after[cell + at]
        inside = to < lengths[rows]
        values = np.full(len(rows), _NO_RANK)
        of = pairs.ranks(ids[(cell + at)[inside]], ids[(cell + to)[inside]])
        values[inside] = np.where(of == _NO_RANK, of, of * size + at[inside])
        put(rows, at, values)

    rows = np.arange(n)
    while True:
        least = tree[rows * (2 * size) + 1]
        left = least != _NO_RANK
        if not left.any():
            break
        rows, least = rows[left], least[left]
        i, cell = least % size, rows * wide
        ids[cell + i] = least // size
        j = after[cell + i]
        k = after[cell + j]
        after[cell + i] = k
        inside = k < lengths[rows]
        before[(cell + k)[inside]] = i[inside]
        put(rows, j, np.full(len(rows), _NO_RANK))
        rank(rows, i)
        p = before[cell + i]
        has = p >= 0
        if has.any():
            rank(rows[has], p[has])
    # the live parts, from each word's start
    starts = np.zeros((n, wide), bool)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    while len(rows):
        starts[rows, at] = True
        at = after[rows * wide + at]
        on = at < lengths[rows]
        rows, at = rows[on], at[on]
    flat, ends = ids[starts.ravel()].tolist(), np.cumsum(starts.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


#: What is known of a pre-token: its ids, the same as text, the bytes they decode to.
Known = tuple[tuple[int, ...], str, bytes]


class ByteBpe:
    """Encodes and decodes by the ranks of a file's content: lines of a token in base64 and its rank."""

    def __init__(self, source: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source.splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.pairs, self.of_byte = Pairs(self.ranks), np.array([self.ranks[bytes([b])] for b in range(256)])
        self.memo: dict[str, Known] = {}
        self.older: dict[str, Known] = {}

    def pre_token(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        tree = RankTree(data, self.ranks)
        while tree.merge():
            pass
        return tuple(map(self.ranks.__getitem__, tree.parts()))

    def _known(self, ids: tuple[int, ...]) -> Known:
        return ids, ",".join(map(str, ids)), self.decode(ids)

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Takes what is not known of these into the memo, but for long ones."""
        met = {p for p in set(pre_tokens) if len(p) <= CACHED_CHARS}
        wanted = met.difference(self.memo)
        if len(self.memo) + len(wanted) > CACHE // 2:
            self.older, self.memo, wanted = self.memo, {}, met
        older, memo, ranks, missed = self.older, self.memo, self.ranks, {}
        for p in wanted:
            known = older.get(p)
            if known is not None:
                memo[p] = known
                continue
            data = p.encode()
            whole = ranks.get(data)
            if whole is not None:
                memo[p] = self._known((whole,))
            elif len(data) > FOREST:
                memo[p] = self._known(self.pre_token(p))
            else:
                missed.setdefault(1 << (len(data) - 1).bit_length(), []).append((p, data))
        for size, some in missed.items():
            for at in range(0, len(some), TREES):
                part = some[at : at + TREES]
                for (p, _), ids in zip(part, forest([d for _, d in part], size, self.pairs, self.of_byte), strict=True):
                    memo[p] = self._known(tuple(ids))

    def known(self, pre_tokens: list[str]) -> list[Known]:
        """For pre-tokens that learn() has had."""
        found = list(map(self.memo.get, pre_tokens))
        if None in found:
            found = [k or self._known(self.pre_token(p)) for k, p in zip(found, pre_tokens, strict=True)]
        return found

    def texts(self, texts: list[str]) -> Iterator[Iterator[list[Known]]]:
        """For each text what is known of its pre-tokens, in stretches. The texts of a slice learn together; one of its own may be long."""
        if len(texts) == 1:
            yield self._stretches(m[0] for m in self.split.finditer(texts[0]))
            return
        lists = list(map(self.split.findall, texts))
        self.learn(chain.from_iterable(lists))
        for pre_tokens in lists:
            yield iter([self.known(pre_tokens)] if pre_tokens else [])

    def _stretches(self, found: Iterator[str]) -> Iterator[list[Known]]:
        while stretch := list(islice(found, STRETCH)):
            self.learn(stretch)
            yield self.known(stretch)

    def encode(self, text: str) -> list[int]:
        return [i for known in next(self.texts([text])) for ids, _, _ in known for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(source: bytes, pattern: str) -> ByteBpe:
    """A worker's own, kept with what it remembers."""
    return kept(("byte-bpe", hash((source, pattern))), lambda: ByteBpe(source, pattern))


def _mapped(docs: DataFrame, ranks: str, pattern: str, make, columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """One row of `make` of each text's stretches beside its doc_id; columns: the names, their types and Arrow types."""
    source = docs.sparkSession.sparkContext.broadcast(load(ranks)[0])  # a vocabulary file, of a size that is given
    kinds = [kind for _, kind in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(source.value, pattern)
        for x in slices(batches):
            rows = [make(found) for found in of.texts([t or "" for t in col(x, "text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), *map(pa.array, zip(*rows, strict=True), kinds)], ["doc_id", *columns])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items()))


def encoded(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    return _mapped(docs, ranks, pattern, lambda found: ([i for known in found for ids, _, _ in known for i in ids],), {"ids": ("array<int>", pa.list_(pa.int32()))})


def decoded(rows: DataFrame, ranks: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids are an empty text, bytes that are no UTF-8 become U+FFFD. An unknown id is an error."""
    source = rows.sparkSession.sparkContext.broadcast(load(ranks)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(source.value, public_tokenizers.PATTERN)
        for x in batches:
            texts = [of.decode(ids or ()).decode(errors="replace") for ids in col(x, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def _digest(found: Iterator[list[Known]]) -> tuple[int, str, str]:
    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
    for known in found:
        ids, as_text, data = zip(*known, strict=True)
        ids_sha.update(("," if n else "").encode() + ",".join(as_text).encode())
        text_sha.update(b"".join(data))
        n += sum(map(len, ids))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def digests(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes) of every row."""
    return _mapped(docs, ranks, pattern, _digest, {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())})
