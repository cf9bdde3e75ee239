"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words (A-Z lower-cased) and one end after each text; n-grams are tokens and pairs of neighbours (the end stands before
each text). The filter holds an n-gram with its count on a log scale: a count at level q (base BASE) is q entries (n-gram, 1) ..
(n-gram, q). Reading a count means probing levels until one is missing. It holds every token and every pair of the training texts that
occurs LEAST times or more: no vocabulary, no cap. A pair below that is one that only its own text has, and is the same as unseen.

The filter grows with the corpus, so no single broadcast could hold it. It is cut by n-gram hash into parts of about PART_TOKENS
training tokens each; a part is what a worker is sent, with the exact counts of its tokens for the base score:

1. count: each block of texts sends its distinct n-grams, packed, to their parts, where they add up. A part becomes one filter.
2. probe: texts are dealt into blocks by hash, and a block sends its distinct n-grams to the parts. Each part reads them off its filter.
3. score: the levels return to their blocks, where all texts are scored.

How frequent an n-gram is makes no difference: a block names it once, so no part and no block is hot. Nothing but three totals is
gathered on the driver.

Model: p(w | v) = PAIR * low(v w) / high(v) + (1 - PAIR) * (low(w) + 1) / (N + V + 1), where low and high are the least and the largest
count that a level stands for, and v's count is 0 if it is unknown (no first term then). So p sums to at most one over all words and one
unseen, but for false positives of the filter (a pair needs two of them at 10 bits an entry: about 1 in 10 000).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, flat, forget, held_out, longs, release_memory, slices, written
from .words import LOWER, U, find_words, mix, word_hashes

BASE, PAIR, LEAST = 1.5, 0.5, 2
#: Probes and bits for each entry.
PROBES, BITS = 5, 10
#: Training tokens for each part of the filter, and bytes of text in a block.
PART_TOKENS, BLOCK_BYTES = 1 << 20, 8 << 20
#: The end of a text; no word has this hash by construction of its own.
END = U(0x5EED0F0E0D0C0B0A)
#: Pairs go by the upper bits of their hash.
_SHORT = U(16)


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, ends included, and where each text's tokens begin (with the count of all at the end)."""
    starts, ends, first = find_words(raw, offs)
    n = len(offs) - 1
    begins = first + np.arange(n + 1)
    out = np.full(len(starts) + n, END)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = word_hashes(LOWER[raw], starts, ends)
    return out, begins


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0xD6E8FEB86659FD93) + mix(b))


def pairs_of(seq: np.ndarray) -> np.ndarray:
    """The pair that ends at each token. A text's first token follows an end: that of the text before, or of nothing."""
    return pair_hash(np.append(END, seq[:-1]), seq) >> _SHORT


class Filter:
    """Bloom filter over (n-gram hash, level)."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, U(len(words) * 64 - 1)

    @classmethod
    def sized(cls, entries: int, bits: int = BITS) -> Filter:
        size = max(10, (bits * max(entries, 1) - 1).bit_length())
        return cls(np.zeros((1 << size) >> 6, U))

    def _places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a = mix(h + U(level * 0x9E3779B97F4A7C15 % 2**64))
        b = mix(a) | U(1)
        for i in range(PROBES):
            yield (a + U(i) * b) & self.mask

    def add(self, h: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in self._places(h[levels >= level], level):
                np.bitwise_or.at(self.words, at >> U(6), U(1) << (at & U(63)))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The last level of each n-gram that has no missing one before it. What one probe misses is probed no further."""
        out = np.zeros(len(h), np.uint8)
        live, level = np.arange(len(h)), 1
        while len(live):
            a = mix(h[live] + U(level * 0x9E3779B97F4A7C15 % 2**64))
            b = mix(a) | U(1)
            for i in range(PROBES):
                at = (a + U(i) * b) & self.mask
                hit = (self.words[at >> U(6)] >> (at & U(63))) & U(1) == 1
                live, a, b = live[hit], a[hit], b[hit]
            out[live] = level
            level += 1
        return out


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1; one more for each factor of BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def low_of(levels: np.ndarray) -> np.ndarray:
    """The least count at a level; 0 for none."""
    return np.where(levels > 0, np.ceil(BASE ** (levels - 1.0) - 1e-9), 0.0)


def high_of(levels: np.ndarray) -> np.ndarray:
    """The largest count at a level; 0 for none."""
    return np.where(levels > 0, np.maximum(np.ceil(BASE ** (levels * 1.0) - 1e-9) - 1, low_of(levels)), 0.0)


# ---- numbers on their way


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed: small ones cost about their size."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(U)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=U)


def _cuts(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part's keys begin among sorted ones: parts are equal ranges of the hash."""
    part = ((keys >> U(bits - 32)) * U(parts)) >> U(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(U))


def _parted(tokens_: np.ndarray, pairs: np.ndarray, parts: int) -> Iterator[tuple[int, slice, slice]]:
    """(part, its tokens, its pairs) of sorted keys; only parts that have some."""
    a, b = _cuts(tokens_, 64, parts), _cuts(pairs, 48, parts)
    for p in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
        yield p, slice(a[p], a[p + 1]), slice(b[p], b[p + 1])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for x in batches:
        for i in range(x.num_rows):
            yield {c: col(x, c)[i].as_py() for c in x.schema.names}


# ---- 1 count


class Model:
    """parts (DataFrame: part, bits, tokens, counts), how many, and totals: training tokens, distinct tokens."""

    def __init__(self, table: DataFrame, parts: int, total: int, distinct: int):
        self.table, self.parts, self.total, self.distinct = table, parts, total, distinct


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, U), np.empty(0, np.int64)
    all_, back = np.unique(np.concatenate(keys), return_inverse=True)
    return all_, np.bincount(back, weights=np.concatenate(counts), minlength=len(all_)).astype(np.int64)


def train(train_docs: DataFrame) -> Model:
    """Counts all n-grams of the texts and builds the parts of the filter, as a table in the shared folder."""
    size = train_docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    parts, bits = 1 + int(size) // 5 // PART_TOKENS, BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in slices(batches, most=BLOCK_BYTES):
            seq, _ = tokens(*flat(col(x, "text")))
            u, n = np.unique(seq, return_counts=True)
            p, m = np.unique(pairs_of(seq), return_counts=True)
            out = [(k, _pack_sorted(u[a]), _pack(n[a]), _pack_sorted(p[b]), _pack(m[b])) for k, a, b in _parted(u, p, parts)]
            k, *data = (list(v) for v in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *(pa.array(v, pa.binary()) for v in data)], ["part", "u", "n", "p", "m"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part, rows in groupby(_rows_of(batches), key=lambda r: r["part"]):
            sums: list[list[list[np.ndarray]]] = [[[], []], [[], []]]
            for i, r in enumerate(rows):
                for (keys, counts), k, n in zip(sums, ("u", "p"), ("n", "m"), strict=True):
                    keys.append(_unpack_sorted(r[k]))
                    counts.append(_unpack(r[n]).astype(np.int64))
                if i % 32 == 31:  # what has come so far adds up, so that a part never holds more than its own n-grams and some blocks' worth
                    sums = [[[k], [n]] for k, n in (_sum(*s) for s in sums)]
            (u, n), (p, m) = (_sum(*s) for s in sums)
            seen = m >= LEAST
            p, m = p[seen], m[seen]
            levels = level_of(n), level_of(m)
            made = Filter.sized(int(levels[0].sum() + levels[1].sum()), bits)
            made.add(u, levels[0])
            made.add(p, levels[1])
            arrays = [pa.array([part], pa.int32()), *(pa.array([v], pa.binary()) for v in (made.words.tobytes(), _pack_sorted(u), _pack(n))), pa.array([int(n.sum())]), pa.array([len(u)])]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "bits", "u", "n", "total", "types"])
        release_memory()

    counted = train_docs.mapInArrow(count, "part int, u binary, n binary, p binary, m binary")
    built = counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(build, "part int, bits binary, u binary, n binary, total long, types long")
    table = written(built, "lm-filter")
    total, distinct = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    return Model(table, parts, int(total), int(distinct))


# ---- 2 probe, 3 score


def _asked(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """tokens in order, where texts begin, distinct tokens and pairs (sorted), and which of them each token is and ends."""
    seq, begins = tokens(*flat(texts))
    u, which = np.unique(seq, return_inverse=True)
    p, pair = np.unique(pairs_of(seq), return_inverse=True)
    return seq, begins, u, which, p, pair


def log10(levels: np.ndarray, previous: np.ndarray, pairs: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 p of each token from the levels of the token, of the one before it and of the pair."""
    single = (low_of(levels) + 1) / (total + distinct + 1)
    both = np.where((pairs >= 2) & (previous > 0), low_of(pairs) / np.maximum(high_of(previous), 1.0), 0.0)
    return np.log10(PAIR * np.minimum(both, 1.0) + (1 - PAIR) * single)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; docs has doc_id, text and held_out.

    A null or empty text is its end alone. Repeated rows are scored as often as they are there; rows of one doc_id are texts of their
    own. With no training document all counts are zero. Scores are finite for every text. An empty table gives no rows.
    """
    parts, total, distinct = model.parts, model.total, model.distinct
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    blocks = 1 + int(size) // BLOCK_BYTES
    # Copies, however many, are dealt out: a row's number takes part in the hash. Both uses below read one and the same shuffle.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(key: tuple, x: pa.Table) -> pa.Table:
        forget()
        _, _, u, _, p, _ = _asked(x["text"].combine_chunks())
        out = [(key[0].as_py(), k, _pack_sorted(u[a]), _pack_sorted(p[b])) for k, a, b in _parted(u, p, parts)]
        block, k, a, b = (list(v) for v in zip(*out, strict=True))
        release_memory()
        return pa.table({"part": pa.array(k, pa.int32()), "block": pa.array(block, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.nulls(len(k), pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part: its filter first (block -1), then what is asked of it. A part that training has not filled knows nothing."""
        forget()
        now, made, types, counts = None, Filter.sized(0), np.empty(0, U), np.empty(0, U)
        for r in _rows_of(batches):
            if r["part"] != now:
                now, made, types, counts = r["part"], Filter.sized(0), np.empty(0, U), np.empty(0, U)
            if r["block"] < 0:
                made, types, counts = Filter(np.frombuffer(r["a"], U)), _unpack_sorted(r["b"]), _unpack(r["c"])
                continue
            u, p = _unpack_sorted(r["a"]), _unpack_sorted(r["b"])
            n = np.zeros(len(u), U)
            if len(types):
                at = np.minimum(np.searchsorted(types, u), len(types) - 1)
                n = np.where(types[at] == u, counts[at], U(0))
            said = [_pack(n), _pack(made.levels(u)), _pack(made.levels(p))]
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int32()), pa.array([now], pa.int32()), *(pa.array([v], pa.binary()) for v in said)], ["block", "part", "n", "u", "p"])
        release_memory()

    probes = dealt.groupBy("block").applyInArrow(ask, "part int, block int, a binary, b binary, c binary")
    filters = model.table.select("part", F.lit(-1).alias("block"), F.col("bits").alias("a"), F.col("u").alias("b"), F.col("n").alias("c"))
    met = probes.unionByName(filters).repartition(parts, "part").sortWithinPartitions("part", "block")
    answers = met.mapInArrow(answer, "block int, part int, n binary, u binary, p binary")

    def score(texts: pa.Table, levels: pa.Table) -> pa.Table:
        forget()
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        seq, begins, u, which, p, pair = _asked(texts["text"].combine_chunks())
        levels = levels.sort_by("part")
        n, a, b = (np.concatenate([_unpack(v) for v in levels[c].to_pylist()]) for c in ("n", "u", "p"))
        if len(n) != len(u) or len(a) != len(u) or len(b) != len(p):
            raise RuntimeError("a block's answers are not for its texts")
        sums = lambda v: np.add.reduceat(v, begins[:-1])  # noqa: E731  each text has an end, so no run is empty
        base = np.log10((n.astype(np.int64) + 1) / (total + distinct + 1))[which]
        level = a.astype(np.int64)[which]
        first = int(np.searchsorted(u, END))
        previous = np.append(a.astype(np.int64)[first], level[:-1])  # the end stands before the first text, too
        model_score = log10(level, previous, b.astype(np.int64)[pair], total, distinct)
        out = {
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(np.diff(begins)), "n_known": pa.array(sums((n > 0)[which].astype(np.int64))),
            "base_score": pa.array(sums(base)), "score": pa.array(sums(model_score)),
        }
        release_memory()
        return pa.table(out)

    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns; training is on documents whose crc32(doc_id) mod 7 is not 2."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    return scores(rows, train(rows.where(~F.col("held_out")).select(F.col("text").cast("string").alias("text"))))
