"""Target-distribution importance resampling: documents drawn by how much their word runs look like a target's.

Features are runs of 1 to `grams` consecutive words, hashed into BUCKETS. Each task counts a slice's features in one array; the sums
of both tables are two arrays of that fixed size, from which every bucket has an integer gain. A second pass scores all documents of a slice
by one lookup and one running sum, adds Gumbel noise from a hash of the doc_id, and writes the scores. The highest scores are then a draw
without replacement.

The draw is an external merge. The key space is cut into ranges by splitters from a bounded sample of scores (they change time, never
results), the rows of each range are counted exactly, and ranges below the last that is needed are never sorted or shuffled. Each partition sorts
its eligible rows into runs, cut by range and into blocks. A range's blocks meet in one task, ordered by their first rows by
Spark's own sort, which spills; a tournament tree takes the blocks in as their first row comes up, so it holds those blocks only that
overlap. It gives ranks from the exact count of the ranges above and stops merging at the last draw.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A null or empty text has no feature and weight 0. A null
doc_id is hashed as an empty string and comes last among ties. Rows that repeat a doc_id are drawn each by its own; rows with equal score and
doc_id are ordered by their number of features. Documents below `least_words` words are scored, never drawn. Empty tables give empty
results; an empty target leaves gains from the documents alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, flat, forget, release_memory, slices, written
from .words import LOWER, NOT_ALNUM, find_words, joined, span_crcs

BUCKETS, GRAMS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Scores in the sample that places the splitters; ranges at least, and drawn rows that make one more range.
SAMPLE, RANGES, RANGE_ROWS = 50_000, 64, 1 << 21
#: Rows that a partition sorts as one run; rows of a block.
RUN_ROWS, BLOCK_ROWS = 1 << 20, 1 << 12

_ROW = np.dtype([("down", "<i8"), ("none", "<i8"), ("doc", "<i8"), ("n", "<i8"), ("weight", "<i8")])
_KEY = ["down", "none", "doc", "n"]
_OUT = "doc_id long, n_features long, weight long, score long, rank long"


def features(raw: np.ndarray, offs: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each run length its buckets and the index of each text's first run (with the count of all at the end)."""
    starts, ends, first = find_words(raw, offs, NOT_ALNUM)
    low, found = LOWER[raw], []
    if grams > 1 and len(starts):
        data, starts, ends = joined(low, starts, ends)
        low = np.frombuffer(data, np.uint8)
    for g in range(1, grams + 1):
        a, b = starts[: max(0, len(starts) - g + 1)], ends[g - 1 :]
        f = first
        if g > 1:
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            whole = text[: len(a)] == text[g - 1 :]
            a, b = a[whole], b[whole]
            f = np.append(0, np.cumsum(np.maximum(np.diff(first) - g + 1, 0)))
        found.append((span_crcs(low, a, b) % np.uint32(buckets), f))
    return np.diff(first), found


def bucket_counts(docs: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket: each task sends its sums, never a feature; only the array reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums = np.zeros(buckets, np.int64)
        for x in slices(batches):
            for of, _ in features(*flat(col(x, "text")), grams, buckets)[1]:
                sums += np.bincount(of, minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratios = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, eligible of every row."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        of = gain.value
        for x in slices(batches):
            n_words, found = features(*flat(col(x, "text")), grams, buckets)
            n, weight = np.zeros(x.num_rows, np.int64), np.zeros(x.num_rows, np.int64)
            for b, first in found:
                sums = np.append(0, np.cumsum(of[b]))
                n += np.diff(first)
                weight += sums[first[1:]] - sums[first[:-1]]
            score = weight + np.array([noise(i, seed) for i in col(x, "doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), *map(pa.array, (n, weight, score, n_words >= least_words))], ["doc_id", "n_features", "weight", "score", "eligible"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, eligible boolean")


class Tournament:
    """A tournament tree over the first rows of sorted blocks: the root is the least of all, and a block that moves on replays its own path only."""

    END = (math.inf,)

    def __init__(self) -> None:
        self.size, self.tree, self.rest, self.free = 1, [self.END, self.END], [iter(())], [0]

    def add(self, block: Iterator[tuple]) -> None:
        """Takes in a block: an iterator of rows (tuples) in order."""
        if not self.free:
            leaves = self.tree[self.size :] + [self.END] * self.size
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.rest += [iter(())] * self.size
            self.size *= 2
            self.tree = [self.END] * self.size + leaves
            for i in range(self.size - 1, 0, -1):
                self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
        slot = self.free.pop()
        self.rest[slot] = block
        self._next(slot)

    def _next(self, slot: int) -> None:
        row = next(self.rest[slot], None)
        tree, i = self.tree, self.size + slot
        if row is None:
            self.free.append(slot)
            tree[i] = self.END
        else:
            tree[i] = (*row, slot)
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

    def least(self) -> tuple:
        return self.tree[1]

    def pop(self) -> tuple:
        """The least row, which goes."""
        *row, slot = self.tree[1]
        self._next(slot)
        return tuple(row)

    def drain(self) -> Iterator[tuple]:
        """All rows that are left, in no order."""
        for i in range(self.size):
            if self.tree[self.size + i] is not self.END:
                yield self.tree[self.size + i][:-1]
                yield from self.rest[i]
        self.__init__()


def _range_of(score: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """0 for the highest scores; splitters descend, each is the least score of its range."""
    return np.searchsorted(-splitters, -score, "left")


def _splitters(rows: DataFrame, total: int, draws: int) -> np.ndarray:
    ranges = max(RANGES, -(-draws // RANGE_ROWS))
    part = min(1.0, SAMPLE / max(total, 1))
    # distinct: a row that repeats, however often, is in the sample once or not at all
    some = rows.where(F.pmod(F.xxhash64("doc_id", "score"), F.lit(1 << 20)) < part * (1 << 20)).select("doc_id", "score").distinct()
    found = np.sort(np.array([r.score for r in some.select("score").toLocalIterator()], np.int64))[::-1]
    if not len(found):
        return found
    # `ranges` of them over the part that is drawn, a quarter as many over all others
    top = max(1, -(-len(found) * draws // max(total, 1)))
    at = np.concatenate([np.linspace(0, top - 1, ranges), np.linspace(top, len(found) - 1, ranges // 4)]).astype(int)
    return np.unique(found[np.minimum(at, len(found) - 1)])[::-1]


def _range_counts(rows: DataFrame, splitters: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(splitters) + 1, np.int64)
        for x in batches:
            sums += np.bincount(_range_of(col(x, "score").to_numpy(), splitters), minlength=len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["range", "n"])

    out = np.zeros(len(splitters) + 1, np.int64)
    for r in rows.select("score").mapInArrow(run, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["range"]] = r.n
    return out


def _blocks(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Sorted runs of each partition, cut by range and into blocks: range, the first row's key, rows (packed)."""

    def cut(parts: list[np.ndarray]) -> pa.RecordBatch:
        run = np.sort(np.concatenate(parts), order=_KEY)
        of = _range_of(-run["down"], splitters)
        edges = np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(run)]])
        at = np.concatenate([np.arange(a, b, BLOCK_ROWS) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        to = np.append(at[1:], len(run))
        packed = [run[a:b].tobytes() for a, b in zip(at.tolist(), to.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(of[at].astype(np.int32)), *(pa.array(run[c][at]) for c in _KEY), pa.array(packed, pa.binary())], ["range", *_KEY, "rows"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for x in batches:
            part = np.empty(x.num_rows, _ROW)
            doc = col(x, "doc_id")
            part["down"], part["none"], part["doc"] = -col(x, "score").to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            part["n"], part["weight"] = col(x, "n_features").to_numpy(), col(x, "weight").to_numpy()
            parts.append(part)
            size += len(part)
            if size >= RUN_ROWS:
                yield cut(parts)
                parts, size = [], 0
        if size:
            yield cut(parts)
        release_memory()

    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(runs, "range int, down long, none long, doc long, n long, rows binary")


def merged(blocks: Iterator[tuple[int, tuple, bytes]], above: np.ndarray, draws: int) -> Iterator[tuple]:
    """(down, none, doc, n, weight, rank or None) of the rows of all blocks: (range, first key, packed rows), ordered by range and first key.

    `above` has the rows in the ranges above each. A block joins the tournament when its first row comes up.
    """

    def play(tree: Tournament, until: tuple | None) -> Iterator[tuple]:
        nonlocal rank
        while rank < draws and (x := tree.least()) is not Tournament.END and (until is None or x[: len(_KEY)] <= until):
            rank += 1
            yield *tree.pop(), rank
        if rank >= draws:
            for row in tree.drain():
                yield *row, None

    tree, now, rank = Tournament(), None, 0
    for of, key, rows in blocks:
        if of != now:
            yield from play(tree, None)
            now, rank = of, int(above[of])
        yield from play(tree, key)
        block = iter(np.frombuffer(rows, _ROW).tolist())
        if rank < draws:
            tree.add(block)
        else:
            for row in block:
                yield *row, None
    yield from play(tree, None)


def _merge(blocks: DataFrame, above: np.ndarray, draws: int) -> DataFrame:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        down, none, doc, n, weight, rank = zip(*rows, strict=True)
        docs = pa.array([None if x else d for x, d in zip(none, doc, strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([docs, pa.array(n), pa.array(weight), pa.array([-d for d in down]), pa.array(rank, pa.int64())], ["doc_id", "n_features", "weight", "score", "rank"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, bytes]]:
        for x in batches:
            keys = zip(*(col(x, c).to_pylist() for c in _KEY), strict=True)
            yield from zip(col(x, "range").to_pylist(), keys, map(pa.BinaryScalar.as_py, col(x, "rows")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = []
        for row in merged(listed(batches), above, draws):
            rows.append(row)
            if len(rows) >= 1 << 14:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)

    return blocks.repartition("range").sortWithinPartitions("range", *_KEY).mapInArrow(run, _OUT)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row: rank 1, 2, ... for the floor(percent * N / 100) highest scores among the N documents of at least `least_words` words, else null."""
    scored = written(scores(docs, target, grams, buckets, least_words, seed), "scores")
    eligible = scored.where("eligible")
    total = eligible.count()
    draws = percent * total // 100
    unranked = lambda rows: rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not draws:
        return unranked(scored)
    splitters = _splitters(eligible, total, draws)
    counts = _range_counts(eligible, splitters)
    ends = np.cumsum(counts)
    last = int(np.searchsorted(ends, draws, "left"))
    needed = F.col("eligible") & (F.col("score") >= int(splitters[last])) if last < len(splitters) else F.col("eligible")
    drawn = _merge(_blocks(scored.where(needed), splitters), ends - counts, draws)
    return unranked(scored.where(~needed)).unionByName(drawn)
