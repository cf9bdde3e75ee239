"""SimHash near-duplicates, joined through Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit b is set if over half of the XXH64 (seed 42) of its 3-word shingles have it
set. Fingerprints link at RADIUS or fewer differing bits. To find links without comparing all pairs:

* the 64 bits are cut into four blocks of 16. With three errors at least one block has none: it is a key as it stands;
* the other 48 bits are two segments of 24. Of three errors at most one falls into one of the two. The first 23
  bits of a segment are decoded with the perfect (23,12) Golay code, after flipping none or each one of the bits. Two
  segments at distance 1 or 0 are in each other's ball, so they share a codeword index; a segment has at most six;
* a key is (which block and segment, the block's 16 bits, the 12-bit index): 8 x about 5.3 keys for each distinct
  fingerprint. Rows meet on the key, and every link is verified on all 64 bits.

Only distinct fingerprints take part; exact copies join by their fingerprint afterwards. Within a key a spanning
forest of the verified links is emitted, not all pairs; keys with over GROUP fingerprints are cut into pairs of chunks,
each chunk pair being a group of its own, so that no task holds an unbounded group and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, flat, forget, longs, slices, with_text_hash, written
from .graph import connected_components, keep_least
from .words import LOWER, U, find_words, joined

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of one key that a task compares at once.
GROUP = 2048
#: Shingles after which the 16-bit lanes that count bits are emptied.
_LANE = 60_000
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

_spread = np.zeros((256, 2), U)  # the bits of a byte, each in a lane of 16 bits
for _b in range(8):
    _spread[:, _b // 4] |= ((np.arange(256).astype(U) >> U(_b)) & U(1)) << U(16 * (_b % 4))


# ---- fingerprints


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of h that begins at starts, how many have each bit set."""
    lanes = _spread[h.astype("<u8").view(np.uint8).reshape(-1, 8)].reshape(-1, 16)
    ends = np.append(starts[1:], len(h))
    n = -(-(ends - starts) // _LANE)
    first = np.repeat(np.cumsum(n) - n, n)
    cuts = np.repeat(starts, n) + (np.arange(n.sum()) - first) * _LANE
    sums = np.add.reduceat(lanes, cuts, axis=0)
    counts = ((sums[:, :, None] >> (U(16) * np.arange(4).astype(U))) & U(0xFFFF)).reshape(-1, 64).astype(np.int64)
    return np.add.reduceat(counts, np.cumsum(n) - n, axis=0)


def fingerprints(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    starts, ends, first = find_words(raw, offs)
    out = np.zeros(len(offs) - 1, U)
    count = np.diff(first)
    if not len(starts):
        return out
    data, a, b = joined(LOWER[raw], starts, ends)
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    some = np.flatnonzero(shingles)
    n = shingles[some]
    begins = np.cumsum(n) - n
    word = np.repeat(first[some] - begins, n) + np.arange(n.sum())
    until = np.minimum(word + SHINGLE, np.repeat(first[some + 1], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[x:y], SEED) for x, y in zip(a[word].tolist(), b[until].tolist(), strict=True)), U, len(word))
    bits = 2 * _bit_counts(h, begins) > n[:, None]
    out[some] = (bits.astype(U) << np.arange(64).astype(U)).sum(axis=1)
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """id (doc_id), t (hash of the text) and fp (the fingerprint as a signed long) of every row. A null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in slices(batches):
            fp = fingerprints(*flat(col(x, "text")))
            yield pa.RecordBatch.from_arrays([col(x, "id"), col(x, "t"), pa.array(fp.view(np.int64))], ["id", "t", "fp"])

    return with_text_hash(docs).mapInArrow(run, "id long, t long, fp long")


# ---- Golay keys


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, _GENERATOR << (bit - 11), 0)
    return v


def _corrections() -> np.ndarray:
    """The error of weight 3 or less that each of the 2048 syndromes stands for: the code is perfect."""
    bit = [1 << k for k in range(23)]
    errors = [0, *bit] + [bit[a] | bit[b] for a in range(23) for b in range(a)] + [bit[a] | bit[b] | bit[c] for a in range(23) for b in range(a) for c in range(b)]
    errors = np.array(errors, np.int64)
    out = np.zeros(2048, np.int64)
    out[_remainder(errors)] = errors
    return out


_correction: np.ndarray | None = None


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit vector."""
    global _correction
    if _correction is None:
        _correction = _corrections()
    return (v ^ _correction[_remainder(v)]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, key) for all distinct keys of each fingerprint."""
    rows, keys = [], []
    flips = np.array([0, *(1 << k for k in range(23))], np.int64)
    for block in range(4):
        exact = ((fp >> U(16 * block)) & U(0xFFFF)).astype(np.int64)
        low, high = fp & U((1 << 16 * block) - 1), (fp >> U(16 * block)) >> U(16)
        rest = low | (high << U(16 * block))
        for half in range(2):
            segment = ((rest >> U(24 * half)) & U(0x7FFFFF)).astype(np.int64)
            index = np.sort(codeword_index((segment[:, None] ^ flips).ravel()).reshape(-1, 24), axis=1)
            new = np.ones(index.shape, bool)
            new[:, 1:] = index[:, 1:] != index[:, :-1]
            r, c = np.nonzero(new)
            rows.append(r)
            keys.append(((2 * block + half) << 40) | (exact[r] << 12) | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


# ---- links


def _forest(fp: np.ndarray, node: np.ndarray, left: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of a group. left: if over 0, only links between the first so many rows and the others."""
    n = len(fp)
    seen, out = np.zeros(n, bool), []
    side = np.arange(n) < left
    for root in range(n):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            x = queue.pop()
            near = ~seen & (np.bitwise_count(fp ^ fp[x]) <= RADIUS)
            if left:
                near &= side != side[x]
            for y in np.flatnonzero(near).tolist():
                seen[y] = True
                queue.append(y)
                out.append((int(node[x]), int(node[y])))
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, side), all of a group in one partition: verified edges."""
    rest: tuple[np.ndarray, ...] | None = None

    def edges(g: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sizes = np.diff(np.append(begins, len(g)))
        size = np.repeat(sizes, sizes)
        cut = np.repeat(np.maximum.reduceat(side, begins), sizes) > 0 if len(g) else side > 0
        pairs = [np.empty((0, 2), np.int64)]
        small = np.flatnonzero((size > 1) & (size <= 8) & ~cut)
        for lag in range(1, 8):
            i = small[small + lag < len(g)]
            i = i[(g[i] == g[i + lag]) & (np.bitwise_count(fp[i] ^ fp[i + lag]) <= RADIUS)]
            pairs.append(np.stack([node[i], node[i + lag]], axis=1))
        for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            if n > 8 or cut[b]:
                left = int((side[b : b + n] == 1).sum())
                if found := _forest(fp[b : b + n], node[b : b + n], left):
                    pairs.append(np.array(found, np.int64))
        p = np.sort(np.concatenate(pairs), axis=1)
        p = np.unique(p, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    for x in batches:
        if not x.num_rows:
            continue
        now = (longs(col(x, "g"), 0), longs(col(x, "side"), 0), longs(col(x, "fp"), 0).view(U), longs(col(x, "node"), 0))
        if rest is not None:
            now = tuple(np.concatenate(p) for p in zip(rest, now, strict=True))
        last = int(np.searchsorted(now[0], now[0][-1]))
        rest = tuple(v[last:] for v in now)
        if last:
            yield edges(*(v[:last] for v in now))
    if rest is not None:
        yield edges(*rest)


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that join the same fingerprints as all links of `distinct` (fp long, node long: distinct both)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 4096):
                part = x.slice(at, 4096)
                fp, node = longs(col(part, "fp"), 0), col(part, "node")
                rows, key = golay_keys(fp.view(U))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows]), node.take(pa.array(rows))], ["g", "fp", "node"])

    keyed = distinct.select("fp", "node").mapInArrow(keys, "g long, fp long, node long")
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("g")))
    whole = sized.where(f"n between 2 and {group}").select("g", F.lit(0).alias("side"), "fp", "node")
    near = whole.sortWithinPartitions("g").mapInArrow(_link, "a long, b long")
    chunks = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # chunk pairs (i, j) with i < j; a chunk's own links are in (i, i)
    split = sized.where(f"n > {group}").select("g", "fp", "node", own.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
    split = split.select(F.xxhash64("g", F.least("c", "o"), F.greatest("c", "o")).alias("g"), F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), "fp", "node")
    far = split.repartition("g").sortWithinPartitions("g", "side").mapInArrow(_link, "a long, b long")
    return near.unionByName(far).distinct()


def _components(docs: DataFrame) -> DataFrame:
    """id, t (hash of the text), fp, component (a fingerprint of it) and component_id of every row."""
    prints = written(with_fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = connected_components(links(distinct.select("fp", F.col("fp").alias("node"))))
    of = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(of.select("fp", "component").join(least, "component"), "fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id reachable through links) of every row.

    Nodes are fingerprints: null and blank texts share fingerprint zero and link like any other, repeated rows stay as many rows, and rows
    of one doc_id with several texts go each by its own fingerprint (a shared doc_id is no link). A null doc_id cannot name a
    component: such rows get the component of their fingerprint, which is null if no row of it has a doc_id. Further columns of
    docs are not read. An empty table gives no rows.
    """
    return _components(docs).select(F.col("id").alias("doc_id"), "fp", "component_id")


def op7(spark, docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint as 16 lowercase hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: see graph.keep_least."""
    return keep_least(docs, _components(docs))
