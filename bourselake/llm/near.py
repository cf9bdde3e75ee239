"""Near-duplicates by exact Jaccard similarity of 5-word shingles: what the pipeline's stage keeps one of.

Links are pairs of documents whose sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more; every link is
verified on the sets themselves. Candidates come in three rounds, each of which skips what the rounds before have joined:

* SimHash: fingerprints of the same shingles within 3 bits, met through the Golay keys of `simhash`. This joins close copies
  by a spanning forest, so that large groups of them cost no pairs later.
* bands, stars: BANDS keys of ROWS min-hashes each; all rows of a key meet its smallest and its largest node.
* bands, rest: where a key still has several components, its nodes are compared by sketches of BINS minima each, in numpy, in
  chunks of GROUP nodes against each other; a pair counts in the first band that it shares. Of the pairs whose estimate is ESTIMATE or more a task passes on
  a spanning forest of the components it has met, the most similar pairs first: no more pairs than components, however large a group is. What is verified joins components,
  and the round is done again, with MORE times as many forests each time (the next one out of the pairs that are left), until no two
  components have a pair that has not been verified.

At similarity 0.8 SimHash differs in 15 % of bits, about 10 of 64: Golay keys that reach so far would be hundreds for each document,
with 12 bits a segment. A pair at similarity s meets in a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99997 at 0.8. A
sketch's estimate at 0.8 has a standard deviation of 0.025 at most (less for sets smaller than BINS, which it holds nearly whole),
so 0.7 is four of them away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, flat, forget, longs, slices, with_text_hash, written
from .graph import connected_components, keep_least
from .simhash import _bit_counts, links
from .words import _WORD, LOWER, U, _runs, find_words, mix, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Minima in a sketch, the least estimate of a candidate, and nodes of a key that are compared at once.
BINS, ESTIMATE, GROUP = 256, 0.7, 1024
#: Forests that a task passes on at first, and how many times more in each round after.
FIRST, MORE = 1, 32
_seeds = mix(np.arange(1, BANDS * ROWS + 1).astype(U))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, and where each text's begin (with the count of all at the end).

    A text of fewer words is one shingle; a blank one has none."""
    starts, ends, first = find_words(raw, offs)
    if not len(starts):
        return np.empty(0, U), np.zeros(len(offs), np.int64)
    words = word_hashes(LOWER[raw], starts, ends)
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    s = first[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    e = np.minimum(s + shingle, first[doc + 1])
    h = mix(_runs(words, s, e, _WORD) + (e - s).astype(U))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    return h[new], np.searchsorted(doc[new], np.arange(len(offs)))


def sketches(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each set its fingerprint, a 64-bit hash of the whole, BANDS keys, and a byte of the minimum in each of BINS ranges of a hash (0: none). An empty set has zeros."""
    n = len(begins) - 1
    fp, whole, bands, bins = np.zeros(n, U), np.zeros(n, U), np.zeros((n, BANDS), U), np.zeros((n, BINS), np.uint8)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        at = begins[some]
        bits = 2 * _bit_counts(h, at) > np.diff(begins)[some][:, None]
        fp[some] = (bits.astype(U) << np.arange(64).astype(U)).sum(axis=1)
        whole[some] = mix(np.add.reduceat(mix(h), at))
        for band in range(BANDS):
            key = np.full(len(some), U(band))
            for seed in _seeds[band * ROWS : (band + 1) * ROWS]:
                key = mix(key * U(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix(h ^ seed), at))
            bands[some, band] = key
        # sets are sorted: the first of a range is its minimum
        doc, place = np.repeat(np.arange(n), np.diff(begins)), (h >> U(56)).astype(np.int64)
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
        bins[doc[first], place[first]] = 1 + (mix(h[first]) % U(255)).astype(np.uint8)
    return fp, whole, bands, bins


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity of sets by their sketches (last axis)."""
    there = ((a > 0) | (b > 0)).sum(axis=-1)
    return ((a == b) & (a > 0)).sum(axis=-1) / np.maximum(there, 1)


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in slices(batches):
            h, begins = shingle_sets(*flat(col(x, "text")), shingle)
            fp, whole, bands, bins = sketches(h, begins)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(x.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
            arrays = [col(x, "id"), col(x, "t"), pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.diff(begins)), keys, pa.array([b.tobytes() for b in bins], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "t", "fp", "node", "size", "bands", "bins"])

    return texts.mapInArrow(run, "id long, t long, fp long, node long, size long, bands array<long>, bins binary")


class Forests:
    """Spanning forests over components, of pairs that come in portions: of each portion the first pairs that join what no pair of a forest has joined."""

    def __init__(self, most: int):
        self.parents: list[dict[int, int]] = [{} for _ in range(most)]

    @staticmethod
    def _root(parent: dict[int, int], x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def take(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
        """Which of the pairs (components a and b, in order of preference) are in one of the forests, and whether others are left."""
        taken, left = np.zeros(len(a), bool), np.arange(len(a))
        for parent in self.parents:
            if not len(left):
                break
            names, place = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
            roots, label = np.unique([self._root(parent, c) for c in names.tolist()], return_inverse=True)
            x, y = label[place[: len(left)]], label[place[len(left) :]]
            chosen = _spanning(x, y, len(roots))
            for p, q in zip(a[left[chosen]].tolist(), b[left[chosen]].tolist(), strict=True):
                p, q = self._root(parent, p), self._root(parent, q)
                parent[max(p, q)] = min(p, q)
            taken[left[chosen]] = True
            left = left[~chosen]
        return taken, len(left) > 0


def _spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The edges (x, y) of n nodes, in order of preference, that span what all of them connect: each tree takes its first edge outwards, until none has one."""
    label, live, chosen = np.arange(n), np.arange(len(x)), np.zeros(len(x), bool)
    while True:
        p, q = label[x[live]], label[y[live]]
        apart = p != q
        live, p, q = live[apart], p[apart], q[apart]
        if not len(live):
            return chosen
        first = np.full(n, len(x))
        np.minimum.at(first, p, live)
        np.minimum.at(first, q, live)
        pick = np.unique(first[first < len(x)])
        chosen[pick] = True
        up = {}
        for a, b in zip(label[x[pick]].tolist(), label[y[pick]].tolist(), strict=True):
            a, b = Forests._root(up, a), Forests._root(up, b)
            up[max(a, b)] = min(a, b)
        label = np.array([Forests._root(up, c) for c in range(n)])[label]


def _closest(similarity: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (g, side), all of a group in one partition: the pairs of `most` forests of their components, and in every portion's first row whether more pairs are left."""

    def fits(i: np.ndarray, j: np.ndarray, c: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (c[i] != c[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)

    def within(forests: Forests, g: np.ndarray, side: np.ndarray, node: np.ndarray, c: np.ndarray, size: np.ndarray, bins: np.ndarray, earlier: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sizes = np.diff(np.append(begins, len(g)))
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

        def take(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                e = estimates(bins[a], bins[b])
                near = np.flatnonzero(e >= ESTIMATE)
                near = near[~(earlier[a[near]] == earlier[b[near]]).any(axis=1)]
                pairs.append((a[near], b[near], e[near]))

        small = np.flatnonzero(np.repeat(sizes <= 8, sizes) & (side == 0))
        for lag in range(1, 8):
            i = small[small + lag < len(g)]
            i = i[(g[i] == g[i + lag])]
            i = i[fits(i, i + lag, c, size)]
            take(i, i + lag)
        for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            if n > 8 or side[b] > 0:
                left = int((side[b : b + n] == 1).sum()) if side[b] > 0 else 0
                others = np.arange(b + left, b + n)
                for x in range(b, b + left if left else b + n):
                    j = others if left else np.arange(x + 1, b + n)
                    i = np.full(len(j), x)
                    ok = fits(i, j, c, size)
                    take(i[ok], j[ok])
        i, j, e = (np.concatenate(v) for v in zip(*pairs, strict=True))
        order = np.argsort(-e, kind="stable")
        i, j = i[order], j[order]
        taken, more = forests.take(c[i], c[j])
        a, b = node[i[taken]], node[j[taken]]
        # a row without nodes tells of pairs that are left
        rows = [pa.array(np.append(v, 0), mask=np.append(np.zeros(len(v), bool), True)) for v in (np.minimum(a, b), np.maximum(a, b))]
        return pa.RecordBatch.from_arrays([*rows, pa.array(np.append(np.zeros(len(a), bool), more))], ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        forests = Forests(most)
        rest: tuple[np.ndarray, ...] | None = None
        for x in batches:
            if not x.num_rows:
                continue
            bins = np.frombuffer(b"".join(col(x, "bins").to_pylist()), np.uint8).reshape(-1, BINS)
            now = [longs(col(x, k), 0) for k in ("g", "side", "node", "c", "size")]
            now = (*now, bins, _padded(col(x, "earlier"), now[2]))
            if rest is not None:
                now = tuple(np.concatenate(p) for p in zip(rest, now, strict=True))
            last = int(np.searchsorted(now[0], now[0][-1]))
            rest = tuple(v[last:] for v in now)
            if last:
                yield within(forests, *(v[:last] for v in now))
        if rest is not None:
            yield within(forests, *rest)

    return run


def _padded(lists: pa.Array, fill: np.ndarray) -> np.ndarray:
    """The lists as rows of BANDS - 1 numbers, filled up with a number of each row's own, which equals no other row's."""
    out = np.repeat(fill[:, None], BANDS - 1, axis=1)
    n = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def _rest(ends: DataFrame, sketches_of: DataFrame, similarity: float, group: int, most: int = 1) -> DataFrame:
    """Candidates (a, b) among the nodes of keys that still have several components: `most` spanning forests of each task. more: whether there are others. ends: key, node, c, size; sketches_of: node, bins, bands."""
    open_ = ends.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key", "n")
    rows = ends.join(open_, "key").join(sketches_of, "node")
    chunks = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    # chunk pairs (i, j) with i < j; a chunk's own pairs are in (i, i)
    earlier = F.slice("bands", F.lit(1), (F.array_position("bands", F.col("key")) - 1).cast("int")).alias("earlier")
    split = rows.select("key", "node", "c", "size", "bins", earlier, own.alias("i"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
    side = F.when(F.col("i") == F.col("o"), 0).when(F.col("i") < F.col("o"), 1).otherwise(2)
    split = split.select(F.xxhash64("key", F.least("i", "o"), F.greatest("i", "o")).alias("g"), side.alias("side"), "node", "c", "size", "bins", "earlier")
    found = split.repartition("g").sortWithinPartitions("g", "side").mapInArrow(_closest(similarity, most), "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def _verified(pairs: DataFrame, texts: DataFrame, owners: DataFrame, shingle: int, similarity: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The pairs (a, b: nodes) that are as similar as asked, by their sets; keep writes them. owners: node and a row (id, t) that has its set."""
    with Scratch(pairs.sparkSession, "near-sets") as scratch:
        return keep(_by_sets(pairs, texts, owners, shingle, similarity, scratch.written), "links")


def _by_sets(pairs: DataFrame, texts: DataFrame, owners: DataFrame, shingle: int, similarity: float, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in slices(batches):
            h, begins = shingle_sets(*flat(col(x, "text")), shingle)
            yield pa.RecordBatch.from_arrays([col(x, "node"), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(h.view(np.int64)))], ["node", "h"])

    pairs = written(pairs, "near-candidates")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    of = owners.join(asked, "node", "left_semi")
    # one row for each node: of rows that repeat, any has the same set
    rows = texts.join(of, ["id", "t"]).select("node", "text").dropDuplicates(["node"])
    sets = written(rows.mapInArrow(run, "node long, h array<long>"), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum"))
    return common.where(F.col("n") >= F.lit(similarity) * (F.col("sum") - F.col("n")) - 1e-9).select("a", "b").distinct()


def _components(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """id, t, component (a node of it) and component_id of every row with a doc_id. Nodes are sets, named by a hash of the whole."""
    with Scratch(docs.sparkSession, "near") as scratch:
        return written(_grouped(with_text_hash(docs).where("id is not null"), shingle, similarity, scratch.written), "near-components")


def _grouped(texts: DataFrame, shingle: int, similarity: float, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    prints = written(_sketched(texts, shingle), "prints")
    least = F.min(F.struct("id", "t")).alias("x")
    nodes = written(prints.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("bins").alias("bins")), "nodes")
    owners = nodes.select("node", "x.id", "x.t")

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, texts, owners, shingle, similarity, written)

    prints_of = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(prints_of, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    close = links(prints_of.select("fp", F.col("rep").alias("node"))).where("a <> b").unionByName(same)
    found = verified(close.distinct())

    keyed = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("key"))
    many = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    keyed = written(keyed.join(many, "key"), "bands")

    def placed(edges: DataFrame) -> DataFrame:
        return keyed.join(connected_components(edges, keep=written), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")

    ends = placed(found).select("key", "node", "c", "size", "low", "high")
    lead = ends.where("node = low or node = high").select("key", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"))
    fits = F.least("sa", "size") >= F.lit(similarity) * F.greatest("sa", "size") - 1e-9
    stars = ends.join(lead, "key").where((F.col("c") != F.col("ca")) & fits).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    found = found.unionByName(verified(stars.distinct()))

    most, tried = FIRST, None
    while True:
        ends = written(placed(found).select("key", "node", "c", "size"), "rest")
        passed = written(_rest(ends, nodes.select("node", "bins", "bands"), similarity, GROUP, most), "passed")
        pairs = passed.where("a is not null").select("a", "b")
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        found = found.unionByName(verified(fresh))
        if passed.where("more").isEmpty():  # every pair of two components has been verified
            break
        tried, most = pairs, most * MORE

    of = owners.join(connected_components(found, keep=written), "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    named = of.groupBy("component").agg(F.min("id").alias("component_id"))
    return prints.select("id", "t", "node").join(of.select("node", "component").join(named, "component"), "node").drop("node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable through links) of every row that has a doc_id.

    Null and blank texts are alike. Rows that repeat stay as many rows; rows of one doc_id with several texts go each by its own text.
    Further columns of docs are not read. An empty table gives no rows.
    """
    return _components(docs, shingle, similarity).select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id: see graph.keep_least. Rows without a doc_id all stay."""
    return keep_least(docs, _components(docs, shingle, similarity))
