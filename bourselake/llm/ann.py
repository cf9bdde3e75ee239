"""Approximate search by largest inner product: inverted lists, scanned by adaptive dimensions.

* Copies: of vectors that are equal in all components only the k + 1 smallest vec_ids can be among anyone's k nearest, as ties go to
  the smaller id. No others are candidates; they still are queries. So one vector that a third of all rows share is no hot list.
* Lists: k-means centroids of a bounded sample; every vector goes to its nearest centroid's list. There is a list for VECTORS_A_LIST
  vectors, up to MOST_LISTS (their centroids are broadcast). A query probes the lists whose centroids have the largest inner product
  with it, until they hold ENOUGH vectors and are as many as the sample says: so many that TARGET of the nearest neighbours of sample
  queries within the sample are in them. A sample of a share f stands for the k nearest with its own k * f nearest, so the share of
  lists that is probed falls as the table grows and neighbours come closer.
* Scan: vectors are rotated at random, once, so that any columns are a fair sample of a distance. Columns are read in blocks: FIRST, which
  a matrix product reads for all pairs, then BLOCK by BLOCK for the pairs left. After d of D columns, the distance to a candidate is
  estimated as D / d times its part so far; the hypothesis that the candidate still reaches the query's threshold is rejected where
  that exceeds the threshold's distance times (1 + EPSILON / sqrt(d)) ** 2. Rejected candidates are read no further. An inner
  product p means the squared distance |q|^2 + |x|^2 - 2 p.
* Threshold: the query's K-th best among a bounded sample. Those K are in the result's pool themselves, so a query always finds K.
* What survives is scored in double precision on the original vectors.

A list is cut into chunks of CHUNK vectors and its queries into blocks of QUERIES, whatever its size; each chunk meets each block of
queries in a group of its own, in strips of STRIP queries, so that the pairs at hand are bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import col, release_memory, written

K, FIRST, BLOCK, EPSILON = 20, 32, 16, 1.8
#: The sample on the driver: rows and bytes at most; rows of it that thresholds come from, and that are queries for the number of lists.
SAMPLE, SAMPLE_BYTES, THRESHOLD_SAMPLE, TRIALS = 20_000, 32 << 20, 4_096, 512
VECTORS_A_LIST, MOST_LISTS = 400, 8_192
TARGET, ENOUGH = 0.95, 1_000
CHUNK, QUERIES, STRIP = 2_048, 1_024, 128


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (single components stay single, others are double) of all vectors that take part: no null, zero or non-finite ones, none without an id."""
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding").cast("array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)


def _matrix(values: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kmeans(x: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centers = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        full = count > 0
        centers[full] = sums[full] / count[full, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centers.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


def scan(q: np.ndarray, thresholds: np.ndarray, x: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of the pairs of rotated rows that no test has abandoned."""
    width = x.shape[1]
    qq, xx = (q**2).sum(axis=1), (x**2).sum(axis=1)
    # what the squared distance may be for the pair to reach the threshold, less |x|^2; single precision gets some room
    room = qq - 2 * thresholds.astype(np.float32) + np.float32(1e-4) * (1 + qq)
    done = min(FIRST, width)
    slack = np.float32((1 + epsilon / np.sqrt(done)) ** 2 if done < width else 1.0)
    a, b = q[:, :done], x[:, :done]
    grow = np.float32(width / done)
    # part * grow <= (room + xx) * slack, with part = |a|^2 + |b|^2 - 2 a.b
    found = a @ b.T
    found *= -2 * grow
    found += (grow * (a**2).sum(axis=1) - slack * room)[:, None]
    i, j = np.nonzero(found <= (slack * (xx * np.float32(1 + 1e-4)) - grow * (b**2).sum(axis=1))[None])
    part = ((a[i] - b[j]) ** 2).sum(axis=1)
    while done < width:
        cut = slice(done, min(done + BLOCK, width))
        part += ((q[i, cut] - x[j, cut]) ** 2).sum(axis=1)
        done = cut.stop
        slack = np.float32((1 + epsilon / np.sqrt(done)) ** 2 if done < width else 1.0)
        keep = part * np.float32(width / done) <= (room[i] + xx[j] * np.float32(1 + 1e-4)) * slack
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def lists_to_probe(known: np.ndarray, centers: np.ndarray, k: int, total: int, target: float) -> int:
    """How many lists a query must probe so that `target` of the nearest neighbours of the sample's first rows, within the sample, are in them."""
    near = max(1, round(k * len(known) / max(total, 1)))
    own, needed = nearest(known, centers), []
    for at in range(0, min(TRIALS, len(known)), 64):
        q = known[at : at + 64]
        s = q @ known.T
        s[np.arange(len(q)), at + np.arange(len(q))] = -np.inf
        best = np.argpartition(-s, min(near, s.shape[1] - 1), axis=1)[:, :near]
        place = np.argsort(np.argsort(-(q @ centers.T), axis=1, kind="stable"), axis=1)
        needed.append(np.take_along_axis(place, own[best], axis=1).ravel())
    return 1 + int(np.quantile(np.concatenate(needed), target, method="higher")) if needed else 1


def search(vectors: DataFrame, every: int = 20, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id divisible by `every`) its k nearest found.

    Vectors of another length than most of the sample take no part. Rows that repeat one vec_id and vector count once; of a vec_id with several
    vectors the nearest counts. An empty table, or a single vector, gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total, wide = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    many = int(max(100, min(SAMPLE, SAMPLE_BYTES // (8 * wide))))
    part = min(1.0, many / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < part * (1 << 20)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).toArrow()
    lengths = np.diff(sample["v"].combine_chunks().offsets.to_numpy()) if sample.num_rows else np.zeros(0, int)
    width = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    sample = sample.filter(pa.array(lengths == width))
    known, known_ids = _matrix(sample["v"], max(width, 1)).astype(np.float64), sample["vec_id"].to_numpy()
    n = int(np.clip(total // VECTORS_A_LIST, 1, MOST_LISTS))
    centers = kmeans(known, n) if len(known) else np.zeros((1, max(width, 1)))
    least = lists_to_probe(known, centers, k, total, target)
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((max(width, 1), max(width, 1))))[0]
    some, some_ids = known[:THRESHOLD_SAMPLE], known_ids[:THRESHOLD_SAMPLE]
    setup = spark.sparkContext.broadcast((centers, rotation, some, some_ids))
    rows = rows.where(F.size("v") == width).distinct()
    kind = rows.schema["v"].dataType.simpleString()

    def turned(x: np.ndarray) -> pa.Array:
        r = (x @ setup.value[1]).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * width), pa.array(r.ravel()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            m = _matrix(col(x, "v"), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([col(x, "vec_id"), col(x, "v"), turned(m), pa.array(nearest(m, setup.value[0]), pa.int32())], ["vec_id", "v", "r", "list"])

    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    placed = written(candidates.mapInArrow(place, f"vec_id long, v {kind}, r array<float>, list int"), "ann-placed")
    sizes = dict(placed.groupBy("list").count().collect())  # MOST_LISTS rows at most
    held = np.array([sizes.get(i, 0) for i in range(len(centers))])
    size_of = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, _, some, ids = setup.value
        many = size_of.value
        for x in batches:
            for at in range(0, x.num_rows, 512):
                part = x.slice(at, 512)
                q, own = _matrix(col(part, "v"), width).astype(np.float64), col(part, "vec_id").to_numpy()
                order = np.argsort(-(q @ centers.T), axis=1, kind="stable")
                near = q @ some.T
                near[own[:, None] == ids[None]] = -np.inf
                out = []
                for i in range(len(q)):
                    stop = max(least, int(np.searchsorted(np.cumsum(many[order[i]]), ENOUGH)) + 1)
                    # exact scores of the sample's best
                    close = np.flatnonzero(near[i] >= np.partition(near[i], -min(k, len(ids)))[-min(k, len(ids))] - 1e-9)
                    close = close[np.isfinite(near[i, close])]
                    s = dots(np.broadcast_to(q[i], (len(close), width)), some[close])
                    best = top(s, ids[close], k)
                    low = float(s[best[-1]]) if len(best) == k else -np.inf
                    found = [(int(ids[close[b]]), float(s[b])) for b in best]
                    lists = [int(c) for c in order[i, :stop] if many[c]]
                    out.append((lists, low, [f[0] for f in found], [f[1] for f in found]))
                lists, low, f, s = (list(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([col(part, "vec_id"), col(part, "v"), turned(q), pa.array(lists, pa.list_(pa.int32())), pa.array(low, pa.float64()), pa.array(f, pa.list_(pa.int64())), pa.array(s, pa.list_(pa.float64()))], ["query_id", "v", "r", "lists", "low", "f", "s"])

    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(probe, f"query_id long, v {kind}, r array<float>, lists array<int>, low double, f array<long>, s array<double>")
    queries = written(queries, "ann-queries")
    asked = queries.select("query_id", "v", "r", "low", F.explode("lists").alias("list"))
    loads = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    chunks = spark.createDataFrame([(int(c), int(-(-m // CHUNK))) for c, m in enumerate(held) if m], "list int, chunks int").join(loads, "list")
    # one row for each list: bounded by MOST_LISTS
    chunks = F.broadcast(chunks)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(chunks, "list").select("vec_id", "v", "r", "list", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), each("blocks").alias("block"))
    right = asked.join(chunks, "list").select("query_id", "v", "r", "low", "list", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), each("chunks").alias("chunk"))

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if vectors.num_rows and queries.num_rows:
            ids, asked_by = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            x, r, q, t = (_matrix(c, width) for c in (vectors["v"], vectors["r"], queries["v"], queries["r"]))
            low = queries["low"].to_numpy()
            low = np.where(np.isfinite(low), low, -1e30)
            for at in range(0, len(q), STRIP):
                i, j = scan(t[at : at + STRIP], low[at : at + STRIP], r)
                i += at
                other = ids[j] != asked_by[i]
                i, j = i[other], j[other]
                s = np.concatenate([np.empty(0), *(dots(q[i[b : b + 65536]].astype(np.float64), x[j[b : b + 65536]].astype(np.float64)) for b in range(0, len(i), 65536))])
                order = np.lexsort((ids[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((asked_by[i[keep]], ids[j[keep]], s[keep]))
            release_memory()
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    group = ["list", "chunk", "block"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, "query_id long, vec_id long, score double")
    pool = found.unionByName(queries.select("query_id", F.explode(F.arrays_zip("f", "s")).alias("x")).select("query_id", F.col("x.f").alias("vec_id"), F.col("x.s").alias("score")))
    # one score for each vec_id: a pair that came both ways counts once, and of repeated ids the nearest vector counts
    pool = pool.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pool.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
