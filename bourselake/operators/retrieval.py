"""Retrieval as DataFrame operators: BM25, exact vector search, rank fusion, heuristic re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import half_up, jaccard
from ..functions.rules import RERANK
from .filters import all_of
from .ranking import with_rank

TOKEN = "([a-z0-9]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)


def mixed_tokens(text: Column) -> Column:
    """Runs of letters, digits and &, lower-cased, and each again as it stands where that differs."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9&]+)"), 1)
    return F.flatten(F.transform(found, lambda x: F.when(F.lower(x) == x, F.array(x)).otherwise(F.array(F.lower(x), x))))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, tf, length (tokens in the document): write it once and search it often."""
    listed = docs.select(key, tokens(F.col(text)).alias("_t")).withColumn("length", F.size("_t"))
    return listed.select(key, "length", F.explode("_t").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def write_index(docs: DataFrame, key: str, text: str, path: str, parts: int = 64) -> None:
    """Postings in files by token hash, sorted by token within: a search reads the row groups of its terms."""
    found = postings(docs, key, text).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))
    found.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str], parts: int = 64) -> DataFrame:
    """The postings of some terms; both filters reach the scan."""
    wanted = spark.createDataFrame([(t,) for t in terms], "token string").select(F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int").alias("b"))
    buckets = [r.b for r in wanted.distinct().collect()]  # one row for each term
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("token").isin(terms)).drop("bucket")


def term_counts(docs: DataFrame, key: str, text: str, terms: list[str], tokenise: Callable[[Column], Column] = tokens) -> DataFrame:
    """key, length, tf (array: how often each of the terms is there). One pass over the texts; nothing is exploded or shuffled."""
    listed = docs.select(key, tokenise(F.col(text)).alias("_t"))
    count = lambda t: F.size(F.filter("_t", lambda x: x == F.lit(t)))
    return listed.select(key, F.size("_t").alias("length"), F.array(*map(count, terms)).alias("tf")).where("length > 0")


#: What a term is worth, from N (documents) and df (those with the term).
IDF = {
    "smooth": lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5)),
    "floored": lambda n, df: F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6)),
    "okapi": lambda n, df: F.log((n - df + 0.5) / (df + 0.5)),
}


def bm25(counts: DataFrame, key: str, n_terms: int, k1: float = 1.2, b: float = 0.75, idf: str = "smooth", least: Column | float | None = None, match_all: bool = False) -> DataFrame:
    """key and score of documents with any of the terms (or all), from term_counts.

    idf: a name of IDF; with `least`, a term whose idf is negative is worth that instead. N, the mean length and the document frequencies
    are one row, which is broadcast.
    """
    df = [F.count_if(F.col("tf")[i] > 0).alias(f"_df{i}") for i in range(n_terms)]
    corpus = counts.agg(F.count("*").alias("_n"), F.avg("length").alias("_mean"), *df)
    rows = counts.crossJoin(F.broadcast(corpus))
    score = F.lit(0.0)
    for i in range(n_terms):
        worth = IDF[idf](F.col("_n"), F.col(f"_df{i}"))
        if least is not None:
            worth = F.when(worth < 0, least).otherwise(worth)
        tf = F.col("tf")[i]
        score = score + F.when(tf > 0, worth * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("_mean")))).otherwise(0.0)
    hit = sum(((F.col("tf")[i] > 0).cast("int") for i in range(n_terms)), F.lit(0))
    return rows.where(hit == n_terms if match_all else hit > 0).select(key, score.alias("score"))


def mean_idf(docs: DataFrame, key: str, text: str, tokenise: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row: the mean Okapi idf over the whole vocabulary. Built with an index, not with a search: it counts every token."""
    listed = docs.select(F.array_distinct(tokenise(F.col(text))).alias("_t"), F.lit(1).alias("_one")).where(F.size("_t") > 0)
    df = listed.select(F.explode("_t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(listed.agg(F.count("*").alias("n")))).agg(F.avg(IDF["okapi"](F.col("n"), F.col("df"))).alias("mean_idf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, key: str, vector: str, query: list[float], n: int, where: Column | None = None) -> DataFrame:
    """Exact: key and distance (four digits) of the n nearest by cosine, filtered before."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, half_up(cosine_distance(F.col(vector), q), 4).alias("distance")).orderBy("distance", key).limit(n)


def rrf(ranked: list[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """key, score and n_sources from frames of (key, rank from 1) with a weight each: the sum of weight / (k + rank)."""
    parts = None
    for frame, weight in ranked:
        part = frame.select(key, (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum("part").alias("score"), F.count("*").alias("n_sources"))


def hybrid(lexical: DataFrame, dense: DataFrame, key: str, n: int, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The n best of both lists by rank fusion; distance 1 where only the words were found."""
    left = with_rank(lexical, [], [F.desc("score"), F.col(key)])
    right = with_rank(dense, [], [F.col("distance"), F.col(key)])
    fused = rrf([(left, weights[0]), (right, weights[1])], key)
    return fused.join(dense.select(key, "distance"), key, "left").withColumn("distance", F.coalesce("distance", F.lit(1.0))).orderBy(F.desc("score"), key).limit(n)


def post_filters(fused: DataFrame, min_score: int | None = None, day: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Filters after fusion: a least score, a date's prefix, symbols in any case; those that are not set do nothing."""
    conditions = [F.col("score") >= min_score if min_score is not None else None, F.col("broadcast_date").cast("string").startswith(day) if day else None, F.upper("symbol").isin([s.upper() for s in symbols]) if symbols else None]
    return fused.where(all_of(*conditions))


def rerank(candidates: DataFrame, query_words: list[str], as_of: Column, order_query: bool, most_value: float | None = None) -> DataFrame:
    """candidates (base, text_words, score, day, n_sources, order_value) with `ranked`: the base times one and the boosts."""
    q = F.array(*[F.lit(w) for w in query_words])
    keyword = RERANK["keyword"] * jaccard(q, F.col("text_words"))
    points = RERANK["score"] * F.least(F.col("score") / 13.0, F.lit(1.0))
    recent = RERANK["recency"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.datediff(as_of, "day") / RERANK["days"]))
    diverse = F.when(F.col("n_sources") > 1, RERANK["diversity"]).otherwise(0.0)
    top = candidates.agg(F.max("order_value").alias("_top")).select(F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0).alias("_top"))
    value = F.when(F.lit(order_query) & (F.col("order_value") > 0), RERANK["value"] * F.least(F.col("order_value") / F.col("_top"), F.lit(1.0))).otherwise(0.0)
    return candidates.join(F.broadcast(top)).withColumn("ranked", F.col("base") * (1 + keyword + points + recent + diverse + value)).drop("_top")


def ranking_metrics(retrieved: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """case_id, hit, mrr, ndcg at k. retrieved: case_id, item, rank from 1; relevant: case_id, item."""
    truth = relevant.distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    good = retrieved.join(relevant.distinct(), ["case_id", "item"], "left_semi")
    gain = good.where(F.col("rank") <= k).groupBy("case_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.lit(1).alias("hit"))
    first = good.groupBy("case_id").agg((1 / F.min("rank")).alias("mrr"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = F.lit(0.0)
    return truth.join(gain, "case_id", "left").join(first, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("mrr", zero).alias("mrr"), (F.coalesce("dcg", zero) / ideal).alias("ndcg"))
