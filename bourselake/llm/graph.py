"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, together, written


def connected_components(edges: DataFrame, rounds: int = 40, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, component) for each node of the edges (a long, b long): component is the smallest node reachable.

    Alternating large-star and small-star steps: each step keeps at most the edges it was given, hangs them on the
    smallest neighbour, and is written to the shared folder, so the lineage stays short. Loops and null ends
    are ignored; an empty edge list gives no rows. No edge reaches the driver, only a count and a sum of hashes.
    keep writes the last step's edges, which the result reads; those of all steps before are deleted.
    """
    with Scratch(edges.sparkSession, "edges") as steps:
        return _stars(edges, rounds, steps.written, keep)


def _stars(edges: DataFrame, rounds: int, written: Callable[[DataFrame, str], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    now = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = written(_small_star(_large_star(now)), "edges")
        last, seen = seen, _signature(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    now = keep(now, "components")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than u goes to the smallest neighbour of u (or u)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and each smaller neighbour of u go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def keep_least(docs: DataFrame, of: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. of: id, t and component of every row (see with_text_hash).

    Of several rows of that doc_id the one with the smaller hash of its text stays, of rows that repeat that one, the smaller hash of all
    else. Rows without a doc_id all stay. Everything adds up before it is shuffled, so copies in masses are no burden.
    """
    chosen = of.where("id is not null").groupBy("component").agg(F.min(F.struct("id", "t")).alias("x")).select("x.id", "x.t")
    rows = apart(docs).withColumn("t", F.xxhash64("text"))
    kept = rows.where("id is not null").join(chosen, ["id", "t"], "left_semi").groupBy("id", "t").agg(F.min_by(F.struct("text", "row"), F.xxhash64("row")).alias("x"))
    return together(kept.select("x.text", "x.row").unionByName(rows.where("id is null").select("text", "row")), docs.columns)
