"""A left join whose pairs of a key are many: the same rows as the plain join, and no task with all of a busy key."""

import random
from collections import Counter

from pyspark.sql import functions as F

from __spark_entry__ import queries
from bourselake.operators import joins


def test_busy_url_is_dealt_out(spark, tmp_path):
    orders = spark.range(9000).select((F.col("id") * 5000).alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("1998-06-01").cast("timestamp").alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 2).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("s").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = queries()["J4_orders_left_url"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 6000 * 9000 and max(r["count"] for r in tasks) < 0.75 * 6000 * 9000


def test_pieces_give_the_plain_join(spark):
    rng = random.Random(4)
    keys = [None, "busy", "busy", "busy", "few", "left", "right"]
    lefts = [(i, k) for i in range(300) if (k := rng.choice(keys)) != "right"]
    rights = [(i if rng.random() < 0.9 else None, k, rng.choice([None, "x"])) for i in range(300) if (k := rng.choice(keys)) != "left"]
    left, right = spark.createDataFrame(lefts, "id long, k string"), spark.createDataFrame(rights, "said long, k string, subject string")
    plain = left.join(right, "k", "left")
    for piece in (1, 7, 4096):
        got = joins.left_in_pieces(left, right, "k", "id", "said", piece)
        assert got.columns == plain.columns and Counter(got.collect()) == Counter(plain.collect())
    # Most pieces of the busy key have no right row.
    one = right.where("k = 'busy'").withColumn("said", F.lit(1).cast("long"))
    assert Counter(joins.left_in_pieces(left, one, "k", "id", "said", 2).collect()) == Counter(left.join(one, "k", "left").collect())
    assert joins.left_in_pieces(left, right.limit(0), "k", "id", "said", 2).count() == len(lefts)
