"""First rows of groups, top rows of tables. Every order ends in a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def with_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def merged_first(frames: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """All frames on end, of each key only the row from the earliest frame."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f)
    return first_n(union, [key], [F.col("_source"), *order]).drop("_source")
