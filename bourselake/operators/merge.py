"""Write semantics over tables of rows: each gives the new content of the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import date_int
from .ranking import first_n


def insert_ignore(target: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """target and the batch's rows of new keys, of each key the first. Rows with a null in the key are always new, as in SQL's UNIQUE."""
    whole = " and ".join(f"{k} is not null" for k in key)
    fresh = first_n(batch.where(whole), key, order).join(target.select(*key), key, "left_anti").select(*batch.columns)
    return target.unionByName(fresh).unionByName(batch.where(f"not ({whole})"))


def upsert(target: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """target with the batch's rows in place of those of the same key; of several in the batch the last by `order`."""
    last = first_n(batch, key, [c.desc() for c in order])
    return target.join(last.select(*key), key, "left_anti").select(*target.columns).unionByName(last.select(*target.columns))


def replace_groups(target: DataFrame, batch: DataFrame, group: list[str]) -> DataFrame:
    """target without any row of the batch's groups, and the batch."""
    return target.join(batch.select(*group).distinct(), group, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def suffixed(batch: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Ids that repeat within the batch get _1, _2, ... from their second on."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return batch.withColumn("_nth", nth).withColumn(name, F.when(F.col("_nth") > 0, F.concat(F.col(name), F.lit("_"), F.col("_nth").cast("string"))).otherwise(F.col(name))).drop("_nth")


def update_or_insert(target: DataFrame, batch: DataFrame, url: str, key: list[str], order: Column) -> DataFrame:
    """target with the batch's rows (of each url the last by `order`) in place of the rows of their urls. Of rows that then share a
    key the target's stays, then the batch's first by `order`: an update whose key is another row's loses its row."""
    last = first_n(batch, [url], [order.desc()])
    kept = target.join(last.select(url), url, "left_anti").withColumns({"_fresh": F.lit(0), "_nth": F.lit(0)})
    both = kept.select(*target.columns, "_fresh", "_nth").unionByName(last.withColumns({"_fresh": F.lit(1), "_nth": order}).select(*target.columns, "_fresh", "_nth"))
    return first_n(both, key, [F.col("_fresh"), F.col("_nth")]).drop("_fresh", "_nth")


def with_dates(rows: DataFrame, stamp: str = "broadcast_dt") -> DataFrame:
    """Rows without date_int get date_str and date_int from the stamp's first ten characters, and defaults for what they lack; a second run changes nothing."""
    new, text = F.col("date_int").isNull(), F.substring(F.coalesce(stamp, F.lit("")), 1, 10)
    text = F.when(F.length(text) == 10, text).otherwise("")
    fill = lambda c, default: F.when(new, F.coalesce(c, F.lit(default))).otherwise(F.col(c))
    made = {"date_str": F.when(new, text).otherwise(F.col("date_str")), "date_int": F.when(new, date_int(text)).otherwise(F.col("date_int"))}
    return rows.withColumns({**made, "sector_tags": fill("sector_tags", ""), "catalyst_type": fill("catalyst_type", "general")})


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with the patch's fields, where it has the key and a value."""
    fields = [c for c in patch.columns if c != key]
    new = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields}).drop(*(f"_new_{c}" for c in fields))
