"""Predicates: optional filters joined by AND, metadata trees, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RANGES = {"$gte": lambda c, v: c >= v, "$gt": lambda c, v: c > v, "$lte": lambda c, v: c <= v, "$lt": lambda c, v: c < v, "$eq": lambda c, v: c == v}


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are there, joined by AND; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def where_tree(tree: dict) -> Column:
    """A filter from a tree of $and, $or, $eq, $ne, $gt, $gte, $lt, $lte over columns. A missing value fails every test but $ne. Plain comparisons, so it reaches the scan."""
    parts = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, map(where_tree, value)))
        elif isinstance(value, dict):
            for op, operand in value.items():
                c, v = F.col(key), F.lit(operand)
                parts.append(~c.eqNullSafe(v) if op == "$ne" else _RANGES[op](c, v))
        else:
            parts.append(F.col(key) == F.lit(value))
    return all_of(*parts)


def since(day: Column, as_of: Column, days: int) -> Column | None:
    """No filter for 0 days or fewer."""
    return day >= F.date_sub(as_of, days) if days > 0 else None


def sector_filter(sector: Column, wanted: str) -> Column:
    """A sector by name; telecom has two."""
    return F.lower(sector).isin("telecom", "telecom-service") if wanted.lower() == "telecom" else F.lower(sector) == wanted.lower()


def period_types(kind: str) -> list[str]:
    return ["annual"] if kind == "annual" else ["quarterly", "financial_results"]


def capped_value(value: Column, genuine: Column, most: float = 500.0) -> Column:
    """A value beyond the cap counts only from a genuine order."""
    return F.when(~F.coalesce(genuine, F.lit(False)) & (value > most), None).otherwise(value)


def select_only(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Runs a query that begins with SELECT; anything else is refused."""
    if not text.lstrip().upper().startswith("SELECT"):
        raise ValueError("only SELECT is allowed")
    return spark.sql(text, **tables)
