"""A question's way through the strategies: what it names comes from functions.questions, each strategy is a DataFrame of candidates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import questions
from .filters import all_of
from .ranking import merged_first, top
from .retrieval import post_filters

CANDIDATE = ["id", "symbol", "subject", "score", "day", "base", "sources"]


def ask(spark: SparkSession, text: str, as_of: dt.date) -> Row:
    """All that is read from one question."""
    return questions.read(spark.createDataFrame([(text, as_of)], "text string, as_of date"), "text", "as_of").first()


def has_themes(tags: Column, themes: list[str]) -> Column | None:
    """Every theme occurs in the tags, as a part of them; no condition without themes."""
    return all_of(*(tags.contains(t) for t in themes)) if themes else None


def structured(announcements: DataFrame, q: Row, n: int) -> DataFrame:
    """Best-scored announcements that pass every filter the question sets."""
    conditions = [
        F.col("symbol").isin(q.symbols) if q.symbols else None, F.col("broadcast_date") == F.lit(q.day).cast("date") if q.day else None,
        F.col("score") >= q.min_score if q.min_score is not None else None, F.col("order_value_cr") >= q.order_value if q.order_value is not None else None,
    ]
    return top(announcements.where(all_of(*conditions)), [F.desc("score"), F.desc("broadcast_date"), F.col("id")], n)


def financial(results: DataFrame, q: Row, n: int = 20) -> DataFrame:
    """Latest results of the symbols since the day: candidates of one score and one base."""
    conditions = [F.col("symbol").isin(q.symbols) if q.symbols else None, F.col("broadcast_date") >= F.lit(q.day).cast("date") if q.day else None]
    rows = top(results.where(all_of(*conditions)), [F.desc("broadcast_date"), F.col("symbol"), F.col("period")], n)
    return rows.select(
        F.concat(F.lit("fin_"), "symbol", F.lit("_"), "period").alias("id"), "symbol", F.concat(F.lit("Financial Results "), F.col("period")).alias("subject"),
        F.lit(8).alias("score"), F.col("broadcast_date").alias("day"), F.lit(0.5).alias("base"), F.array(F.lit("financial")).alias("sources"),
    )


def broker(q: Row, announcements: DataFrame, results: DataFrame, hybrid: Callable[[int], DataFrame], n: int = 10) -> DataFrame:
    """Candidates for a question by its intent.

    structured: filters alone. semantic: what the vectors found. financial: results. compound: both lists, announcements first.
    hybrid: everything. hybrid(n) gives id, base, sources; filters of the question apply to what was fused.
    """
    def fused() -> DataFrame:
        found = hybrid(4 * n).join(announcements, "id")
        found = post_filters(found, q.min_score, q.day, q.symbols or None)
        found = found.where(all_of(has_themes(F.col("tags"), q.themes))) if "tags" in found.columns else found
        return found.select(F.col("id").cast("string").alias("id"), "symbol", "subject", "score", F.col("broadcast_date").alias("day"), "base", "sources")

    if q.intent == "structured":
        rows = structured(announcements, q, 4 * n)
        return rows.select(F.col("id").cast("string").alias("id"), "symbol", "subject", "score", F.col("broadcast_date").alias("day"), (F.col("score") / 13.0).alias("base"), F.array(F.lit("sql")).alias("sources"))
    if q.intent == "financial":
        return financial(results, q)
    if q.intent == "semantic":
        return fused().where(F.array_contains("sources", "vector"))
    if q.intent == "compound":
        return merged_first([fused(), financial(results, q, n)], "id", [F.col("id")])
    return fused()
