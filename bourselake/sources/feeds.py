"""Sources of the announcement feed: CSV with any known header, landed JSON, breakout scans, evaluation fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules


def header_map(headers: list[str]) -> dict[str, str]:
    """field -> header: the first of a field's candidates that is there, whatever its case and blanks. `subject` must be."""
    low = {}
    for h in headers:
        low.setdefault(h.lstrip("﻿").lower().strip(), h)
    found = {field: next((low[c] for c in candidates if c in low), None) for field, candidates in rules.CSV_HEADERS.items()}
    if found["subject"] is None:
        raise ValueError(f"no subject column among {headers}")
    return {k: v for k, v in found.items() if v is not None}


def announcements_csv(spark: SparkSession, path: str, guardrails: bool = True) -> DataFrame:
    """symbol, company, subject, details, broadcast_raw, broadcast_ts, attachment; quoted fields may hold line ends."""
    return canonical(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), guardrails)


def csv_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of CSV files as a stream: columns as in the files that are there now, all of them text."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    return spark.readStream.options(**options).schema(spark.read.options(**options).csv(path).schema).csv(path)


def canonical(raw: DataFrame, guardrails: bool = True) -> DataFrame:
    """A feed's own columns as the canonical ones; missing fields are empty. Without guardrails: symbols and long texts as they are."""
    found = header_map(raw.columns)
    field = lambda name: F.trim(F.coalesce(F.col(f"`{found[name]}`"), F.lit(""))) if name in found else F.lit("")
    details, subject, attachment, symbol = field("details"), field("subject"), field("attachment"), field("symbol")
    if guardrails:
        details, subject = C.guarded(details, subject)
        attachment = F.when(attachment.startswith("http") | attachment.startswith("/"), attachment).otherwise("")
        symbol = F.upper(symbol)
    stamp = C.timestamp(field("datetime"))
    return raw.select(symbol.alias("symbol"), field("company").alias("company"), subject.alias("subject"), details.alias("details"), field("datetime").alias("broadcast_raw"), stamp.alias("broadcast_ts"), attachment.alias("attachment"))


def _first(*names: str) -> Column:
    """The first field that is there and not empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def announcements_json(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Landed exchange records: fallback chains for each field; an attachment that is no link gets the base URL."""
    names = ["bcastDt", "broadcast_date", "exchdisstime", "date", "attchmntFile", "attachment", "desc", "subject", "an_type", "attchmntText", "body", "details", "symbol", "sm_isin", "comp", "sm_name", "company"]
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).json(path)
    link, subject = _first("attchmntFile", "attachment"), _first("desc", "subject", "an_type")
    text = _first("attchmntText", "body", "details")
    return rows.select(
        _first("symbol", "sm_isin").alias("symbol"), _first("comp", "sm_name", "company").alias("company"), subject.alias("subject"), F.when(text == "", subject).otherwise(text).alias("details"),
        _first("bcastDt", "broadcast_date", "exchdisstime", "date").alias("broadcast_raw"), F.when((link == "") | link.startswith("http"), link).otherwise(F.concat(F.lit(base_url), link)).alias("attachment"),
    )


def breakouts_json(spark: SparkSession, path: str, day: str) -> DataFrame:
    """A landed scan: symbol, signal_date, close, per_chg, volume, company, cap."""
    rows = spark.read.schema("nsecode string, symbol string, close double, per_chg double, volume bigint, name string, mcap string").json(path)
    return rows.select(_first("nsecode", "symbol").alias("symbol"), F.lit(day).cast("date").alias("signal_date"), "close", "per_chg", "volume", F.coalesce("name", F.lit("")).alias("company"), C.cap_class(F.col("mcap"), C.number(F.col("mcap"))).alias("cap"))


def fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines, # lines and broken ones are passed over."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parsed = lines.select(F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("x")).select("x.*")
    return parsed.where("_broken is null").drop("_broken")


def cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """files, total_mb of a folder with all below it. binaryFile's content column is pruned, so only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("length").agg(F.count("*").alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / 1e6).alias("total_mb"))


def cache_key(url: Column) -> Column:
    """A filing's name in the cache, null for what is no link to a PDF."""
    fine = F.lower(url).startswith("http") & F.lower(url).endswith(".pdf")
    return F.when(fine, F.concat(F.substring(F.sha1(url), 1, 16), F.lit(".pdf")))
