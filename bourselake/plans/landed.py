"""Sources over landed files: the views are written in the shapes that feeds have, read by the sources, and must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import feeds
from ..streaming import jobs
from .registry import Tables, query


def _landed(t: Tables, df: DataFrame, kind: str) -> str:
    path = f"{jobs.shared_folder(t.spark)}/landed-{kind}-{uuid.uuid4().hex}"
    writer = df.write
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)
    return path


def _feed(t: Tables) -> DataFrame:
    """Headers of the feed's second spelling; dates in its seven formats and one that is none."""
    formats = ["dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MMM-yyyy HH:mm", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyy-MM-dd"]
    stamps = [F.date_format("broadcast_ts", f) for f in formats] + [F.lit("soon")]
    raw = F.element_at(F.array(*stamps), (F.col("id") % 8 + 1).cast("int"))
    link = F.when(F.col("id") % 4 == 0, "-").otherwise(F.col("attachment"))
    details = F.concat("details", F.when(F.col("id") % 5 == 0, '\nsecond, "quoted" line').otherwise(""))
    symbol = F.concat(F.lit(" s"), "symbol", F.lit(" "))
    return t.announcements.select(symbol.alias("Scrip Code"), F.col("company").alias("Issuer Name"), F.col("subject").alias(" Headline "), details.alias("Body"), raw.alias("Submission Date"), link.alias("File"), F.col("id").cast("string").alias("Extra"))


_BACK = """CASE id % 8 WHEN 7 THEN NULL ELSE broadcast_ts END"""


@query(f"""SELECT upper('s' || symbol) AS symbol, company, subject, CASE WHEN id % 5 = 0 THEN concat(details, chr(10), 'second, "quoted" line') ELSE details END AS details, {_BACK} AS broadcast_ts, CASE WHEN id % 4 = 0 THEN '' ELSE attachment END AS attachment, COUNT(*) AS n FROM announcements GROUP BY ALL""")
def S1_announcements_csv(t: Tables) -> DataFrame:
    """S1 to S4: any known header, quoted line ends, seven date formats, guardrails."""
    rows = feeds.announcements_csv(t.spark, _landed(t, _feed(t), "csv"))
    return rows.groupBy("symbol", "company", "subject", "details", F.col("broadcast_ts").cast("timestamp_ntz").alias("broadcast_ts"), "attachment").agg(F.count("*").alias("n"))


@query("""SELECT 's' || symbol AS symbol, subject, CASE WHEN id % 4 = 0 THEN '-' ELSE attachment END AS attachment, COUNT(*) AS n FROM announcements GROUP BY ALL""")
def S5_legacy_csv(t: Tables) -> DataFrame:
    """Without guardrails: symbols and links stay as they are."""
    rows = feeds.announcements_csv(t.spark, _landed(t, _feed(t), "csv"), guardrails=False)
    return rows.groupBy("symbol", "subject", "attachment").agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN id % 6 = 0 THEN 10000 ELSE 5 END AS n_details, CASE WHEN id % 6 = 0 THEN 500 WHEN id % 6 = 1 THEN 2 ELSE 3 END AS n_subject FROM announcements""")
def S3_guardrails(t: Tables) -> DataFrame:
    """Over-long input is cut, NUL characters go; what is fine stays."""
    long = F.col("id") % 6 == 0
    details = F.when(long, F.repeat(F.lit("d"), 10_500)).when(F.col("id") % 6 == 1, F.lit("ab\0cd\0e")).otherwise("abcde")
    subject = F.when(long, F.repeat(F.lit("s"), 600)).when(F.col("id") % 6 == 1, F.lit("s\0t")).otherwise("xyz")
    cut, short = C.guarded(F.col("d"), F.col("s"))
    return t.announcements.select("id", details.alias("d"), subject.alias("s")).select("id", F.length(cut).alias("n_details"), F.length(short).alias("n_subject"))


@query("""SELECT CASE WHEN id % 3 = 2 THEN '' ELSE symbol END AS symbol, subject, CASE WHEN id % 2 = 0 THEN subject ELSE details END AS details, CAST(broadcast_date AS VARCHAR) AS broadcast_raw, CASE id % 4 WHEN 0 THEN attachment WHEN 1 THEN concat('https://base/', CAST(id AS VARCHAR), '.pdf') ELSE '' END AS attachment, COUNT(*) AS n FROM announcements GROUP BY ALL""")
def S7_announcements_json(t: Tables) -> DataFrame:
    """Fallback chains over the names that records may have; an empty field is a missing one."""
    third, some = F.col("id") % 3, lambda cond, value: F.when(cond, value)
    record = t.announcements.select(
        some(third == 0, F.col("symbol")).alias("symbol"), some(third == 1, F.col("symbol")).alias("sm_isin"), some(third == 0, F.col("subject")).alias("desc"), some(third == 1, F.col("subject")).alias("subject"), some(third == 2, F.col("subject")).alias("an_type"),
        F.when(F.col("id") % 2 == 0, "").otherwise(F.col("details")).alias("body"), F.lit("").alias("attchmntText"), F.lit("").alias("bcastDt"), F.col("broadcast_date").cast("string").alias("exchdisstime"),
        F.when(F.col("id") % 4 == 0, F.col("attachment")).when(F.col("id") % 4 == 1, F.concat(F.col("id").cast("string"), F.lit(".pdf"))).otherwise("").alias("attchmntFile"), F.col("company").alias("sm_name"),
    )
    rows = feeds.announcements_json(t.spark, _landed(t, record, "json"), "https://base/")
    return rows.groupBy("symbol", "subject", "details", "broadcast_raw", "attachment").agg(F.count("*").alias("n"))


@query("""SELECT symbol, CAST('1997-03-03' AS DATE) AS signal_date, volume, CASE volume % 4 WHEN 0 THEN 'Large' WHEN 1 THEN 'Mid' WHEN 2 THEN 'Small' END AS cap, COUNT(*) AS n FROM breakouts GROUP BY ALL""")
def S8_breakouts_json(t: Tables) -> DataFrame:
    """A landed scan; caps come as words or as numbers with commas."""
    cap = F.element_at(F.array(F.lit("25,000"), F.lit("MidCap"), F.lit("12.5"), F.lit("")), (F.col("volume") % 4 + 1).cast("int"))
    record = t.breakouts.select(F.when(F.col("volume") % 2 == 0, F.col("symbol")).alias("nsecode"), F.col("symbol"), "close", "per_chg", "volume", cap.alias("mcap"))
    rows = feeds.breakouts_json(t.spark, _landed(t, record, "json"), "1997-03-03")
    return rows.groupBy("symbol", "signal_date", "volume", "cap").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN lower(u) LIKE 'http%' AND lower(u) LIKE '%.pdf' THEN concat(substr(sha1(u), 1, 16), '.pdf') END AS name FROM (SELECT id, CASE id % 4 WHEN 0 THEN attachment WHEN 1 THEN '-' WHEN 2 THEN concat(upper(attachment), '?x') ELSE upper(attachment) END AS u FROM announcements)")
def S11_cache_names(t: Tables) -> DataFrame:
    """Which links are filings, and their names in the cache."""
    url = F.element_at(F.array(F.col("attachment"), F.lit("-"), F.concat(F.upper("attachment"), F.lit("?x")), F.upper("attachment")), (F.col("id") % 4 + 1).cast("int"))
    return t.announcements.select("id", feeds.cache_key(url).alias("name"))


@query("SELECT CAST(id AS VARCHAR) AS id, symbol, revenue FROM (SELECT id, symbol, score * 1.5::DOUBLE AS revenue FROM announcements WHERE id % 5 <> 0 AND id % 5 <> 1)")
def S15_fixture_lines(t: Tables) -> DataFrame:
    """JSON lines among notes and broken ones."""
    good = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "symbol", (F.col("score") * 1.5).alias("revenue")))
    line = F.when(F.col("id") % 5 == 0, F.lit("# a note")).when(F.col("id") % 5 == 1, F.concat(F.lit("{broken "), "symbol")).otherwise(good)
    path = f"{jobs.shared_folder(t.spark)}/landed-lines-{uuid.uuid4().hex}"
    t.announcements.select(line.alias("value")).write.text(path)
    return feeds.fixtures(t.spark, path, "id string, symbol string, revenue double")


@query("""SELECT upper('s' || symbol) AS symbol, day, MIN(subject) AS subject FROM (SELECT symbol, broadcast_date AS day, subject FROM announcements WHERE id % 8 <> 7) GROUP BY 1, 2""")
def T1_stream_of_csv(t: Tables) -> DataFrame:
    """A folder of CSV files as a stream, canonical columns, insert-or-ignore by symbol and day."""
    path = _landed(t, _feed(t), "csv")
    at = f"{jobs.shared_folder(t.spark)}/ingested-{uuid.uuid4().hex}"
    # a batch decides by its subjects; files arrive in one batch here, as availableNow without a limit takes all there are
    stream = feeds.canonical(feeds.csv_stream(t.spark, path)).where("broadcast_ts is not null").select("symbol", F.col("broadcast_ts").cast("date").alias("day"), "subject", F.date_format("broadcast_ts", "yyyy-MM").alias("month"))
    jobs.ingest(stream, f"{at}/table", ["symbol", "day", "month"], ["subject"], "month", f"{at}/checkpoint")
    return t.spark.read.parquet(f"{at}/table").select("symbol", "day", "subject")
