"""Streaming jobs run over the event feed; the oracle is the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..streaming import jobs, novelty
from .registry import Tables, query


def _events(t: Tables) -> DataFrame:
    return jobs.read_events(t.spark, f"{t.sf_dir}/events.parquet")


@query("SELECT event_id, event_type FROM events")
def T2_deduplicated(t: Tables) -> DataFrame:
    events = _events(t)
    twice = events.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    return jobs.run_to_table(jobs.deduplicated(twice, ["event_id"], "40 days").select("event_id", "event_type"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def T3_tumbling_daily(t: Tables) -> DataFrame:
    return jobs.run_to_table(jobs.tumbling(_events(t), "1 day", "40 days", "event_type"), mode="complete")


@query("""SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def T4_session(t: Tables) -> DataFrame:
    found = jobs.run_to_table(jobs.sessions(_events(t), "6 hours", "40 days", "user_id"), mode="complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events WHERE user_id % 10 = 3")
def T6_watchlist_alerts(t: Tables) -> DataFrame:
    watched = t.table("events").select("user_id").distinct().where("user_id % 10 = 3")
    return jobs.run_to_table(jobs.alerts(_events(t), watched, "user_id").select("event_id", "user_id"))


_WORDS = "list_distinct(regexp_extract_all(lower(details), '[a-z]{3,}'))"


@query(f"""WITH r AS (SELECT id, concat(symbol, '|', subject) AS key, broadcast_date AS day, {_WORDS} AS w, CASE WHEN subject IN ('Trading Window') THEN 0.1::DOUBLE WHEN regexp_matches(concat(subject, ' ', details), '{rules.REPEATED}', 'i') THEN 0.2::DOUBLE END AS fixed FROM announcements),
p AS (SELECT a.id, b.id AS old_id, b.day AS old_day, len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS sim FROM r a JOIN r b ON a.key = b.key AND a.day - b.day BETWEEN 0 AND 30 AND (b.day < a.day OR b.id < a.id)),
s AS (SELECT id, COUNT(*) AS n, arg_min(sim, old_day * 1000000000000 + old_id) FILTER (WHERE sim > 0.6) AS sim FROM (SELECT id, old_id, CAST(old_day - CAST('1970-01-01' AS DATE) AS BIGINT) AS old_day, sim FROM p) GROUP BY id)
SELECT r.id, r.fixed IS NULL AND s.sim IS NULL AS is_novel, coalesce(r.fixed, floor((1 - s.sim) * 100 + 0.5) / 100, CASE WHEN s.n > 0 THEN 0.65::DOUBLE ELSE 0.95::DOUBLE END) AS novelty FROM r LEFT JOIN s ON s.id = r.id""")
def T5_novelty_stream(t: Tables) -> DataFrame:
    """The announcements, landed and read as a stream: state by key, taken in event order and pruned by event time."""
    path = f"{jobs.shared_folder(t.spark)}/landed-announcements-{uuid.uuid4().hex}"
    rows = t.announcements.select("id", "symbol", "subject", "details", F.col("broadcast_date").alias("day"))
    rows.unionByName(novelty.closing_row(rows)).write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    with jobs.setting(t.spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        return jobs.run_to_table(novelty.novelty(stream))


@query("""SELECT start, event_type, COUNT(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00'), time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def T4_sliding(t: Tables) -> DataFrame:
    """Windows of twelve hours, one each six hours."""
    found = jobs.run_to_table(jobs.sliding(_events(t), "12 hours", "6 hours", "40 days", "event_type"), mode="complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
