import json

import pytest
from pyspark.sql import functions as F

from bourselake.sources import feeds
from bourselake.streaming import jobs


def test_csv(spark, tmp_path):
    text = '﻿Symbol,Headline,Description,Broadcast Date,PDF\n aaa ,Acquisition,"two\nlines",23-Apr-2026 10:05:06,https://x/y.pdf\nbbb,Updates,d,junk,-\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    rows = {r.symbol: r for r in feeds.announcements_csv(spark, f"file://{tmp_path}/a.csv").collect()}
    assert rows["AAA"].details == "two\nlines" and rows["AAA"].attachment == "https://x/y.pdf" and rows["AAA"].broadcast_ts is not None
    assert rows["BBB"].attachment == "" and rows["BBB"].broadcast_ts is None and rows["BBB"].company == ""
    with pytest.raises(ValueError):
        feeds.header_map(["symbol", "details"])


def test_json_and_fixtures(spark, tmp_path):
    rows = [{"bcastDt": "", "date": "2026-04-23", "attchmntFile": "f.pdf", "desc": "Updates", "symbol": "A"}, {"broadcast_date": "x", "attachment": "http://a", "subject": "S", "body": "text", "company": "C"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = sorted(feeds.announcements_json(spark, f"file://{tmp_path}/a.json", "https://base/").collect())
    assert [(r.broadcast_raw, r.attachment, r.details) for r in got] == [("x", "http://a", "text"), ("2026-04-23", "https://base/f.pdf", "Updates")]
    (tmp_path / "f.jsonl").write_text('# note\n\n{"id": "1", "v": 2.5}\n{broken\n')
    assert [tuple(r) for r in feeds.fixtures(spark, f"file://{tmp_path}/f.jsonl", "id string, v double").collect()] == [("1", 2.5)]


def test_ingest_twice_changes_nothing(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/table"
    schema = "k string, v int, day date"
    rows = spark.createDataFrame([("a", 1, "2026-01-01"), ("a", 2, "2026-01-01"), ("b", 3, "2026-01-02")], "k string, v int, day string").withColumn("day", F.col("day").cast("date"))
    rows.coalesce(1).write.mode("append").parquet(source)
    run = lambda n: jobs.ingest(spark.readStream.schema(schema).parquet(source), target, ["k", "day"], ["v"], "day", f"file://{tmp_path}/cp{n}")
    run(1)
    run(2)  # a new checkpoint: everything is read again
    rows.withColumn("k", F.concat("k", F.lit("x"))).coalesce(1).write.mode("append").parquet(source)
    run(2)
    got = sorted((r.k, r.v) for r in spark.read.parquet(target).collect())
    assert got == [("a", 1), ("ax", 1), ("b", 3), ("bx", 3)]
