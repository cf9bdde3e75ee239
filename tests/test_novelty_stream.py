"""The novelty stream gives the batch job's rows, however its feed is cut."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bourselake.plans.enrichment import novelty as in_batch
from bourselake.streaming import jobs, novelty
from bourselake.streaming.novelty import Novelty

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "id long, symbol string, subject string, details string, day date"
SAID = ["order for railway coaches", "order for railway coaches and wagons", "a large order", "revised order", "dividend paid", "", "order for coaches railway", "stake in a software firm"]


@pytest.fixture(scope="module")
def feed(spark):
    rng, rows = random.Random(4), []
    for i in range(1, 301):
        rows.append((i, rng.choice("AB"), rng.choice(["Updates", "Trading Window", "Press Release"]), rng.choice(SAID), f"1998-0{rng.randrange(1, 7)}-{rng.randrange(1, 28):02d}"))
    return spark.createDataFrame(rows, "id long, symbol string, subject string, details string, day string").withColumn("day", F.col("day").cast("date"))


def run(spark, path, most=None, delay="0 days"):
    reader = spark.readStream.schema(SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", most) if most else reader).parquet(path)
    with jobs.setting(spark, "spark.sql.streaming.stateStore.providerClass", STORE), jobs.setting(spark, "spark.sql.shuffle.partitions", "2"):
        return sorted(map(tuple, jobs.run_to_table(novelty.novelty(stream, delay=delay)).collect()))


def want(rows):
    return sorted(map(tuple, in_batch(rows).collect()))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_any_arrow_batch(spark, tmp_path, feed, batch):
    feed.orderBy(F.rand(batch)).unionByName(novelty.closing_row(feed)).write.parquet(f"{tmp_path}/feed")
    with jobs.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)):
        assert run(spark, f"{tmp_path}/feed") == want(feed)


@pytest.mark.parametrize("parts", [2, 5])
def test_any_micro_batch(spark, tmp_path, feed, parts):
    """The feed by day in files, each a micro-batch; the days at a border are in both files, which the delay allows."""
    rows = sorted(feed.collect(), key=lambda r: r.day)
    size = len(rows) // parts + 1
    pieces = [rows[i : i + size] for i in range(0, len(rows), size)] + [novelty.closing_row(feed, 3).collect()]
    for n, piece in enumerate(pieces):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/feed/{n}")
        time.sleep(0.02)
    assert run(spark, f"{tmp_path}/feed/*", 1, "3 days") == want(feed)


def test_nothing_comes_out_before_its_day_has_passed(spark, tmp_path, feed):
    """Without the closing row the last day waits; rows without a day have no result."""
    feed.unionByName(feed.limit(1).withColumn("day", F.lit(None).cast("date")).withColumn("id", F.lit(9999).cast("long"))).write.parquet(f"{tmp_path}/feed")
    last = feed.agg(F.max("day")).first()[0]
    got = {r[0] for r in run(spark, f"{tmp_path}/feed")}
    assert got == {r.id for r in feed.collect() if r.day < last}


def test_a_key_holds_its_window_only():
    """Equal word sets of a day are kept once, whatever the number of rows."""
    window = {}
    out = list(Novelty._day(10, [(i, "order railway" if i % 2 else "stake", float("nan")) for i in range(1000)], window))
    assert len(out) == 1000 and {d: len(s) for d, s in window.items()} == {10: 2}
    assert out[0] == (0, True, 0.95) and out[1] == (1, True, 0.65) and out[2] == (2, False, 0.0)


class State(dict):
    """A map of the state that counts the steps to it."""

    steps = 0

    def getValue(self, key):
        self.steps += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.steps += 1
        self[key] = value

    def removeKey(self, key):
        self.steps += 1
        self.pop(key)

    def exists(self):
        return bool(self)

    def iterator(self):
        return iter(self.items())


class Now:
    def __init__(self, day):
        self.day = day

    def getCurrentWatermarkInMs(self):
        return self.day * 86_400_000


def test_steps_to_the_state_do_not_grow_with_days_and_batches():
    """3 000 rows of 300 days in 30 batches, taken in two parts: a step for each day and batch were thousands."""

    class Handle:
        timers = []

        def getMapState(self, name, *_):
            return State()

        def registerTimer(self, at):
            self.timers.append(at // 86_400_000)

    rng, of = random.Random(5), Novelty(30)
    of.init(Handle())
    rows = pd.DataFrame([(i, rng.randrange(10_000, 10_300), rng.choice(SAID), rng.choice([float("nan"), 0.2])) for i in range(3000)], columns=["id", "day", "words", "fixed"])
    assert list(of.handleInputRows(("k",), iter([rows[i : i + 100] for i in range(0, 3000, 100)]), None)) == []
    parts = [pd.concat([*of.handleExpiredTimer(("k",), Now(day), None)]) for day in (10_100, 10_301)]
    assert len(parts[0]) == (rows.day < 10_100).sum() and sum(map(len, parts)) == 3000 and not of.waiting
    assert Handle.timers == [rows.day.min() + 1, rows[rows.day >= 10_100].day.min() + 1]
    assert of.waiting.steps + of.said.steps < 200
    window, want = {}, []
    for day, some in rows.sort_values(["day", "id"]).groupby("day"):
        window = {d: s for d, s in window.items() if d >= day - 30}
        for r in some.itertuples():
            words = set(r.words.split())
            hit = next((x for said in window.values() for s in said if (x := len(words & s) / len(words | s) if words and s else 0.0) > 0.6), None)
            score = r.fixed if r.fixed == r.fixed else int((1 - hit) * 100 + 0.5) / 100 if hit is not None else 0.65 if window else 0.95
            want.append((r.id, bool(r.fixed != r.fixed and hit is None), score))
            window.setdefault(day, []).append(words)
    assert [tuple(r) for r in pd.concat(parts).itertuples(index=False)] == want
