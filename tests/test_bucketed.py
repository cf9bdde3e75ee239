"""Bucket tables against plain merges: the same rows, only touched buckets written, old versions readable."""

import random

import pytest
from pyspark.sql import functions as F

from bourselake.operators import bucketed, merge
from bourselake.operators.filters import where_tree
from bourselake.operators.setjoin import links, similar
from bourselake.sources.versions import Conflict

SCHEMA = "k string, n long, url string"


def order():
    return [F.col("n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(map(tuple, df.select("k", "n", "url").collect()), key=str)


def test_changes_equal_plain_merges(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(rng.choice("abcdefgh") + str(rng.randrange(9)) if rng.random() > 0.05 else None, i * 100 + j, f"u{i}-{j}") for j in range(40)] for i in range(3)]
    for how in ("upsert", "insert_ignore"):
        table, plain = bucketed.BucketTable(spark, f"file://{tmp_path}/{how}", ["k"], 8), frame(spark, [])
        for rows in batches:
            batch = frame(spark, rows)
            getattr(table, how)(batch, order())
            plain = frame(spark, [tuple(r) for r in getattr(merge, how)(plain, batch, ["k"], order()).collect()])
            assert content(table.read()) == content(plain)
        keys = plain.where("k < 'd'").select("k")
        table.delete(keys)
        assert content(table.read()) == content(plain.where("k >= 'd' or k is null"))
        assert content(table.get(frame(spark, [("e1", 0, ""), ("none", 0, "")]))) == content(plain.where("k = 'e1'"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = bucketed.BucketTable(spark, f"file://{tmp_path}/t", ["k"], 32)
    table.upsert(frame(spark, [(f"k{i}", i, "") for i in range(3000)]), order())
    before = table.versions.latest()["files"]
    files = lambda: {p for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    old = files()
    table.upsert(frame(spark, [("k7", 10_000, "new"), ("k9", 10_001, "new")]), order())
    after = table.versions.latest()["files"]
    changed = [b for b in before if before[b] != after[b]]
    assert 1 <= len(changed) <= 2 and len(files() - old) == len(changed) and len(before) == 32
    assert table.read().count() == 3000 and table.read().where("url = 'new'").count() == 2
    table.vacuum()
    assert len({p.parent for p in files()}) == 32 and table.read().count() == 3000


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = bucketed.BucketTable(spark, f"file://{tmp_path}/t", ["k"], 4)
    table.upsert(frame(spark, [("a", 1, ""), ("b", 1, "")]), order())
    with monkeypatch.context() as m:
        m.setattr(type(table.versions), "commit", lambda self, state: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.upsert(frame(spark, [("a", 2, "")]), order())
    assert content(table.read()) == [("a", 1, ""), ("b", 1, "")]
    table.upsert(frame(spark, [("a", 3, "")]), order())
    assert content(table.read()) == [("a", 3, ""), ("b", 1, "")]
    with monkeypatch.context() as m:
        old = {**table.versions.latest(), "version": 1}
        m.setattr(type(table.versions), "latest", lambda self: old)
        with pytest.raises(Conflict):
            table.upsert(frame(spark, [("b", 9, "")]), order())


def test_update_by_unique_value(spark, tmp_path):
    """Rows move between buckets with their key; an update whose key is another row's vanishes."""
    rng, table, plain = random.Random(6), bucketed.BucketTable(spark, f"file://{tmp_path}/t", ["k"], 8, unique="url"), None
    first = [(f"k{i}", i, f"u{i}") for i in range(30)]
    table.upsert(frame(spark, first), order())
    plain = frame(spark, first)
    for step in range(3):
        rows = [(f"k{rng.randrange(45)}", 100 * (step + 1) + j, f"u{rng.randrange(40)}") for j in range(12)]
        table.update_or_insert(frame(spark, rows), F.col("n"))
        plain = frame(spark, [tuple(r) for r in merge.update_or_insert(plain, frame(spark, rows), "url", ["k"], F.col("n")).select("k", "n", "url").collect()])
        assert content(table.read()) == content(plain)


def test_get_ids_reads_a_fraction(spark, tmp_path):
    table = bucketed.BucketTable(spark, f"file://{tmp_path}/t", ["id"], 16)
    table.upsert(spark.range(20_000).withColumn("label", (F.col("id") % 7).cast("string")), [F.col("label")])
    found = table.get_ids([5, 17, 10**9])
    assert sorted(r.id for r in found.collect()) == [5, 17]
    assert 1 <= len(found.inputFiles()) <= 3 and len(table.read().inputFiles()) == 16
    assert "PushedFilters: [In(id, [" in found._jdf.queryExecution().toString()
    tree = {"$and": [{"label": "3"}, {"$or": [{"id": {"$lt": 100}}, {"id": {"$gte": 19_990}}]}]}
    rows = table.read().where(where_tree(tree))
    assert "EqualTo(label,3)" in rows._jdf.queryExecution().toString() and sorted(r.id for r in rows.collect()) == [i for i in [*range(100), *range(19_990, 20_000)] if i % 7 == 3]


# ---- set-similarity join


@pytest.mark.parametrize(("num", "den"), [(3, 5), (1, 2), (4, 5), (1, 3), (1, 1)])
def test_similar_sets_equal_brute_force(spark, num, den):
    rng = random.Random(num * 10 + den)
    sets = {}
    for i in range(150):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else set()
        sets[i] = {w for w in base if rng.random() > 0.15} | {f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randrange(0, 12))}
    one = {i: s for i, s in sets.items() if s and not any(sets[j] == s for j in range(i))}
    want = {(a, b) for a in one for b in one if (len(one[a]), a) < (len(one[b]), b) and len(one[a] & one[b]) * den >= len(one[a] | one[b]) * num}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in one.items()], "key long, words array<string>")
    assert {(r.a, r.b) for r in similar(df, num, den).collect()} == want


def test_links_count_classes(spark):
    """Copies in masses are one class; empty and null sets are alone; repeated keys count once."""
    rows = [(i, ["a", "b", "c", "d"]) for i in range(10, 500)] + [(1, ["a", "b", "c", "d", "e"]), (2, []), (3, None), (4, []), (5, ["x"]), (5, ["x"])]
    got = {r.k: (r.class_id, r.n_links, r.nearest) for r in links(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 3, 5).collect()}
    assert got[499] == (10, 1, 0.8) and got[1] == (1, 1, 0.8) and got[2] == (2, 0, None) and got[3] == (3, 0, None) and got[4] == (4, 0, None) and got[5] == (5, 0, None) and len(got) == 495
