"""The persisted index against a scan of the same documents, and the stemmer against another implementation."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from bourselake.functions import stemming
from bourselake.operators import retrieval, textindex
from bourselake.sources.versions import Conflict, Versions

DOCS = "/root/testdata/sf0.001/documents.parquet"


def rounded(rows):
    return {r[0]: round(r[1], 9) for r in rows}


def scan(docs, terms, idf="smooth", match_all=False):
    counts = retrieval.term_counts(docs, "key", "text", sorted(terms))
    return rounded(retrieval.bm25(counts, "key", len(terms), idf=idf, match_all=match_all).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)


def test_index_follows_adds_updates_and_deletes(spark, tmp_path, small_blocks):
    """After every change the index finds what a scan finds, whatever segments and tombstones there are."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]
    index, live, rng = textindex.TextIndex(spark, f"file://{tmp_path}/i"), {}, random.Random(1)
    steps = [rows[:60], *([rows[i]] for i in range(60, 64)), rows[64:80], rows[90:95] + rows[:5]]
    for step in steps:
        if step[-1] == rows[4]:
            step = [(k, "the and and the und les " + (t or "")[:40]) for k, t in step]
        index.add(spark.createDataFrame([*step, (None, "the and")], "k long, t string"), "k", "t")
        live.update(step)
    gone = [k for k in live if rng.random() < 0.3]
    index.delete(spark.createDataFrame([(k,) for k in [*gone, 10**9]], "k long"), "k")
    for k in gone:
        live.pop(k)
    docs = spark.createDataFrame(list(live.items()), "key long, text string")
    for terms in (["the"], ["the", "and"], ["les", "nosuchword"], ["und", "the", "and"]):
        found = rounded(index.search(terms).collect())
        want = scan(docs, terms)
        assert found == want
        ranked = sorted(want.items(), key=lambda x: (-round(x[1], 4), x[0]))[:7]
        assert [r.key for r in index.search(terms, 7, digits=4).collect()] == [k for k, _ in ranked]
    assert rounded(index.search(["the", "and"], match_all=True, idf="floored").collect()) == scan(docs, ["the", "and"], "floored", True)
    assert index.search(["nosuchword"]).count() == 0 and index.search([]).count() == 0
    sizes = [textindex._size_class(s["docs"]) for s in index.versions.latest()["segments"]]
    assert max(map(sizes.count, sizes)) < textindex.FAN_IN
    among = spark.createDataFrame([(k,) for k in list(live)[::2]], "key long")
    assert set(rounded(index.search(["the"], among=among).collect())) == set(list(live)[::2]) & set(scan(docs, ["the"]))
    before = rounded(index.search(["the"]).collect())
    index.vacuum()
    assert rounded(index.search(["the"]).collect()) == before
    index.delete(docs.select("key"), "key")
    assert index.search(["the"]).count() == 0 and index.versions.latest()["docs"] == 0


def test_two_writers_and_an_unfinished_one(spark, tmp_path):
    index = textindex.TextIndex(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame([(1, "alpha beta")], "k long, t string"), "k", "t")
    old = index.versions.latest()
    index._segment(index._forward(spark.createDataFrame([(2, "alpha")], "key long, text string")))  # written, never committed
    assert [r.key for r in index.search(["alpha"]).collect()] == [1]
    index.add(spark.createDataFrame([(3, "alpha")], "k long, t string"), "k", "t")
    with pytest.raises(Conflict):
        index._commit(old, old["segments"])
    (tmp_path / "i" / "_versions" / f"{index.versions.latest()['version'] + 1:012d}.json").write_text('{"segm')  # broken off
    assert sorted(r.key for r in index.search(["alpha"]).collect()) == [1, 3]
    index.add(spark.createDataFrame([(4, "alpha")], "k long, t string"), "k", "t")
    assert sorted(r.key for r in index.search(["alpha"]).collect()) == [1, 3, 4]


def _rows_scanned(df):
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            n += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return n


def test_a_search_reads_its_terms_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 64)
    monkeypatch.setattr(textindex, "ROW_GROUP", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/i")
    index.add(docs, "doc_id", "text")
    (segment,) = index.versions.latest()["segments"]
    postings = spark.read.parquet(f"{index.path}/{segment['name']}/postings")
    blocks = postings.where("term = 'the'")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in blocks._jdf.queryExecution().toString()
    assert _rows_scanned(blocks) < postings.count() / 4
    heads = blocks.groupBy("class").count().count()
    seen = []
    keep = textindex.TextIndex._classes
    monkeypatch.setattr(textindex.TextIndex, "_classes", staticmethod(lambda last: (seen.append(last), keep(last))[1]))
    got = [r.key for r in index.search(["the"], 5, digits=6).collect()]
    want = scan(docs.select(F.col("doc_id").alias("key"), "text"), ["the"])
    assert got == [k for k, _ in sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]]
    assert heads > 2 and seen[-1]["the"] < max(r["class"] for r in blocks.select("class").collect())


def test_negative_worth_is_read_whole(spark, tmp_path, small_blocks):
    """A term of most documents whose idf stays negative lowers scores: none of its postings may be left out."""
    rows = [(i, "common " * (1 + i % 5) + ("rare " * (1 + i % 3) if i % 9 == 0 else "") + "x " * (i % 17)) for i in range(400)]
    docs = spark.createDataFrame(rows, "key long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/i")
    index.add(docs, "key", "text")
    want = scan(docs, ["common", "rare"], "okapi")
    best = sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))[:30]
    assert [(r.key, round(r.score, 6)) for r in index.search(["rare", "common"], 30, 1.2, 0.75, "okapi", digits=6).collect()] == [(k, round(s, 6)) for k, s in best]


def test_full_text_questions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", 5, "1998-01-01", "Railway orders won"), (2, "B", 9, "1998-01-02", "an ordering of railways, orders"), (3, "A", 7, "1998-01-02", "nothing"), (4, "A", 7, "1998-01-01", None)], "id long, symbol string, score int, broadcast_date string, text string")
    index = textindex.index_of(spark, f"file://{tmp_path}", "t", "stemmed", rows.where("id < 0"), "id", F.col("text"))
    index.add(rows, "id", "text")
    ids = lambda q, **more: [r.id for r in textindex.full_text(index, rows, q, **more).orderBy("rank").collect()]
    assert sorted(ids("order RAILWAYS")) == [1, 2] and ids("order railways", symbols=["B"]) == [2] and ids("order", min_score=6) == [2]
    assert ids("orders & railways") == [] and ids("") == [2, 3, 4, 1] and ids(" ", day="1998-01-02", limit=1) == [2]


def test_stems_equal_another_implementation(spark):
    rng, letters = random.Random(3), "aeiouybcdlmnrstwxz"
    suffixes = [*stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", "ated", "bling", "izing", "yy"]
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) + rng.choice(suffixes) + (rng.choice(suffixes) if rng.random() < 0.3 else "") for _ in range(8000)}
    found = spark.read.parquet(DOCS).select(F.explode(stemming.plain_tokens(F.col("text"))).alias("w")).distinct().collect()
    words = sorted(words | {r.w for r in found} | {"électricité", "cióes", "gañes", "x" * 70 + "ing", "yttrium", "yes", "ies", "sky", "agreed", "1998", "a1b2s"})
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter ascii')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", enumerate(words))
    want = {words[d]: t for t, d in con.execute("select term, doc from v")}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stemming.stem(F.col("w")).alias("s")).collect()}
    assert got == want


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.latest() == {"version": 0} and v.commit({"version": 0, "a": "é"}) == 1 and v.latest() == {"version": 1, "a": "é"}
    with pytest.raises(Conflict):
        v.commit({"version": 0})
    v.commit(v.latest())
    v.forget()
    assert v.latest()["version"] == 2
