"""Vectors and stems of a text come within its row: no word is shuffled, whatever the searches are that use them."""

import hashlib
import re

from pyspark.sql import functions as F

from bourselake.functions import columns as C
from bourselake.functions import rules
from bourselake.operators import hybrid_search
from bourselake.operators.textindex import TextIndex

TEXTS = ["Software firm stake", "railway Railways ordered, ordering 12 coaches", "", "...", None, "a a b", "the bank of steel and power"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _vector(text, dimensions):
    out = [0.0] * dimensions
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        out[int(h[:8], 16) % dimensions] += -1.0 if int(h[8], 16) % 2 else 1.0
    return out


def test_vectors_are_of_the_row(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for dimensions in (16, 5):
        found = hybrid_search.hashed_vectors(rows, "id", F.col("text"), dimensions)
        assert "Exchange" not in _plan(found)
        want = {i: v for i, t in enumerate(TEXTS) if any(v := _vector(t, dimensions))}
        assert {r.id: list(r.embedding) for r in found.collect()} == want
    assert hybrid_search.question_vector(TEXTS[0], rows) == _vector(TEXTS[0], 16) and hybrid_search.question_vector("?", rows) == [0.0] * 16


def test_stems_of_an_index_are_of_the_row(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", "stemmed")
    forward = index._forward(spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string"))
    assert "Exchange" not in _plan(forward)
    got = {r.key: (r.length, [tuple(t) for t in r.terms]) for r in forward.collect()}
    assert got[1] == (6, [("12", 1), ("coach", 1), ("order", 2), ("railwai", 2)]) and set(got) == {0, 1, 5, 6} and got[5] == (3, [("a", 2), ("b", 1)])


def test_a_theme_is_found_as_in_all_tags(spark):
    rows = spark.createDataFrame([("ABC Steel", "Updates", t) for t in TEXTS] + [(None, "Pharma", "solar power"), (None, None, None)], "company string, subject string, details string")
    fields = F.col("company"), F.col("subject"), F.col("details")
    tags = F.array_join(C.sector_tags(*fields), ",")
    themes = [label for label, _ in rules.SECTORS] + ["a", "no such", ",", rules.SECTORS[0][0][:3]]
    same = [F.coalesce(C.sector_theme(*fields, t) == tags.contains(t), F.lit(False)).alias(f"c{i}") for i, t in enumerate(themes)]
    assert all(all(r) for r in rows.select(*same).collect())


class _Index:
    def search(self, terms, n, *args, among=None, **more):
        self.among = among
        return among.sparkSession.createDataFrame([], "key string, score double") if among is not None else self.nothing


def test_a_typed_search_reads_rows_with_their_vectors(spark):
    """No list of all ids goes to the index, and vectors are not joined to the rows that pass."""
    rows = hybrid_search.with_vectors(spark.createDataFrame([(str(i), t, i % 2) for i, t in enumerate(TEXTS)], "id string, text string, kind int"), F.col("text"))
    index, vector = _Index(), _vector("software firm", 16)
    index.nothing = spark.createDataFrame([], "key string, score double")
    every = hybrid_search.typed_search(index, rows, ["software"], vector, {}, 10)
    assert index.among is None and {r.id for r in every.collect()} == {str(i) for i, t in enumerate(TEXTS) if any(_vector(t, 16))} and every.first().id == "0"
    some = hybrid_search.typed_search(index, rows, ["software"], vector, {"kind": {"$eq": 1}}, 10)
    assert {r.id for r in index.among.select(F.col("key").alias("id")).collect()} == {"1", "3", "5"} and {r.id for r in some.collect()} == {"1", "5"}
