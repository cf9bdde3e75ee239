"""Stems within the row: the column stemmer's, and no shuffle of words."""

import random

from pyspark.sql import functions as F

from __spark_entry__ import queries
from bourselake.functions import stemming


def test_python_stems_are_the_columns(spark):
    rng = random.Random(9)
    ends = [*stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, "s", "ss", "es", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", "at", "bl", "iz", "ated", "ating", "tt", "bbing", "é", "7", ""]
    starts = ["".join(rng.choices("aeiouybcdlmnrstwxzé", k=rng.randrange(0, 7))) for _ in range(1500)]
    words = sorted({s + e for s in starts for e in rng.sample(ends, 8)} | {"y", "yy", "yying", "yes", "say", "2024", "9s", "x" * 70, "ééing", "a" * 63 + "s", "bled", "ss", "ies"} - {""})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemming.stem(F.col("w")).alias("stem")).collect()
    assert [(r.w, r.stem) for r in got if stemming.stem_of(r.w) != r.stem] == [] and len(got) > 8000


def test_lines_of_odd_texts(spark):
    rows = [(1, "Running runs, ran 12 12 RUNNING"), (2, None), (3, ""), (4, "!!"), (5, "a b caresses")]
    got = dict(map(tuple, spark.createDataFrame(rows, "id long, t string").select("id", stemming.stemmed_line(F.col("t"))).collect()))
    assert got == {1: "12 ran run", 2: "", 3: "", 4: "", 5: "a b caress"}


def test_tokenisers_do_not_shuffle_words(spark):
    """The only aggregate, explosion or sort of words was that of the stems."""
    plan = queries()["F9_tokenisers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
