"""Queries whose work must grow with their input: the same results as the plain definition, without rows that meet all others."""

import datetime as dt
import random

from pyspark.sql import functions as F

from __spark_entry__ import queries
from bourselake.functions import statements as S
from bourselake.operators.full_statements import full_statements
from bourselake.operators.textindex import TextIndex, full_text
from bourselake.plans import search
from bourselake.plans.enrichment import novelty


def most_rows(df) -> int:
    """Runs df; the most rows that any step of its plan has passed on."""
    df.count()
    run = df._jdf.queryExecution()
    run.toRdd().count()
    todo, most = [run.executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def announcements(spark, rows):
    return spark.createDataFrame(rows, "id long, symbol string, subject string, details string, day date")


def test_novelty_as_defined(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = []
    for i in rng.sample(range(1000), 300):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 6))) if rng.random() < 0.9 else rng.choice([None, "12 3", "revised alpha"])
        day = dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(120)) if rng.random() < 0.97 else None
        rows.append((i, rng.choice("AB"), rng.choice(["Updates", "Trading Window"]), text, day))
    of = lambda t: {w for w in (t or "").split() if w.isalpha() and len(w) > 2}
    want = {}
    for i, symbol, subject, text, day in rows:
        old = sorted((d, j, t) for j, s, u, t, d in rows if (s, u) == (symbol, subject) and day and d and 0 <= (day - d).days <= 30 and (d, j) < (day, i))
        sims = [len(of(text) & of(t)) / len(of(text) | of(t)) if of(text) and of(t) else 0.0 for _, _, t in old]
        hit = next((x for x in sims if x > 0.6), None)
        fixed = 0.1 if subject == "Trading Window" else 0.2 if "revised" in (text or "") else None
        score = fixed if fixed is not None else int((1 - hit) * 100 + 0.5) / 100 if hit is not None else 0.65 if old else 0.95
        want[i] = (fixed is None and hit is None, score)
    got = {r.id: (r.is_novel, r.novelty) for r in novelty(announcements(spark, rows)).collect()}
    assert got == want


def test_novelty_of_one_busy_key(spark):
    n = 3000
    rows = spark.range(n).select("id", F.lit("A").alias("symbol"), F.lit("Updates").alias("subject"), F.lit("the same words").alias("details"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"))
    assert most_rows(novelty(rows)) <= 2 * n


def test_statements_are_not_broadcast(spark):
    """A row a page looks small by the size of its files; it must not go through the driver."""
    page = "Results for the quarter ended\n30.06.2026 31.03.2026\nRevenue from operations\n5\n4\n3\nOther income\n1\n2\n3\nTotal income\n6\n6\n6\nProfit before tax\n2\n2\n2\nProfit after tax\n1\n1\n1"
    pages = spark.range(40).select(F.col("id").alias("doc"), F.lit(1).alias("page_no"), F.lit(page).alias("text"), F.lit(None).cast("array<array<array<string>>>").alias("tables"))
    found = full_statements(pages)
    assert [len(r["items"]) for r in found.collect()] == [5] * 40
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty_question_needs_no_index(spark):
    def index():
        raise AssertionError("built for nothing")

    rows = spark.range(10).select("id", F.lit("A").alias("symbol"), F.col("id").cast("int").alias("score"), F.lit("2024-01-01").cast("date").alias("broadcast_date"))
    assert [r.id for r in full_text(index, rows, "  ", 3, symbols=["A"]).collect()] == [9, 8, 7]
    assert full_text(index, rows, "a, b", 3).count() == 0


def test_sections_are_found_once(spark):
    """The filter on what the sections hold must not work them out again: four patterns, each found once."""
    plan = queries()["F41_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4
    texts = spark.createDataFrame([(None,), ("",), ("x" * 101 + "Balance Sheet one, notes to accounts",)], "t string").withColumn("s", S.section_starts(F.col("t")))
    assert all(r.a == r.b for r in texts.select(S.sections(F.col("t")).alias("a"), S.sections(F.col("t"), F.col("s")).alias("b")).collect())


def test_empty_question_query_builds_no_index(spark, monkeypatch):
    def built(*_):
        raise AssertionError("built for nothing")

    monkeypatch.setattr(search, "index_of", built)
    assert queries()["R1_empty_question"](spark, "/root/testdata/sf0.001").count() == 40


def test_lines_meet_their_next_one_without_a_window(spark):
    """Lines of all pages are neither sorted nor shuffled; values are worked out once."""
    pages = spark.createDataFrame([(1, "Revenue from operations\n812.5\nNet profit (44)\nProfit/(Lossl for the neriod 7.5"), (2, None), (3, ""), (4, "REVENUEFROMOPERATIONS 5.5\nPl'ofit after tax\n(a) 1.5")], "id long, text string")
    found = S.line_values(pages, "id", "text")
    assert {(r.id, r.field, r.value) for r in found.collect()} == {(1, "revenue", 812.5), (1, "pat", -44.0), (4, "revenue", 5.5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count(r"\d[\d,]*(?:\.\d+)?\)|-?") == 2  # behind the name, and in the next line


def test_a_table_is_read_once(spark):
    """The column of the data is not looked for again for each row and use."""
    table = [["", "Particulars", "30.06.2026"], ["1", "Revenue from operations", "5.5"], ["2", "Other income *", "-"], ["3", "Net profit", "(7)"]]
    tables = spark.createDataFrame([(1, table), (2, table[:3])], "id long, t array<array<string>>")
    found = S.table_values(tables, "id", "t")
    got = {(r.id, r.field): r.value for r in found.collect()}
    assert got[1, "revenue"] == 5.5 and got[1, "pat"] == -7.0 and {k for k, _ in got} == {1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count(S.DATE_CELL[4:]) == 1


def test_words_are_counted_within_the_row(spark, tmp_path):
    """An index takes texts apart without a shuffle of their words."""
    found = TextIndex(spark, f"file://{tmp_path}/i")._forward(spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "key long, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.key, r.length, [(t.term, t.tf) for t in r.terms]) for r in found.collect()] == [(1, 3, [("a", 1), ("b", 2)])]
