import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from bourselake.functions import columns as C
from bourselake.functions import filings as X
from bourselake.functions import rules
from bourselake.functions import statements as S
from bourselake.operators import filters, merge, retrieval, routing


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money(spark):
    texts = ["worth Rs. 1,234.5 crore", "Rs 50 lakh", "Rs. 30 mn", "USD 10 million", "Rs. 1.2.3 crore or Rs. 200 lakh", "nothing", None]
    assert values(spark, texts, C.crore) == [1234.5, 0.5, 0.3, 84.0, 2.0, None, None]
    assert values(spark, [1500.0, 500.0, 100.0, 20.0, 1.0, None], C.size_bucket, "double") == ["mega", "large", "medium", "small", "tiny", "unknown"]


def test_numbers_and_units(spark):
    cells = ["2,94,270", "(3,900)", "412 72", "2 248 39", "1 234", "-", "Nil", "", "x1", "-12.5", None]
    assert values(spark, cells, C.indian_number) == [294270.0, -3900.0, 412.72, 2248.39, 1234.0, None, None, None, None, -12.5, None]
    assert values(spark, ["(Rs. in lakhs)", "INR million", "in crore", "12,345"], C.unit_factor) == [0.01, 0.1, 1.0, 1.0]
    assert values(spark, ["12 Revenue 3,900.5", "4 (120) 7", "7 8", "a 250 b"], X.first_number) == [3900.5, -120.0, None, 250.0]


def test_timestamps(spark):
    raw = ["23-Apr-2026 10:05:06", "2026-04-23 10:05:06", "3-APR-2026 9:05", "2026-04-23 10:05", "23/04/2026 10:05:06", "23/04/2026", "2026-04-23", "23.04.2026", "2026-04-23 junk", None]
    got = values(spark, raw, C.timestamp)
    assert got[0] == got[1] == got[4] == dt.datetime(2026, 4, 23, 10, 5, 6) and got[2] == dt.datetime(2026, 4, 3, 9, 5)
    assert got[5] == got[6] == dt.datetime(2026, 4, 23) and got[7:] == [None, None, None]
    assert values(spark, ["2026-04-23 10:00", "x", None], C.date_int) == [20260423, 0, 0]


def test_periods(spark):
    days = [dt.date(2026, 4, 1), dt.date(2026, 8, 4), dt.date(2026, 12, 31), dt.date(2027, 2, 1)]
    assert values(spark, days, C.period_label, "date") == ["Q1 FY2027", "Q2 FY2027", "Q3 FY2027", "Q4 FY2027"]
    periods = ["Q1FY26", "Q1 FY2027", "2025-Q1", "FY2026", "2025-26", "odd", "Q3FY05"]
    assert values(spark, periods, C.prior_period) == ["Q1FY25", "Q1 FY2026", "2024-Q1", "FY2025", "2024-26", None, "Q3FY04"]
    assert values(spark, ["18 months", "2 years", "10 weeks", "45 days", "3 days", "soon"], C.execution_months) == [18, 24, 3, 2, 1, None]


def test_ranges(spark):
    as_of = F.lit("2026-04-23").cast("date")  # a Thursday
    got = values(spark, ["orders today", "of yesterday", "this week", "last week", "this month", "this year", "last 10 days", "ever"], lambda x: C.range_start(x, as_of))
    assert got == [dt.date(2026, 4, 23), dt.date(2026, 4, 22), dt.date(2026, 4, 20), dt.date(2026, 4, 13), dt.date(2026, 4, 1), dt.date(2026, 1, 1), dt.date(2026, 4, 13), None]


def test_gate_labels_and_scores(spark):
    assert values(spark, ["Acquisition", "Trading Window", "acquisition", None], C.subject_gate) == [True, False, False, False]
    score = lambda subject: lambda x: C.catalyst_score(F.lit(subject), x)
    assert values(spark, ["Rs. 1,000 crore", "Rs. 500 cr", "Rs 100 crore", "none"], score("Bagging/Receiving of orders/contracts")) == [13, 12, 11, 10]
    assert values(spark, ["trading window", "order received", "hello"], score("Updates")) == [0, 8, 3]
    assert values(spark, ["Rs. 6 per share", "Rs.1.5 per equity share", "Rs. 0.5 per share", "?"], score("Dividend")) == [5, 4, 2, 4]
    assert values(spark, ["new CEO", "clerk"], score("Resignation")) == [5, 1]
    assert values(spark, ["new plant", "hello"], score("Bonus")) == [7, 3]


def test_guardrails(spark):
    rows = spark.createDataFrame([("d" * 10_001, "s" * 600), ("a\0b", "s"), ("fine", "s")], "d string, s string")
    details, subject = C.guarded(F.col("d"), F.col("s"))
    got = rows.select(details.alias("d"), subject.alias("s")).collect()
    assert sorted((len(r.d), len(r.s)) for r in got) == [(2, 1), (4, 1), (10_000, 500)]


def test_order_win(spark):
    text = "Order Book crosses Rs.25,750 Crore. The company won an order worth Rs. 960 crore from NHAI for a highway, to be executed in 18 months."
    more = ["Contract of Rs 5 lakh", "LOA over 2 weeks amounting to INR 3 billion. Then Rs. 1 crore", "Rs. 7 cr for a coal india refinery", "Order book of Rs. 5 crore", None]
    rows = spark.createDataFrame(list(enumerate([text, "no value", *more])), "i int, x string")
    got = {r.i: (r.value_cr, r.client_type, r.sector, r.months) for r in X.order_wins(rows, "x").collect()}
    assert got == {0: (960.0, "Government / PSU", "roads", 18), 2: (0.05, "Private sector", "general", None), 3: (300.0, "Private sector", "general", 0), 4: (7.0, "Government / PSU", "oil_gas", None)}


def test_annexure_and_highlights(spark):
    rows = [["1", "Name of the entity awarding the contract", "", "ABC Ltd"], ["2", "Time period by which to be executed", "12 months"], ["3", "Size of the order", None]]
    assert values(spark, [rows], X.annexure, "array<array<string>>") == [{"client": "ABC Ltd", "duration": "12 months"}]
    assert values(spark, ["Rs. 500 Crore", "76,20,00,000", "2,50,000"], X.rupees) == [500.0, 76.2, 2500.0]
    assert values(spark, ['["Client: X", "Client: Y", "z"]', "broken", None], X.highlights) == [{"Client": "Y"}, {}, {}]


def test_where_tree(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 9.0, None)], "id int, v double, s string")
    ids = lambda tree: sorted(r.id for r in df.where(filters.where_tree(tree)).collect())
    assert ids({"v": {"$gte": -100.0}}) == [1, 3] and ids({"s": {"$ne": "a"}}) == [2, 3]
    assert ids({"$or": [{"v": {"$gt": 6.0}}, {"s": "b"}]}) == [2, 3] and ids({}) == [1, 2, 3]


def test_select_only(spark):
    assert filters.select_only(spark, " select 1 as x").count() == 1
    with pytest.raises(ValueError):
        filters.select_only(spark, "WITH a AS (SELECT 1) SELECT * FROM a")


def test_insert_ignore_is_idempotent_and_nulls_are_new(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    one = merge.insert_ignore(batch.limit(0), batch, ["k"], [F.col("v")])
    assert sorted((r.k or "", r.v) for r in one.collect()) == [("", 4), ("a", 1), ("b", 3)]
    two = merge.insert_ignore(one, batch.where("k is not null"), ["k"], [F.col("v")])
    assert two.count() == 3


def test_suffixes(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("x", 4)], "id string, n int")
    assert [r.id for r in merge.suffixed(df, "id", [F.col("n")]).orderBy("n").collect()] == ["x", "x_1", "y", "x_2"]


def test_ranking_metrics(spark):
    retrieved = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "case_id string, item string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("r", "z")], "case_id string, item string")
    got = {r.case_id: r for r in retrieval.ranking_metrics(retrieved, relevant).collect()}
    assert (got["q"].hit, got["q"].mrr, round(got["q"].ndcg, 6)) == (1, 0.5, 0.63093) and (got["r"].hit, got["r"].mrr, got["r"].ndcg) == (0, 0.0, 0.0)


def test_classify(spark):
    q = routing.ask(spark, "ABC orders above Rs. 100 crore on 3/4/26 in solar", dt.date(2026, 4, 23))
    assert (q.symbols, q.day, q.order_value, q.themes) == (["ABC"], "2026-04-03", 100.0, ["solar_renewables"])
    assert routing.ask(spark, "revenue growth", dt.date(2026, 4, 23)).intent == "financial"
    assert routing.ask(spark, "top rated today", dt.date(2026, 4, 23)).min_score == 8


def test_written_postings_are_those_of_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, None)], "k long, t string")
    path = f"file://{tmp_path}/index"
    retrieval.write_index(docs, "k", "t", path, 4)
    got = retrieval.read_index(spark, path, ["two", "never"], 4)
    assert sorted((r.k, r.token, r.tf, r.length) for r in got.collect()) == [(1, "two", 2, 3), (2, "two", 1, 2)]
    counts = {r.k: (r.length, r.tf) for r in retrieval.term_counts(docs, "k", "t", ["two", "three"]).collect()}
    assert counts == {1: (3, [2, 0]), 2: (2, [1, 1])}


def test_periods_as_written(spark):
    raw = ["Quarter ended June 30, 2026 (Consolidated)", "q3 fy2026", "Half year ended September 2026", "six months ended March 31, 2026", "Year ended 31 March 2027", "Year ended March 2027", "", "H2FY2025", "odd"]
    assert values(spark, raw, S.period) == ["Q1 FY2027", "Q3 FY2026", "H1 FY2027", "H2 FY2026", "Year ended 31 March 2027", "FY2027", "", "H2 FY2025", "odd"]
    assert values(spark, ["Q1 FY2027", "FY2027", "H1 FY2027", "half"], S.period_kind) == ["quarterly", "annual", "annual", "half-yearly"]


def test_labels_equal_their_patterns(spark):
    """Substring search and one expression give what the whole alternation gives."""
    texts = ["Power TRANSMISSION line", "powerful", "An IT firm", "it is", "L&T bags metro", "bELt of Hals", "AI", "said", "Rail-coach, BANK and fmcg", ""]
    whole = [sorted(n for n, p in rules.SECTORS if re.search(p, t, re.I)) for t in texts]
    assert values(spark, texts, lambda x: C.labels(x, rules.SECTORS)) == whole


def test_update_by_url_can_lose_a_row(spark):
    old = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "url string, k string, v int")
    batch = spark.createDataFrame([("u1", "b", 3), ("u3", "c", 4), ("u3", "d", 5)], "url string, k string, v int")
    got = merge.update_or_insert(old, batch, "url", ["k"], F.col("v"))
    assert sorted(tuple(r) for r in got.collect()) == [("u2", "b", 2), ("u3", "d", 5)]
