"""Statements are read within a page's row: what is shuffled is what was found on the pages, by document, and no line."""

from pyspark.sql import functions as F

from bourselake.operators import full_statements as S

SHAPE = "doc string, page_no int, text string, tables array<array<array<string>>>"
BODY = "30.06.2026 31.03.2026\nRevenue from operations\n1\n2\n3\nTotal income\n4\n5\n6\nProfit before tax\n1\n1\n1\nProfit after tax\n2\n2\n2\nCosts\n3\n3\n3"


def test_no_line_is_shuffled(spark):
    rows = spark.createDataFrame([("a", 1, BODY, None)], SHAPE)
    plan = S.full_statements(rows)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(") == 1 and "Join" not in initial


def test_odd_pages(spark):
    blanks = " \t" * 20_000
    pages = [
        ("begins with numbers", 1, "7\n8\n9\nincome\n" + BODY.replace("30.06.2026 31.03.2026\n", ""), None),
        ("blanks", 1, blanks + "\r\n \n" + BODY.replace("\n", blanks[:200] + "\n\n \t") + blanks + "\nx" + blanks, None),
        ("twice", 1, BODY + "\nCosts\n8\n8\n8", None),
        ("two kinds", 1, "standalone, Rs. in lakhs\n" + BODY, [[["Particulars", "quarter ended 30.06.2026"], ["Revenue", "1"], ["Total income", "2"], ["Tax", "3"], ["Net", "4"], ["Other income", "5"]]]),
        ("only later", 3, "profit", None), ("only later", 2, "amounts in million", None), ("only later", 4, BODY, None),
        ("nothing", 1, "", [None]), ("nothing", 2, None, None), (None, 1, BODY, None),
    ]
    got = {r.doc: r for r in S.full_statements(spark.createDataFrame(pages, SHAPE)).collect()}
    assert set(got) == {"begins with numbers", "blanks", "twice", "two kinds", "only later"}
    assert got["twice"]["items"]["Costs"] == [8.0, 8.0, 8.0, None] and got["twice"].n_items == 5 and got["twice"].quality == 4
    assert got["blanks"]["items"].keys() == got["twice"]["items"].keys() and got["blanks"].headers == ["30.06.2026", "31.03.2026"]
    assert got["begins with numbers"].headers == [] and got["begins with numbers"].n_items == 5
    # the table has one known label, the text four
    assert (got["two kinds"].kind, got["two kinds"].unit, got["two kinds"].quality) == ("standalone", "Lakhs", 4)
    assert got["only later"].unit == "Mn"


def test_numbers_as_before(spark):
    cells = ["12", "0012.50", "12.", "1,09,483,82", "(5 10)", " 7 ", "7\n", "1.2.3", "-4", "", "x"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r.v for r in rows.select(S.clean_number(F.col("c")).alias("v")).collect()] == [12.0, 12.5, 12.0, 109483.82, -5.1, 7.0, 7.0, None, -4.0, None, None]
