"""Statements and extractions over texts and tables made from the order feed: every template of a known difficulty, with values of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import filings as X
from ..functions import rules
from ..functions import statements as S
from ..functions.stemming import stemmed_line
from ..operators.full_statements import clean_number, full_statements, page_units
from ..sources.scratch import spread
from .registry import Tables, query


def _orders(t: Tables) -> DataFrame:
    """id, v and p: a large and a smaller whole number, as text."""
    whole = F.floor("o_totalprice").cast("bigint")
    return spread(t.table("orders")).select(F.col("o_orderkey").alias("id"), (whole + 100).cast("string").alias("v"), (F.floor(whole / 10) + 100).cast("bigint").cast("string").alias("p"))


_V, _P = "CAST(floor(o_totalprice) AS DOUBLE) + 100", "floor(floor(o_totalprice) / 10) + 100"


def _pick(n: int, *choices) -> F.Column:
    return F.element_at(F.array(*choices), (F.col("id") % n + 1).cast("int"))


def _text(*parts) -> F.Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query(f"""SELECT id, revenue, pat FROM (SELECT o_orderkey AS id, CASE WHEN k IN (0, 1, 3, 4, 6) THEN {_V} + 0.5 END AS revenue, CASE WHEN k = 0 THEN -({_P} + 0.25) WHEN k IN (1, 2, 3, 5, 7) THEN {_P} + 0.25 END AS pat
FROM (SELECT *, o_orderkey % 9 AS k FROM orders)) WHERE revenue IS NOT NULL OR pat IS NOT NULL""")
def F35_line_values(t: Tables) -> DataFrame:
    v, p = F.concat("v", F.lit(".5")), F.concat("p", F.lit(".25"))
    pages = _orders(t).select("id", _pick(
        9,
        _text("Revenue from operations 1 ", v, " 900.0\nNet profit for the period (", p, ") 5"),
        _text("Revenue from operations\n", v, "\n(Loss)\nProfit for the year ended 30 June 2026\n", p),
        _text("Net Profit 819 809 1.3% 919\nNet profit ", p), _text("REVENUEFROMOPERATIONS ", v, "\nPl'ofit after tax ", p),
        _text("1 (a) Revenue from operations\n(i) Sale of goods 55.5\nTotal revenue from operations ", v), _text("Profit/(Lossl for the neriod ", p, " 7"),
        _text("Turnover - Nil\nTotal income ", v, "\nEarnings per share 1.25"), _text("Net profit of INR ", p, " Crs. (net margin: 13.1%)"), _text("The board met on 30 June 2026, ", v),
    ).alias("text"))
    wide = S.line_values(pages, "id", "text").groupBy("id").pivot("field", list(S.FIELDS)).agg(F.first("value"))
    return wide.select("id", "revenue", "pat").where("revenue is not null or pat is not null")


@query(f"""SELECT id, u.f AS field, CAST(u.x AS DOUBLE) AS value FROM (SELECT o_orderkey AS id, unnest(CASE WHEN k = 0 THEN [{{'f': 'revenue', 'x': {_V}}}, {{'f': 'pat', 'x': -({_P})}}] WHEN k = 1 THEN [{{'f': 'revenue', 'x': {_V}}}, {{'f': 'ebitda', 'x': 412.72}}, {{'f': 'pat', 'x': {_P}}}]
WHEN k = 5 THEN [{{'f': 'revenue', 'x': NULL}}, {{'f': 'pat', 'x': {_P}}}] ELSE [] END) AS u FROM (SELECT *, o_orderkey % 6 AS k FROM orders))""")
def F36_table_values(t: Tables) -> DataFrame:
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    v, p, none = F.col("v"), F.col("p"), F.lit(None).cast("string")
    tables = _orders(t).select("id", _pick(
        6,
        F.array(row(none, "Particulars", "30.06.2026", "31.03.2026"), row("1", "Revenue from operations", v, "1"), row("2", "Other income", "(3,900)", "-"), row("3", "Net profit for the period *", _text("(", p, ")"), "9")),
        F.array(row("Particulars", "quarter ended Jun 2026"), row("Revenue", v), row("EBITDA", "412 72"), row("PAT**", p)),
        F.array(row("", "Particulars", "30.06.2026"), row("1", "", v), row("2", "", v), row("3", "", v), row("4", "", v), row("5", "Net profit", p)),
        F.array(row("", "Particulars", "30.06.2026"), row("1", "Revenue\nOther income\nNet profit\nTax", v), row("2", "Tax", "1"), row("3", "Net profit", p)),
        F.array(row("", "Particulars", "no date"), row("1", "Revenue from operations", v), row("2", "Segment", "1"), row("3", "Net profit", p)),
        F.array(row("", "Particulars", "ended 31-03-2026"), row("1", "Profit/(Lossl for the neriod", p), row("2", "Revenue from operation s", "Nil"), row("3", "Total revenue from operations", v)),
    ).alias("t"))
    return S.table_values(tables, "id", "t").where(F.col("field").isin("revenue", "pat", "ebitda"))


_MONTH = "strftime(broadcast_date, '%B')"
_QFY = "concat('Q', CAST((CAST(floor((month(broadcast_date) - 1) / 3.0) AS INT) + 3) % 4 + 1 AS VARCHAR), ' FY', CAST(year(broadcast_date) + CASE WHEN month(broadcast_date) >= 4 THEN 1 ELSE 0 END AS VARCHAR))"


@query(f"""SELECT id, CASE id % 8 WHEN 0 THEN {_QFY} WHEN 1 THEN {_QFY} WHEN 2 THEN CASE WHEN month(broadcast_date) BETWEEN 7 AND 9 THEN concat('H1 FY', CAST(year(broadcast_date) + 1 AS VARCHAR)) ELSE concat('H2 FY', CAST(year(broadcast_date) AS VARCHAR)) END
WHEN 3 THEN concat('FY', CAST(year(broadcast_date) AS VARCHAR)) WHEN 4 THEN concat('Q', CAST(1 + id % 4 AS VARCHAR), ' FY2027') WHEN 5 THEN concat('H', CAST(1 + id % 2 AS VARCHAR), ' FY2026') WHEN 6 THEN 'nine months' ELSE '' END AS period FROM announcements""")
def F31_period_text(t: Tables) -> DataFrame:
    d, year = F.col("broadcast_date"), F.year("broadcast_date").cast("string")
    raw = _pick(
        8, _text("Quarter ended ", F.date_format(d, "MMMM"), " 30, ", year, " (Consolidated)"), _text("for the QUARTER ended ", F.lower(F.date_format(d, "MMM")), " ", year), _text("Half year ended ", F.date_format(d, "MMMM"), " ", year),
        _text("Year ended March 31, ", year, " (audited)"), _text("q", (1 + F.col("id") % 4).cast("string"), "FY2027"), _text("H", (1 + F.col("id") % 2).cast("string"), "  fy2026 (Standalone)"), F.lit("nine months (Unaudited) "), F.lit(""),
    )
    return t.announcements.select("id", S.period(raw).alias("period"))


_SECTIONED = """concat(repeat('h', CAST(id % 190 AS INT)), 'Standalone Statement of Profit and Loss one ', CASE WHEN id % 2 = 0 THEN 'Balance Sheet first ' ELSE '' END, CASE id % 3 WHEN 0 THEN 'Consolidated statement of profit & loss two ' WHEN 1 THEN 'Income statement three ' ELSE '' END,
CASE WHEN id % 5 = 0 THEN 'Balance  sheet second ' ELSE '' END, CASE WHEN id % 7 = 0 THEN 'Notes to the financial statements end' ELSE 'Statement of cash flows end' END)"""


@query(f"""SELECT id, concat('[', array_to_string(list_sort(list_filter([CASE WHEN first > 100 THEN 'header:' || first END, 'pnl:' || p, 'balance_sheet:' || b, 'last:' || z], lambda x: x IS NOT NULL)), ', '), ']') AS places FROM
(SELECT id, p, b, z, least(p, coalesce(b, p)) AS first FROM (SELECT id, CASE id % 3 WHEN 0 THEN instr(txt, 'Consolidated') - 1 WHEN 1 THEN instr(txt, 'Income') - 1 ELSE instr(txt, 'Standalone') - 1 END AS p,
CASE WHEN id % 5 = 0 THEN instr(txt, 'Balance  sheet') - 1 WHEN id % 2 = 0 THEN instr(txt, 'Balance Sheet') - 1 END AS b, CASE WHEN id % 7 = 0 THEN instr(txt, 'Notes') - 1 ELSE instr(txt, 'Statement of cash') - 1 END AS z FROM (SELECT id, {_SECTIONED} AS txt FROM announcements)))""")
def F41_sections(t: Tables) -> DataFrame:
    """Where each section of a filing begins; the text before the first is the header's length."""
    # one generator a step: a filter on what a projection has worked out would work it out again
    rows = t.wide("announcements").select("id", F.expr(_SECTIONED).alias("txt")).select("id", "txt", F.explode(F.array(S.section_starts(F.col("txt")))).alias("s"))
    rows = rows.select("id", "txt", "s", F.explode(F.array(S.sections(F.col("txt"), F.col("s")))).alias("m"))
    names = F.transform("s", lambda x: F.concat(F.when(x["name"].isin("notes", "cash_flow"), F.lit("last")).otherwise(x["name"]), F.lit(":"), x["at"].cast("string")))
    head = F.when(F.col("m")["header"].isNotNull(), F.array(F.concat(F.lit("header:"), F.length(F.col("m")["header"]).cast("string")))).otherwise(F.array().cast("array<string>"))
    # all parts together are the text from the first section, or its header, on
    whole = F.aggregate(F.map_values("m"), F.lit(0), lambda s, x: s + F.length(x)) == F.length("txt") - F.when(F.col("m")["header"].isNull(), F.get("s", 0)["at"]).otherwise(0)
    return rows.where(whole).select("id", F.concat(F.lit("["), F.array_join(F.array_sort(F.concat(head, names)), ", "), F.lit("]")).alias("places"))


@query("""SELECT symbol, arg_min(pat, period_no) FILTER (WHERE pat IS NOT NULL AND pat <> 0) AS pat, arg_min(period, period_no) FILTER (WHERE period_type = 'annual') AS period, CAST(COUNT(DISTINCT period_type) AS INT) AS kinds FROM results GROUP BY symbol""")
def F41_merged(t: Tables) -> DataFrame:
    parts = t.results.select("symbol", "period_no", "pat", F.when(F.col("period_type") == "annual", F.col("period")).otherwise("").alias("period"), F.array("period_type").alias("kinds"))
    return S.merged(parts, "symbol", "period_no", ["pat", "period"], ["kinds"]).select("symbol", "pat", "period", F.size("kinds").alias("kinds"))


_GOT = "CASE period_no % 7 WHEN 0 THEN revenue WHEN 1 THEN revenue * 1.01 WHEN 2 THEN revenue * 100 WHEN 3 THEN revenue * 10 WHEN 4 THEN NULL WHEN 5 THEN 0.0 ELSE revenue * 1.5 END"
_EXPECTED = "CASE WHEN period_no % 11 = 0 THEN NULL WHEN period_no % 13 = 0 THEN 0.0 ELSE revenue END"


@query(f"""SELECT symbol, period, CASE WHEN e IS NULL THEN TRUE WHEN g IS NULL THEN FALSE WHEN e = 0 THEN g = 0 ELSE abs(g - e) / abs(e) <= 0.02 END AS passed, CASE WHEN e IS NULL THEN 'no ground truth' WHEN g IS NULL THEN 'field missing' WHEN e = 0 AND g <> 0 THEN 'infinite'
WHEN e <> 0 AND abs(g - e) / abs(e) > 0.02 THEN concat(CAST(CAST(round(abs(g - e) / abs(e) * 100) AS INT) AS VARCHAR), '.0% error') ELSE '' END AS note,
CASE WHEN abs(g) / abs(nullif(e, 0)) > 80 AND abs(g) / abs(nullif(e, 0)) < 120 THEN 'revenue_cr: 100x' WHEN abs(g) / abs(nullif(e, 0)) > 8 AND abs(g) / abs(nullif(e, 0)) < 12 THEN 'revenue_cr: 10x' END AS unit, period_no % 5 <> 1 AS same_period,
CASE WHEN CAST(g IS NOT NULL AS INT) + CAST(pat IS NOT NULL AS INT) + 1 >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, {_GOT} AS g, {_EXPECTED} AS e FROM results)""")
def F46_eval_scores(t: Tables) -> DataFrame:
    """Scores of an extraction: number within 2 %, units, period, how sure it may be."""
    rows = t.results.select("symbol", "period", "period_no", "pat", F.expr(_GOT).alias("g"), F.expr(_EXPECTED).cast("double").alias("e"))
    x = S.numeric_score(F.col("g"), F.col("e"), 0.02)
    said = F.when(F.col("period_no") % 5 == 0, F.lit(None)).when(F.col("period_no") % 5 == 1, F.lit("Q9 FY1")).otherwise(F.concat(F.lit(" "), "period"))
    expected = F.when(F.col("period_no") % 5 == 0, "").otherwise(F.col("period"))
    nothing = F.lit(None).cast("double")
    return rows.select("symbol", "period", x.passed.alias("passed"), F.when(x.pct_err == float("inf"), "infinite").otherwise(x.note).alias("note"), S.unit_fault({"revenue_cr": F.col("g"), "pat_cr": nothing}, {"revenue_cr": F.col("e"), "pat_cr": F.col("pat")}).alias("unit"), S.period_match(said, expected).alias("same_period"), S.expected_confidence(F.col("g"), F.col("pat"), nothing, F.lit(1.0)).alias("confidence"))


_has = lambda p: f"regexp_matches(details, '{p}', 'i')"


@query(f"""SELECT id, CAST(CASE WHEN subject = 'Outcome of Board Meeting' THEN CASE WHEN {_has(rules.HIGH_VALUE_LEGACY)} THEN 9 WHEN {_has(rules.RESULTS)} THEN 8 ELSE 6 END WHEN subject IN ('Updates', 'Press Release') THEN CASE WHEN {_has(rules.LOW_VALUE)} THEN 0 WHEN {_has(rules.HIGH_VALUE_LEGACY)} THEN 8 ELSE 3 END
WHEN subject = 'Bagging/Receiving of orders/contracts' THEN CASE WHEN a >= 1000 THEN 13 WHEN a >= 500 THEN 12 WHEN a >= 100 THEN 11 ELSE 10 END WHEN subject = 'Dividend' THEN CASE WHEN d >= 5 THEN 5 WHEN d >= 1 THEN 4 WHEN d IS NOT NULL THEN 2 ELSE 4 END
WHEN subject = 'Appointment' THEN CASE WHEN {_has(rules.C_SUITE)} THEN 5 ELSE 1 END WHEN subject = 'Acquisition' THEN 9 ELSE 2 END AS INT) AS score FROM
(SELECT *, TRY_CAST(replace(nullif(regexp_extract(details, '{rules.MONEY[0][0]}', 1, 'i'), ''), ',', '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(details, '{rules.DIVIDEND}', 1, 'i'), '') AS DOUBLE) AS d FROM announcements)""")
def F2_legacy_score(t: Tables) -> DataFrame:
    return t.announcements.select("id", C.legacy_score(F.col("subject"), F.col("details")).cast("int").alias("score"))


_STOP = "[" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + "]"


# Words of the announcements and their Porter stems, from another implementation (SQLite's).
_STEMS = "MAP {'acquired': 'acquir', 'appointment': 'appoint', 'audited': 'audit', 'bagged': 'bag', 'clarification': 'clarif', 'closure': 'closur', 'coaches': 'coach', 'decline': 'declin', 'equity': 'equiti', 'expected': 'expect', 'government': 'govern', 'managing': 'manag', 'months': 'month', 'railway': 'railwai', 'results': 'result', 'revised': 'revis', 'software': 'softwar', 'trading': 'trade', 'value': 'valu', 'weeks': 'week', 'years': 'year'}"


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(details), '[a-z]{{3,}}'))), ' ') AS letters, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(details), '[a-z0-9]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)))), ' ') AS ranked,
array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(details, '[A-Za-z0-9&]+'), lambda x: lower(x)), regexp_extract_all(details, '[A-Za-z0-9&]+')))), ' ') AS mixed, array_to_string(list_sort(list_distinct(string_split_regex(lower(details), '\\W+'))), ' ') AS split,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(details), '[a-z0-9]+'), lambda x: coalesce(map_extract_value({_STEMS}, x), x)))), ' ') AS porter FROM announcements""")
def F9_tokenisers(t: Tables) -> DataFrame:
    """The five tokenisers over the same texts, as sorted sets; all within the row."""
    from ..functions.questions import said
    from ..operators.retrieval import mixed_tokens

    text = F.col("details")
    line = lambda words: F.array_join(F.array_sort(F.array_distinct(words)), " ")
    return t.wide("announcements").select("id", line(C.words(text)).alias("letters"), line(C.ranked_words(text)).alias("ranked"), line(mixed_tokens(text)).alias("mixed"), line(said(text)).alias("split"), stemmed_line(text).alias("porter"))


@query("""SELECT id, CASE WHEN u = 'year' THEN n * 12 WHEN u = 'week' THEN greatest(1, CAST(floor(n / 4.0 + 0.5) AS INT)) WHEN u = 'day' THEN greatest(1, CAST(floor(n / 30.0 + 0.5) AS INT)) ELSE n END AS months, CASE WHEN u = 'year' THEN n * 12 WHEN u = 'week' THEN CAST(floor(n / 4.3 + 0.5) AS INT) WHEN u = 'month' THEN n END AS stated FROM
(SELECT p_partkey AS id, CAST(p_size AS INT) AS n, CASE p_partkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'week' WHEN 2 THEN 'month' ELSE 'day' END AS u FROM part)""")
def F27_exec_months(t: Tables) -> DataFrame:
    """Both readings of a duration: any number with a unit, and one behind words like within or over."""
    unit = F.element_at(F.array(*map(F.lit, ("Year", "week", "MONTHS", "days"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("to be executed in "), F.col("p_size").cast("string"), F.lit(" "), unit, F.lit(", or 99 years"))
    return t.table("part").select(F.col("p_partkey").alias("id"), C.execution_months(text).alias("months"), X.duration_months(text).alias("stated"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN CAST(w AS DOUBLE) WHEN 1 THEN -CAST(w AS DOUBLE) WHEN 2 THEN w + c / 100.0::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN w * 1000.0 + 5 ELSE NULL END AS value FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS w, p_partkey % 90 + 10 AS c FROM part)""")
def F32_indian_numbers(t: Tables) -> DataFrame:
    """Cells of every known kind, with the table's numbers in them."""
    w, c = F.floor("p_retailprice").cast("string"), (F.col("p_partkey") % 90 + 10).cast("string")
    cell = F.element_at(F.array(_text(" ", w), _text("(", w, ")"), _text(w, " ", c), F.lit("Nil"), _text(w, ",005"), _text("x", w)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.table("part").select(F.col("p_partkey").alias("id"), C.indian_number(cell).alias("value"))


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.01::DOUBLE WHEN 4 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS factor FROM part")
def F34_unit_detect(t: Tables) -> DataFrame:
    name = F.col("p_name")
    text = F.element_at(F.array(_text(name, " (Rs. in lakhs)"), _text("All amounts are in INR million ", name), _text(name, " figures in crore"), _text(name, F.lit(" 2,94,270 1,00,000 3,00,000 4,00,000 5,00,000 6,00,000 7,00,000")), _text("no unit 12,345 ", name), _text("(₹ in Lacs, ", name, ")")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.table("part").select(F.col("p_partkey").alias("id"), C.unit_factor(text).cast("double").alias("factor"))


@query("""SELECT o_orderkey AS id, concat('C', CAST(o_custkey AS VARCHAR)) AS client, CASE WHEN o_orderkey % 2 = 0 THEN '12 months' END AS duration, CASE o_orderkey % 3 WHEN 0 THEN w * 1.0::DOUBLE WHEN 1 THEN floor((w * 100000 + 10000000) / 10000000.0 * 100 + 0.5) / 100 ELSE floor((w + 100000) / 100.0 * 100 + 0.5) / 100 END AS value_cr
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)""")
def F39_annexure(t: Tables) -> DataFrame:
    """An annexure's rows as fields, and its value cell in crore: with a unit, as rupees, as a number of lakhs."""
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    w = F.floor("o_totalprice").cast("bigint")
    value = F.element_at(F.array(_text("Rs. ", w.cast("string"), " Crore"), (w * 100000 + 10000000).cast("string"), (w + 100000).cast("string")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    client = F.concat(F.lit(" C"), F.col("o_custkey").cast("string"))
    rows = F.array(row("1", "Name of the entity awarding the contract", "", client), row("2", "Time period by which to be executed", F.when(F.col("o_orderkey") % 2 == 0, "12 months").otherwise(" ")), row("3", "Size of the order", value), row("4", "Name of the entity, again", "other"))
    found = t.table("orders").select(F.col("o_orderkey").alias("id"), X.annexure(rows).alias("m"))
    return found.select("id", F.col("m")["client"].alias("client"), F.col("m")["duration"].alias("duration"), X.rupees(F.col("m")["value"]).alias("value_cr"))


@query("""SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS letters, CAST(len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x IN ('the', 'and', 'of', 'to', 'in'))) AS BIGINT) AS common,
len(list_distinct(string_split(text, ''))) AS characters FROM documents""")
def F40_text_quality(t: Tables) -> DataFrame:
    """Counts that tell a garbled text: letters, common words, different characters."""
    text = F.col("text")
    common = F.size(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x.isin("the", "and", "of", "to", "in"))).cast("bigint")
    return t.table("documents").select("doc_id", F.length(text).cast("bigint").alias("n"), F.length(F.regexp_replace(text, "[^a-zA-Z]", "")).cast("bigint").alias("letters"), common.alias("common"), F.size(F.array_distinct(F.split(text, ""))).cast("bigint").alias("characters"))


# ---- whole statements


def _statement(head: str, v: F.Column, p: F.Column) -> F.Column:
    """A page whose cells stand on lines of their own: six items, five of them known, in three columns."""
    first = _text(head, "\nStatement of results for the quarter ended\n30.06.2026 31.03.2026 30th June, 2025\nParticulars\n1. Revenue from operations\n", v, "\n", p, "\n(12.5)\nOther\nincome\n10\n20\n30\nTotal income\n")
    return F.concat(first, v, F.lit("\n1,09,483,82\n("), p, F.lit(")\nExpenses\nEmployee benefit expense\n1\n2\n3\nProfit before tax\n5\nProfit after tax\n7\n8\n9\n. . .\nUnaudited\nEarnings per equity share\n1.5"))


@query(f"""SELECT id, CASE WHEN k IN (0, 1, 5) THEN 'standalone' ELSE 'unknown' END AS kind, CASE k WHEN 0 THEN 'Lakhs' WHEN 2 THEN 'Mn' ELSE 'Cr' END AS unit, CASE WHEN k = 1 THEN '30.06.2026' ELSE '30.06.2026 31.03.2026 30.06.2025' END AS headers,
CASE WHEN k = 1 THEN 2 ELSE 5 END AS quality, CASE WHEN k = 1 THEN 5 ELSE 6 END AS n_items, CAST(CASE WHEN k = 1 THEN {_P} ELSE {_V} END AS DOUBLE) AS revenue, CASE WHEN k <> 1 THEN 109483.82::DOUBLE END AS total_before, CASE WHEN k = 1 THEN 4.0::DOUBLE ELSE -CAST({_P} AS DOUBLE) END AS third,
CASE WHEN k = 1 THEN 'Net profit, Other income, Revenue from operations, Tax, Total income' ELSE 'Earnings per equity share, Expenses Employee benefit expense, Other income, Profit before tax Profit after tax, Revenue from operations, Total income' END AS labels
FROM (SELECT *, o_orderkey AS id, o_orderkey % 6 AS k FROM orders) WHERE k <> 4""")
def F36_full_statements(t: Tables) -> DataFrame:
    """Whole statements of documents with several pages and tables; standalone ones go first, then the better ones, then the earlier ones."""
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    v, p = F.col("v"), F.col("p")
    none = F.lit(None).cast("array<array<array<string>>>")
    table = F.array(row("Sr", "Particulars", "quarter ended 30.06.2026"), row("1", "Revenue from operations", p), row("", "Other income", "(3,900)", "4"), row("", "Total income", "", "", "4"), row("", "Tax", "Nil", "2"), row("", "Net profit", "5"), row("6", "7", "8"))
    page = lambda n, text, tables=none: F.struct(F.lit(n).alias("page_no"), text.alias("text"), tables.alias("tables"))
    full = lambda head: _statement(head, v, p)
    pages = F.when(F.col("id") % 6 == 0, F.array(page(1, full("Standalone, Rs. in Lakhs")))).when(F.col("id") % 6 == 1, F.array(page(1, full("Consolidated")), page(2, F.lit("Standalone income of the quarter"), F.array(table))))
    pages = pages.when(F.col("id") % 6 == 2, F.array(page(2, full("Results")), page(1, F.lit("All amounts in million")))).when(F.col("id") % 6 == 3, F.array(page(1, full("Results"), F.array(table, F.slice(table, 1, 3)))))
    pages = pages.when(F.col("id") % 6 == 4, F.array(page(1, full("Key Parameters")))).otherwise(F.array(page(2, _statement("Standalone", p, v)), page(1, full("Standalone, not consolidated"))))
    rows = _orders(t).select(F.col("id").alias("doc"), F.inline(pages))
    found = full_statements(rows)
    value = lambda label, i: F.get(F.col("items")[label], F.lit(i))
    labels = F.array_join(F.array_sort(F.map_keys("items")), ", ")
    return found.select(F.col("doc").alias("id"), "kind", "unit", F.array_join("headers", " ").alias("headers"), "quality", "n_items", value("Revenue from operations", 0).alias("revenue"), value("Total income", 1).alias("total_before"), value("Total income", 2).alias("third"), labels.alias("labels"))


@query("""SELECT id, page_no, CASE k WHEN 0 THEN CASE page_no WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.01::DOUBLE ELSE 0.1::DOUBLE END WHEN 1 THEN CASE page_no WHEN 2 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END WHEN 2 THEN CASE page_no WHEN 1 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END ELSE CASE page_no WHEN 3 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END END AS factor
FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS k, unnest([1, 2, 3]) AS page_no FROM orders)""")
def F34_unit_by_document(t: Tables) -> DataFrame:
    """Three pages a document. What a page declares decides, then how its numbers are grouped, then what the document declares first."""
    lakhs = " ".join(f"{n},00,000" for n in range(1, 8))
    texts = F.when(F.col("id") % 4 == 0, F.array(_text("(INR in million) ", "v"), F.lit(lakhs), _text("total ", "v"))).when(F.col("id") % 4 == 1, F.array(_text("no unit ", "p"), F.lit(lakhs), _text("Rs. in crore ", "v")))
    texts = texts.when(F.col("id") % 4 == 2, F.array(F.lit(lakhs), _text("6 numbers ", F.lit(lakhs[:-9])), _text("nothing ", "v"))).otherwise(F.array(_text("v", " only"), _text("All amounts are in INR lakh ", "v"), _text("in mn. ", F.lit(lakhs))))
    pages = _orders(t).withColumns({"v": F.col("v"), "p": F.col("p")}).select(F.col("id").alias("doc"), F.posexplode(texts).alias("at", "text")).select("doc", (F.col("at") + 1).alias("page_no"), "text")
    return page_units(pages).select(F.col("doc").alias("id"), "page_no", "factor")


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN w + c / 100.0::DOUBLE WHEN 1 THEN w * 100.0::DOUBLE + c WHEN 2 THEN -(w + c / 100.0::DOUBLE) WHEN 3 THEN w + c / 100.0::DOUBLE WHEN 4 THEN w * 1000.0::DOUBLE + 5 WHEN 5 THEN NULL ELSE w * 1.0::DOUBLE END AS value
FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS w, p_partkey % 90 + 10 AS c FROM part)""")
def F32_comma_decimals(t: Tables) -> DataFrame:
    """The second reader of cells: a comma in front of two last digits marks decimals, unless there is a period."""
    w, c = F.floor("p_retailprice").cast("string"), (F.col("p_partkey") % 90 + 10).cast("string")
    cell = F.element_at(F.array(_text(w, ",", c), _text(w, ",", c, ".0"), _text(" (", w, ",", c, ") "), _text(w, " ", c), _text(w, " 005"), _text("- ", w, "x"), _text(w, ".")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.table("part").select(F.col("p_partkey").alias("id"), clean_number(cell).alias("value"))
