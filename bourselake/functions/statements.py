"""Reading statements: periods as they are written, profit-and-loss lines and tables, sections of long filings, text quality, scores of an extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filings
from .columns import indian_number, let

# Month names, labels, patterns and phrases must be these for the results to be right.

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FULL_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
QUALIFIER = r"(?i)\s*\((?:Consolidated|Standalone|Audited|Unaudited)\)\s*$"
ENDED = r"\s+ended\s+(\w+)\s+(?:\d{1,2}[,. ]+)?(\d{4})"
OCR_PROFIT = ["profit for the eriod", "profit for the ear", "net profit for the eriod", "net profit for the ear"]
OCR_LOSS = r"(?i)\bprofit[/(]\(?l[o0]ss[l)]\)?\s+for\s+the\s+(?:[pn]eri[o0]d|[vy]ear)\b"
EXCEPTIONAL = ["profit/(loss) before exceptional items and tax", "profit before exceptional items and tax", "loss before exceptional items and tax"]
DATE_WORDS = r"(?i)\b(march|june|sept|dec|jan|feb|apr|may|jul|aug|oct|nov|fy|quarter|ended|period)\b"
TABLE_PERIOD = r"(?i)\b(3[01])[.\-/](0[1-9]|1[0-2])[.\-/](20\d{2})\b|\b(march|june|sept|dec|quarter|ended|preceding|corresponding)\b"
TABLE_WORDS = ["revenue", "income", "profit", "loss", "sales", "expenditure", "ebitda"]
DATE_CELL = r"(?i)\d{2}[.\-/]\w+[.\-/]?\d{2,4}|\bjun\b|\bmar\b|\bsep\b|\bdec\b"
SECTIONS = {
    "pnl": r"(?i)(?:(?:standalone|consolidated)\s+)?(?:statement\s+of\s+profit\s+(?:and|&)\s+loss|profit\s+(?:and|&)\s+loss\s+(?:account|statement)|income\s+(?:and\s+expenditure\s+)?statement)",
    "balance_sheet": r"(?i)(?:(?:standalone|consolidated)\s+)?balance\s+sheet|statement\s+of\s+(?:financial\s+)?position",
    "cash_flow": r"(?i)cash\s+flow\s+statement|statement\s+of\s+cash\s+flows?",
    "notes": r"(?i)notes?\s+(?:to|forming\s+part\s+of)\s+(?:the\s+)?(?:financial\s+statements?|accounts?)",
}
AUDIT = ["independent auditor", "limited review report", "we have reviewed", "statutory auditor", "management's responsibility", "basis of review", "qualified conclusion", "emphasis of matter", "auditor's responsibility"]
STATEMENT = ["revenue from operations", "net sales", "turnover", "profit after tax", "profit before tax", "total income", "earnings per share", "basic eps"]
FIELDS = {**filings.STATEMENT_ROWS, "pat": filings.STATEMENT_ROWS["pat"] + OCR_PROFIT, "pbt": filings.STATEMENT_ROWS["pbt"] + EXCEPTIONAL}


# ---- periods


def _month(name: Column) -> Column:
    """1 to 12 of a month's full or three-letter name, null for anything else."""
    low = F.lower(name)
    return F.nullif(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), low), F.lit(0).cast("long")), F.array_position(F.array(*map(F.lit, FULL_MONTHS)), low)), F.lit(0).cast("long"))


def period(raw: Column) -> Column:
    """'Qn FYyyyy', 'Hn FYyyyy' or 'FYyyyy' of a period as it is written; what is none of the known ways stays, without its qualifier."""
    text = F.trim(F.regexp_replace(raw, QUALIFIER, ""))
    part = lambda p, n: F.nullif(F.regexp_extract(text, "(?i)" + p, n), F.lit(""))
    short = F.concat(F.upper(part(r"^([QH][1-4])\s*FY(\d{4})$", 1)), F.lit(" FY"), part(r"^([QH][1-4])\s*FY(\d{4})$", 2))
    short = F.when(F.upper(text).rlike(r"^H[34]"), None).otherwise(short)
    month, year = _month(part("quarter" + ENDED, 1)), part("quarter" + ENDED, 2).try_cast("int")
    quarter = F.concat(F.lit("Q"), (F.pmod(F.floor((month - 1) / 3) - 1, F.lit(4)) + 1).cast("string"), F.lit(" FY"), (year + (month > 3).cast("int")).cast("string"))
    half = r"(?:six\s+months|half\s+year)" + ENDED
    month, year = _month(part(half, 1)), part(half, 2).try_cast("int")
    halves = F.when(month.between(7, 9), F.concat(F.lit("H1 FY"), (year + 1).cast("string"))).when(month.isNotNull(), F.concat(F.lit("H2 FY"), year.cast("string")))
    whole = F.concat(F.lit("FY"), part("year" + ENDED, 2))
    return F.when(raw == "", raw).otherwise(F.coalesce(short, quarter, halves, whole, text))


def period_kind(period_: Column) -> Column:
    """annual, half-yearly or quarterly."""
    low = F.lower(period_)
    return F.when(low.rlike("fy|year|annual|march|31-mar") & ~low.contains("q"), "annual").when(low.rlike("h1|h2|half"), "half-yearly").otherwise("quarterly")


# ---- lines


def _named(low: Column, bare: Column, clean: Column) -> Column:
    """Of each field the first name that a line holds: array of (field, n). As it stands (low: lower-cased), without blanks (bare), or with r for l' (clean). The names are one constant, so the code stays small."""
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("n"), F.lit(n.replace(" ", "")).alias("b")) for f, names in FIELDS.items() for n in names])
    # a line that holds a name as it stands holds it without blanks too
    held = F.when(clean == low, F.filter(table, lambda x: bare.contains(x.b))).otherwise(F.filter(table, lambda x: bare.contains(x.b) | clean.contains(x.n)))
    first = lambda hs: F.filter(hs, lambda x, i: (i == 0) | (F.get(hs, i - 1)["field"] != x["field"]))
    return F.transform(let(held, first), lambda x: F.struct(x["field"].alias("field"), x["n"].alias("n")))


def _value(text: Column, line: Column) -> Column:
    """The first number, unless it is a calendar year in a line on dates, or one of a line with growth rates in it (but for those in parentheses)."""
    rates = F.regexp_replace(text, r"\([^)]*\)", "").rlike(r"\d+\.\d+%")
    return let(filings.first_number(text), lambda v: F.when(~(v.between(2020, 2030) & line.rlike(DATE_WORDS)) & ~rates, v))


def line_values(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, field, value: of each field the first line that names it and gives a value, there or on the next line.

    The next line is not read behind a header like (a), nor where it is a sub-item. A profit line that is garbled by text recognition
    counts where no other names it. A key is a page; a row is a line with its next one, and only lines that name a field are shuffled.
    """
    held = pages.select(key, F.explode(F.array(F.split(text, "\n"))).alias("_ls")).where("_ls is not null")
    behind = F.slice("_ls", 2, F.greatest(F.size("_ls") - 1, F.lit(0)))
    lines = held.select(key, F.posexplode(F.arrays_zip(F.col("_ls").alias("line"), behind.alias("next"))).alias("at", "_x")).select(key, "at", "_x.line", "_x.next")
    low = F.lower("line")
    lines = lines.withColumns({"low": low, "bare": F.regexp_replace(low, r"\s+", ""), "clean": F.regexp_replace(low, "l['’`]", "r")})
    header = F.col("line").rlike(r"^\s*\d*\s*\([a-zA-Z]\)")
    item = F.ltrim("next").rlike(r"^\([a-zA-Z0-9]{1,3}\)|^[ivxlIVXL]+[.)]\s|^[a-zA-Z]\)")
    garbled = F.when(F.col("line").rlike(OCR_LOSS), F.array(F.struct(F.lit("pat").alias("field"), F.lit(None).cast("string").alias("n")))).otherwise(F.array().cast("array<struct<field:string,n:string>>"))
    hits = lines.select(key, "at", "line", "next", "low", F.inline(F.concat(_named(F.col("low"), F.col("bare"), F.col("clean")), garbled)))
    behind = F.when(F.col("n").isNull(), F.regexp_replace(F.col("line"), "^.*?" + OCR_LOSS.replace("(?i)", "(?i:") + ")", "")).when(F.col("low").contains(F.col("n")), F.substring(F.col("line"), F.position("n", "low") + F.length("n"), F.length("line"))).otherwise(F.col("line"))
    there = F.when(F.col("next").isNotNull() & ~header & ~item, _value(F.col("next"), F.col("next")))
    # from a generator: the filter would else work the values out a second time
    values = hits.select(key, "field", F.col("n").isNull().cast("long").alias("rank"), "at", "line", "next", F.explode(F.array(behind)).alias("rest"))
    values = values.select(key, "field", "rank", "at", F.explode(F.array(F.coalesce(_value(F.col("rest"), F.col("line")), there))).alias("value")).where("value is not null")
    # one number for (rank, at): the aggregate stays in fixed-width buffers, without a sort
    return values.groupBy(key, "field").agg(F.min_by("value", F.col("rank") * F.lit(1 << 32) + F.col("at")).alias("value"))


# ---- tables


def _joined(table: Column, rows: int) -> Column:
    cells = F.flatten(F.transform(F.slice(table, 1, rows), lambda r: F.coalesce(r, F.array().cast("array<string>"))))
    return F.lower(F.array_join(F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != ""), " "))


def is_statement_table(table: Column) -> Column:
    """Four rows or more, a period in the first five, the structure of a statement and words of one in the first six."""
    built = lambda body: (body.contains("particular") | (body.contains("ebitda") & body.rlike("revenue|profit|pat"))) & body.rlike("|".join(TABLE_WORDS))
    return (F.size(table) >= 4) & _joined(table, 5).rlike(TABLE_PERIOD) & let(_joined(table, 6), built)


def data_column(table: Column) -> Column:
    """The first column (from 0, never 0) with a date in the first five rows, else with a number in rows 4 to 8, else 2."""
    def first(rows: Column, fits) -> Column:
        places = F.transform(rows, lambda r: F.get(F.filter(F.transform(r, lambda c, i: F.when((i > 0) & F.coalesce(fits(c), F.lit(False)), i)), lambda i: i.isNotNull()), 0))
        return F.get(F.filter(places, lambda i: i.isNotNull()), 0)

    return F.coalesce(first(F.slice(table, 1, 5), lambda c: c.rlike(DATE_CELL)), first(F.slice(table, 4, 5), lambda c: indian_number(c).isNotNull()), F.lit(2))


def table_values(tables: DataFrame, key: str, table: str) -> DataFrame:
    """key, field, value of tables that are statements: of each field the first row that names it.

    Labels are in column 0 where the data begin in column 1, else in column 1. A table whose labels are mostly empty (55 % of over four
    rows), or has four lines or more in one label, was not read right and gives nothing. A null value of the first row named stays null.
    """
    # each step's values come from a generator: a filter is not pushed below it, so they are worked out once and not again for each use
    rows = tables.where(is_statement_table(F.col(table))).select(key, F.col(table).alias("_t"), F.explode(F.array(data_column(F.col(table)))).alias("_c")).withColumn("_l", F.when(F.col("_c") <= 1, 0).otherwise(1))
    labels = F.transform(F.filter("_t", lambda r: F.size(r) > F.col("_l")), lambda r: F.coalesce(F.get(r, F.col("_l")), F.lit("")))
    empty = lambda ls: F.size(F.filter(ls, lambda x: F.trim(x) == ""))
    fine = let(labels, lambda ls: ~((F.size(ls) > 4) & (empty(ls) / F.size(ls) >= 0.55)) & ~F.exists(ls, lambda x: F.length(F.regexp_replace(x, "[^\n]", "")) >= 3))
    lines = rows.where(fine).select(key, "_c", "_l", F.posexplode("_t").alias("at", "r")).where(F.size("r") > F.col("_c"))
    name = F.trim(F.regexp_replace(F.coalesce(F.get("r", F.col("_l")), F.lit("")), r"[*#†]+$", ""))
    lines = lines.select(key, "at", F.get("r", F.col("_c")).alias("cell"), F.explode(F.array(name)).alias("name"))
    lines = lines.select(key, "at", "cell", "name", F.explode(F.array(F.lower(F.trim("name")))).alias("low"))
    lines = lines.select(key, "at", "cell", "name", "low", F.inline(F.array(F.struct(F.regexp_replace("low", r"\s+", "").alias("bare"), F.regexp_replace("low", "l['’`]", "r").alias("clean")))))
    low, bare, clean = F.col("low"), F.col("bare"), F.col("clean")
    short = F.when(low == "revenue", F.lit("revenue")).when((low == "pat") | F.col("name").rlike(OCR_LOSS), F.lit("pat")).when(low == "ebitda", F.lit("ebitda"))
    table_of = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(n.replace(" ", "")).alias("b")) for n in names]).alias("names")) for f, names in FIELDS.items()])
    named = lambda x: bare.contains(x.b) | ((clean != low) & clean.contains(x.n))
    found = let(short, lambda s: F.transform(F.filter(table_of, lambda x: F.coalesce(x.field == s, F.lit(False)) | F.exists(x.names, named)), lambda x: x.field))
    hits = lines.select(key, "at", "cell", F.explode(found).alias("field")).select(key, "at", "field", indian_number(F.col("cell")).alias("value"))
    return hits.groupBy(key, "field").agg(F.min_by(F.struct("value"), "at").alias("x")).select(key, "field", "x.value")


# ---- sections and merging


def section_starts(text: Column) -> Column:
    """Array of (at from 0, name) of the sections that a filing has, by their place. Of several matches the first that says consolidated counts, else the last."""
    return F.array_sort(F.array_compact(F.array(*[_section(text, name, p) for name, p in SECTIONS.items()])))


def _section(text: Column, name: str, pattern: str) -> Column:
    def chosen(x: Column) -> Column:
        found, pieces = x["found"], x["pieces"]
        said = F.array_position(F.transform(found, lambda m: F.lower(m).contains("consolidated")), True).cast("int")
        n = F.when((F.size(found) > 1) & (said > 0), said - 1).otherwise(F.size(found) - 1)
        total = lambda parts: F.aggregate(parts, F.lit(0), lambda s, part: s + F.length(part))
        # a match's place: behind the pieces and the matches before it
        place = let(n, lambda k: total(F.slice(pieces, 1, k + 1)) + total(F.slice(found, 1, k)))
        return F.when(F.size(found) > 0, F.struct(place.alias("at"), F.lit(name).alias("name")))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("pieces")), chosen)


def sections(text: Column, starts: Column | None = None) -> Column:
    """map name -> text: each section up to the next; `header` for over 100 characters before the first, and for a text without any. starts: section_starts of the text, where a column has them."""
    def cut(starts: Column) -> Column:
        ends = F.concat(F.transform(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda s: s.at), F.array(F.length(text)))
        own = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(x["s"]["name"].alias("name"), F.substring(text, x["s"]["at"] + 1, x["e"] - x["s"]["at"]).alias("text")))
        first = F.get(starts, 0).at
        head = F.when(first > 100, F.array(F.struct(F.lit("header").alias("name"), F.substring(text, F.lit(1), first).alias("text")))).otherwise(F.slice(own, 1, 0))
        return F.when(F.size(starts) == 0, F.map_from_arrays(F.array(F.lit("header")), F.array(text))).otherwise(F.map_from_entries(F.concat(head, own)))

    return let(section_starts(text) if starts is None else starts, cut)


def merged(parts: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row for each key: of each scalar the first value that is there (not null, empty or zero), of each list the distinct items in order of their coming."""
    there = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)) != 0), F.col(c))
    first = [F.min_by(F.col(c), F.when(there(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    held = lambda c: F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v"))))
    union = [F.array_distinct(F.flatten(F.transform(held(c), lambda x: x["v"]))).alias(c) for c in lists]
    return parts.groupBy(key).agg(*first, *union)


# ---- quality and scores


def is_audit_only(text: Column) -> Column:
    """Two phrases of an auditor's letter or more, and none of a statement."""
    low = F.lower(text)
    return (sum((low.contains(p).cast("int") for p in AUDIT), F.lit(0)) >= 2) & ~reduce(lambda a, b: a | b, [low.contains(p) for p in STATEMENT])


NUMERIC = ["revenue_cr", "pat_cr", "eps", "ebitda_margin_pct", "ebitda_cr"]


def numeric_score(got: Column, expected: Column, tolerance: float) -> Column:
    """struct of passed, pct_err (share), note of one number against its truth."""
    error = F.when(expected == 0, F.when(got == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(got - expected) / F.abs(expected))
    passed = F.when(expected.isNull(), True).when(got.isNull(), False).otherwise(error <= tolerance)
    said = F.when(expected.isNull(), "no ground truth").when(got.isNull(), "field missing").when(~passed, F.concat(F.format_string("%.1f", error * 100), F.lit("% error"))).otherwise("")
    return F.struct(passed.alias("passed"), F.when(expected.isNotNull(), error).alias("pct_err"), said.alias("note"))


def unit_fault(got: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Which of revenue and profit is a hundred or ten times too large, and by which of the two; null if neither is. Truths of zero are passed over."""
    tests = []
    for name in ("revenue_cr", "pat_cr"):
        ratio = F.abs(got[name]) / F.abs(F.nullif(expected[name], F.lit(0.0)))
        tests += [F.when((ratio > 80) & (ratio < 120), F.lit(f"{name}: 100x")), F.when((ratio > 8) & (ratio < 12), F.lit(f"{name}: 10x"))]
    return F.coalesce(*tests)


def period_match(got: Column, expected: Column) -> Column:
    """True where the two are equal but for blanks around them, or nothing is expected."""
    return F.when(F.coalesce(expected, F.lit("")) == "", True).otherwise(F.trim(F.coalesce(got, F.lit(""))) == F.trim(expected))


def expected_confidence(revenue: Column, profit: Column, ebitda: Column, eps: Column) -> Column:
    """high for three values or more, medium for one or two, low for none."""
    filled = sum((c.isNotNull().cast("int") for c in (revenue, profit, ebitda, eps)), F.lit(0))
    return F.when(filled >= 3, "high").when(filled >= 1, "medium").otherwise("low")

