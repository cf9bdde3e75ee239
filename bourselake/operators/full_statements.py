"""Whole statements out of filings' pages: every line item with its columns, the best of several tables, units by document.

Pages are rows (doc, page_no, text, tables). Two readers give items. The one for bordered tables takes a row's first cell that is no number as
the label and the cells behind it as columns. The one for texts, where each cell stands on a line of its own, is a state machine over lines,
written over arrays within the page's row: numbers in a row close a label when there are as many as the page has columns; fewer are given up at
the next text, whose words go on with the label; a label has three lines at most. No line is shuffled: a document's pages meet as the statements found on them.

A candidate's quality is the number of its known labels. Of a document the best candidate of the preferred kind wins: standalone, then unknown, then
consolidated; by quality, then items, then the earlier one. A null text or table has nothing in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import group, let

# Patterns, words and limits must be these for the results to be right.
NUMBER_CELL = r"^-?\(?\d[\d,\.\s]*\)?$"
NUMBER_LINE = r"^-?\(?\d[\d,\.]*\)?$"
DATE_HEADER = r"\b(?:3[01])[.\-/](?:0[1-9]|1[0-2])[.\-/](?:20\d{2})\b"
DATE_NUMBER = r"\b(?:3[01]|[012]\d)[.\-/](?:0[1-9]|1[0-2])[.\-/](?:20\d{2})\b"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DATE_WORDS = r"(?i)\b(?:\d{1,2})(?:st|nd|rd|th)?[,\.\s]+(?:" + "|".join(MONTHS) + r")[,\.\s]+(?:20\d{2})\b"
YEAR = r"20\d{2}"  # every date that is read has one
JUNE, JULY = r"(?i)\bJ[a-z]n[a-z]\b", r"(?i)\bJ[a-z][ln][yv]\b"
UNIT = r"(?i)(?:(?:rs\.?|rupees?|inr|amount|₹)\s*in\s*|in\s+(?:rs\.?\s*)?)(crore|lakh|lacs?|million|thousand)"
NOISE = r"(?i)^(?:unaudited|audited|refer\s+note|quarter\s+ended|year\s+ended|months?\s+ended|preceding|corresponding|for\s+the|standalone|consolidated|sr\.?\s*no|sl\.?\s*no|particulars?\s*$)"
TWO_LETTERS = "[a-zA-Z0-9][^a-zA-Z0-9]*[a-zA-Z0-9]"  # a line with fewer, as one of decoration, says nothing
TITLE = r"(?i)financial\s+results?|results?\s+for|quarter\s+ended|year\s+ended"
SUMMARY = r"(?i)\bKey\s+Parameters?\b|\bGroup\s+Performance\b|\bBusiness\s+Performance\b|\bPerformance\s+Highlights?\b"
SUMMARY_WORDS = ["parameter", "performance"]
ANCHORS = ["revenue from oper", "total income", "profit before tax", "profit for the period", "profit after tax", "employee benefit", "total expenses", "earnings per equity"]
BEGIN = ["revenue from oper", "total income", "interest earned", "net interest income", "income from operation"]
PAGE_WORDS = ["revenue", "income", "profit", "interest earned"]
PERIOD_WORDS = ["quarter", "ended", "preceding", "corresponding"]
BODY_WORDS = ["revenue", "income", "interest earned", "total income", "profit"]
UNIT_WORDS = ["crore", "lakh", "lac", "million", "thousand"]
COLUMNS, LABEL_LINES, LEAST_ITEMS = 4, 3, 5
#: A page's text comes behind its tables.
BEHIND = 2**31 - 1

_AT = ["doc", "page_no"]


def clean_number(cell: Column) -> Column:
    """A cell's number: parentheses are negative; without a period a last group of two digits behind a comma, or behind a blank, is decimals."""

    def read(s: Column) -> Column:
        bare = F.regexp_replace(s, r"^[()]+|[()]+$", "")
        grouped = F.regexp_extract(bare, r"^([\d,]+),(\d{2})$", 1)
        decimals = F.concat(F.replace(grouped, F.lit(","), F.lit("")), F.lit("."), F.regexp_extract(bare, r"^([\d,]+),(\d{2})$", 2))
        plain = F.when(~bare.contains(".") & (grouped != ""), decimals).otherwise(F.replace(bare, F.lit(","), F.lit("")))
        spaced = F.regexp_replace(F.trim(plain), r"\s+(\d{2})$", ".$1")
        joined = let(F.regexp_replace(F.when(F.trim(plain).rlike(r"\s\d{2}$"), spaced).otherwise(plain), r"\s", ""), lambda x: F.when(x.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)$"), x.try_cast("double")))
        return F.when(s.startswith("(") & s.endswith(")"), -joined).otherwise(joined)

    # most cells are digits and perhaps a period, which need no reading
    return F.when(cell.rlike(r"^\d+(?:\.\d+)?$"), cell.try_cast("double")).otherwise(let(F.regexp_replace(cell, r"^\s+|\s+$", ""), read))


def clean_label(text: Column) -> Column:
    """Without a row's number, blanks joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^\d+[a-z]?[\.\)]\s*", ""), r"\s+", " "))


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def line_dates(line: Column) -> Column:
    """The dates of a line as dd.mm.yyyy, those in numbers first; months that text recognition garbles are read as June and July."""
    mended = F.when(line.rlike("[Jj]"), F.regexp_replace(F.regexp_replace(line, JUNE, "June"), JULY, "July")).otherwise(line)

    def of(found: Column) -> Column:
        low = F.lower(found)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, "(" + "|".join(MONTHS) + ")", 1))
        return F.concat(F.lpad(F.regexp_extract(low, r"^(\d+)", 1), 2, "0"), F.lit("."), F.lpad(month.cast("string"), 2, "0"), F.lit("."), F.right(found, F.lit(4)))

    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(DATE_NUMBER), 0), lambda d: F.translate(d, "-/", ".."))
    return let(mended, lambda x: F.concat(numbers(x), F.transform(F.regexp_extract_all(x, F.lit(DATE_WORDS), 0), of)))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Further columns, worked out once a row: they go through a generator, so that what uses them does not work them out again."""
    return rows.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_new")).select(*rows.columns, F.inline(F.array("_new")))


def _holds(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _with_kind(pages: DataFrame) -> DataFrame:
    """kind: standalone, consolidated or unknown, by what comes first on a page's head."""
    place = lambda word: F.when(F.col("_head").contains(word), F.regexp_instr("_head", F.lit(rf"\b{word}\b")))
    rows = _once(_once(pages, _head=F.lower(F.substring("text", 1, 2000))), _alone=place("standalone"), _whole=place("consolidated"))
    alone, whole = F.nullif("_alone", F.lit(0)), F.nullif("_whole", F.lit(0))
    kind = F.when(alone.isNull() & whole.isNull(), "unknown").when(whole.isNull() | (alone < whole), "standalone").otherwise("consolidated")
    return rows.withColumn("kind", kind).drop("_head", "_alone", "_whole")


def page_units(pages: DataFrame) -> DataFrame:
    """doc, page_no, factor (to crore): what the page declares, else lakh where seven numbers or more are grouped that way, else what the document declares first, else 1."""
    named = F.lower(F.rtrim(F.coalesce(*[group(F.col("text"), rules.UNITS, i) for i in range(1, 6)]), F.lit(".")))
    declared = F.when(named.isin("million", "mn"), 0.1).when(named.isin("lakh", "lakhs", "lac", "lacs"), 0.01).when(named.isNotNull(), 1.0)
    guessed = F.when(F.size(F.regexp_extract_all("text", F.lit(f"({rules.LAKH_NUMBER})"), 1)) >= 7, 0.01)
    rows = pages.select(*_AT, declared.alias("declared"), guessed.alias("guessed"))
    first = F.first("declared", ignorenulls=True).over(Window.partitionBy("doc").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*_AT, F.coalesce("declared", "guessed", first, F.lit(1.0)).alias("factor"))


def _lines(text: Column) -> Column:
    """The lines of a text that are not empty, without blanks around them. Blanks are looked through from where they begin only."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?<!\s)\s*\n\s*"))


def _is_number(line: Column) -> Column:
    """True for a number, false for words that can stand in a label, null for other lines."""
    date = line.rlike(YEAR) & (line.rlike(DATE_NUMBER) | line.rlike(DATE_WORDS))
    return F.when(line.rlike(NUMBER_LINE), True).when(line.rlike(TWO_LETTERS) & ~line.rlike(NOISE) & ~date, False)


def text_items(pages: DataFrame) -> DataFrame:
    """doc, page_no, headers, label, values, at (from 0): the items of pages whose cells stand on lines of their own."""
    return _read_texts(pages.select(*_AT, "text")).select(*_AT, "headers", F.posexplode("items").alias("at", "x")).select(*_AT, "headers", "x.*", "at")


def _read_texts(pages: DataFrame) -> DataFrame:
    """The given columns but for text, then headers and items (array of label and values, as they come). All within the row."""
    given = [c for c in pages.columns if c != "text"]
    rows = _once(pages, low=F.lower("text"))
    rows = _once(rows, place=F.regexp_instr("low", F.lit("|".join(BEGIN))))
    begin = F.when(F.col("place") > 0, F.size(_lines(F.left("low", F.col("place")))) - 1).otherwise(0)
    rows = _once(rows, lines=F.coalesce(_lines(F.col("text")), F.array().cast("array<string>")), begin=begin).drop("text", "low", "place")
    # the first line with two dates or more has the headers, else the first few others with one
    dates = lambda line: let(line_dates(line), lambda ds: F.when(F.size(ds) > 0, F.struct(ds.alias("dates"), (~line.rlike(TITLE)).alias("other"))))
    rows = _once(rows, dated=F.array_compact(F.transform(F.filter("lines", lambda line: line.rlike(YEAR)), dates)))
    row = F.get(F.filter("dated", lambda x: F.size(x.dates) >= 2), 0)["dates"]
    others = F.flatten(F.transform(F.slice(F.filter("dated", lambda x: x.other), 1, COLUMNS), lambda x: x.dates))
    cells = F.transform(F.slice("lines", F.col("begin") + 1, F.size("lines")), lambda line: F.struct(line.alias("line"), _is_number(line).alias("number")))
    rows = _once(rows, headers=F.slice(F.coalesce(row, others), 1, COLUMNS), cells=F.filter(cells, lambda c: c.number.isNotNull()))
    # runs of lines of one kind; a run of numbers that is long enough, or the page's last, closes the label in front of it
    n, n_cols = F.size("cells"), F.greatest(F.size("headers"), F.lit(3))
    begins = F.transform("cells", lambda c, i: F.when((i == 0) | (c.number != F.get("cells", i - 1)["number"]), i))
    rows = _once(rows, runs=F.array_compact(begins))
    runs = F.transform("runs", lambda at, r: F.struct(at.alias("at"), F.coalesce(F.get("runs", r + 1), n).alias("end")))
    rows = _once(rows, closing=F.filter(runs, lambda x: F.get("cells", x["at"])["number"] & ((x["end"] - x["at"] >= n_cols) | (x["end"] == n))))

    def item(x: Column, j: Column) -> Column:
        ended = F.coalesce(F.get("closing", j - 1)["end"], F.lit(0))
        between = F.transform(F.when(x["at"] > ended, F.sequence(ended, x["at"] - 1)), lambda i: F.get("cells", i))
        words = F.filter(between, lambda c: ~c.number)
        values = F.transform(F.sequence(F.lit(0), F.lit(COLUMNS - 1)), lambda i: F.when(i < F.least(n_cols, x["end"] - x["at"]), clean_number(F.get("cells", x["at"] + i)["line"])))
        return F.struct(words.alias("words"), values.alias("values"))

    def label(words: Column) -> Column:
        """A fourth line begins a label anew."""
        kept = F.slice(words, -((F.size(words) - 1) % LABEL_LINES + 1), F.lit(LABEL_LINES))
        return clean_label(F.array_join(F.transform(kept, lambda x: x.line), " "))

    rows = _once(rows, found=F.filter(F.transform("closing", item), lambda x: F.size(x.words) > 0))
    items = F.transform("found", lambda x: F.struct(label(x.words).alias("label"), x["values"].alias("values")))
    return rows.select(*given, "headers", F.filter(items, _is_item).alias("items"))


def _is_item(x: Column) -> Column:
    return (F.length(x["label"]) >= 3) & F.exists(x["values"], lambda v: v.isNotNull())


def _is_results_table(table: Column) -> Column:
    text = lambda rows: F.lower(F.array_join(F.filter(F.flatten(F.transform(F.slice(table, 1, rows), lambda r: F.coalesce(r, F.array().cast("array<string>")))), lambda c: F.coalesce(c, F.lit("")) != ""), " "))
    return (F.size(table) >= LEAST_ITEMS) & (text(5).rlike(DATE_HEADER) | _any(text(5), PERIOD_WORDS)) & _any(text(8), BODY_WORDS)


def _header_cell(cell: Column) -> Column:
    """A cell's date: in numbers as it is written, else in words."""
    words = F.regexp_extract(cell, DATE_WORDS, 0)
    return F.coalesce(F.nullif(F.regexp_extract(cell, DATE_HEADER, 0), F.lit("")), F.when(words != "", F.element_at(line_dates(words), 1)))


def _read_tables(pages: DataFrame) -> DataFrame:
    """The given columns but for tables and text, then table (from 0), headers and items (array of label and values, as they come) of bordered tables that look like results. All within the row."""
    others = [c for c in pages.columns if c not in ("tables", "text")]
    tables = pages.select(*others, F.posexplode("tables").alias("table", "rows")).where(_is_results_table(F.col("rows")))
    cells = F.flatten(F.transform(F.slice("rows", 1, 5), lambda r: F.coalesce(r, F.array().cast("array<string>"))))
    headers = F.slice(F.array_distinct(F.array_compact(F.transform(cells, _header_cell))), 1, COLUMNS)

    def item(row: Column, place: Column) -> Column:
        values = F.transform(F.sequence(F.lit(0), F.lit(COLUMNS - 1)), lambda i: clean_number(F.get(row, i + place)))
        return F.when(place > 0, F.struct(clean_label(F.element_at(row, place)).alias("label"), values.alias("values")))

    trimmed = lambda row: F.transform(row, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    place = lambda row: F.array_position(F.transform(row, lambda c: (c != "") & ~c.rlike(NUMBER_CELL)), F.lit(True)).cast("int")
    rows = _once(tables, trimmed=F.transform(F.filter("rows", lambda r: r.isNotNull()), trimmed))
    items = F.array_compact(F.transform("trimmed", lambda row: let(place(row), lambda at: item(row, at))))
    return rows.select(*others, "table", headers.alias("headers"), F.filter(items, _is_item).alias("items"))


def _candidates(rows: DataFrame) -> DataFrame:
    """n_items, quality and items (label -> values) of rows with items as they come; quality is null where they are no statement. A label that comes again has its last values."""
    rows = _once(rows.withColumnRenamed("items", "_all"), _sorted=F.array_sort(F.transform("_all", lambda x, i: F.struct(x["label"].alias("label"), i.alias("at"), x["values"].alias("values")))))
    last = F.filter("_sorted", lambda x, i: F.coalesce(F.get("_sorted", i + 1)["label"] != x["label"], F.lit(True)))
    rows = _once(rows, _last=last)
    rows = _once(rows, n_items=F.size("_last").cast("long"), _known=F.size(F.filter("_last", lambda x: _any(F.lower(x["label"]), ANCHORS))).cast("long"))
    items = F.map_from_entries(F.transform("_last", lambda x: F.struct(x["label"], x["values"])))
    fit = (F.col("n_items") >= LEAST_ITEMS) & (F.col("_known") > 0)
    return rows.withColumns({"quality": F.when(fit, F.col("_known")), "items": F.when(fit, items)}).drop("_all", "_sorted", "_last", "_known")


def full_statements(pages: DataFrame) -> DataFrame:
    """doc, kind, unit (Cr, Lakhs, Mn), headers, quality, n_items, items (label -> values in the unit as written) of each document that has a statement."""
    text, low = F.col("text"), F.col("low")
    named = F.lower(F.when(_holds(low, UNIT_WORDS), group(text, UNIT)))
    unit = F.when(named.contains("lakh") | named.startswith("lac"), "Lakhs").when(named.contains("million"), "Mn")
    fit = _holds(low, PAGE_WORDS) & ~(_holds(low, SUMMARY_WORDS) & F.substring("text", 1, 600).rlike(SUMMARY))
    pages = pages.where("doc is not null and page_no is not null")
    # a page without a statement still says its unit
    read = _once(_once(pages.select(*_AT, "text"), low=F.lower("text")), unit=unit, fit=F.coalesce(fit, F.lit(False))).drop("low")
    read = _with_kind(read).withColumn("text", F.when(F.col("fit"), text).otherwise("")).drop("fit")
    texts = _candidates(_read_texts(read)).withColumn("table", F.lit(BEHIND)).where("quality is not null or unit is not null")
    held = _once(pages.where(F.size("tables") > 0).select(*_AT, "text", "tables"), low=F.lower("text")).where(fit).drop("low")
    tables = _candidates(_read_tables(_with_kind(held))).withColumn("unit", F.lit(None).cast("string")).where("quality is not null")
    shape = [*_AT, "table", "unit", "kind", "headers", "quality", "n_items", "items"]
    # a page that names no other unit has the last one named before it; all rows of a page are peers
    last = F.last("unit", ignorenulls=True).over(Window.partitionBy("doc").orderBy("page_no"))
    found = texts.select(*shape).unionByName(tables.select(*shape)).withColumn("unit", F.coalesce(last, F.lit("Cr"))).where("quality is not null")
    preference = F.when(F.col("kind") == "standalone", 0).when(F.col("kind") == "unknown", 1).otherwise(2)
    order = F.struct(preference, -F.col("quality"), -F.col("n_items"), "page_no", "table")
    best = found.groupBy("doc").agg(F.min_by(F.struct("kind", "unit", "headers", "quality", "n_items", "items"), order).alias("x"))
    return best.select("doc", "x.*")
