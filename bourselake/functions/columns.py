"""Column builders: every function is built from Spark's own expressions and stays inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A pattern's group, case-insensitive; null where it is not found."""
    return F.nullif(F.regexp_extract(text, _i(pattern), n), F.lit(""))


# ---- gates and labels


def subject_gate(subject: Column, keep=rules.KEEP_SUBJECTS, drop=rules.DROP_SUBJECTS) -> Column:
    """True where the subject is on the list to keep and not on the list to drop."""
    return F.coalesce(subject.isin(keep) & ~subject.isin(drop), F.lit(False))


def first_label(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that is found."""
    return F.coalesce(*[F.when(text.rlike(_i(p)), F.lit(label)) for label, p in table], F.lit(default))


def catalyst_type(subject: Column, details: Column) -> Column:
    return first_label(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(details, F.lit(""))), rules.CATALYSTS, "general")


_PLAIN = re.compile(r"[A-Za-z0-9 &]+")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found_in(low: Column, pattern: str) -> Column:
    """Whether an alternation is found in a text whose A-Z are lower-cased: plain alternatives by substring search, the others by one expression."""
    parts = pattern.split("|") if "(" not in pattern else [pattern]
    plain = [p.lower() for p in parts if _PLAIN.fullmatch(p)]
    # an alternative that holds another is found with it
    plain = [p for p in plain if not any(q != p and q in p for q in plain)]
    rest = [p for p in parts if not _PLAIN.fullmatch(p)]
    tests = [low.contains(p) for p in dict.fromkeys(plain)] + ([low.rlike(_i("|".join(rest)))] if rest else [])
    return reduce(lambda a, b: a | b, tests)


def labels(text: Column, table: list[tuple[str, str]]) -> Column:
    """All labels whose pattern is found, sorted."""
    of = lambda low: F.array_sort(F.array_compact(F.array(*[F.when(found_in(low, p), F.lit(label)) for label, p in table])))
    return let(F.translate(text, _CAPITALS, _CAPITALS.lower()), of)


def sector_tags(company: Column, subject: Column, details: Column) -> Column:
    return labels(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (company, subject, details))), rules.SECTORS)


def sector_theme(company: Column, subject: Column, details: Column, theme: str) -> Column:
    """Whether sector_tags, joined by commas, have a theme in them: only the sectors that have it in their names are looked for."""
    table = [(label, p) for label, p in rules.SECTORS if theme in label]
    if "," in theme or not table:
        return F.array_join(sector_tags(company, subject, details), ",").contains(theme)
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (company, subject, details)))
    return let(F.translate(text, _CAPITALS, _CAPITALS.lower()), lambda low: reduce(lambda a, b: a | b, [found_in(low, p) for _, p in table]))


def surprise(text: Column) -> Column:
    return F.when(text.rlike(_i(rules.POSITIVE)), "positive").when(text.rlike(_i(rules.NEGATIVE)), "negative").otherwise("neutral")


# ---- money and numbers


def number(text: Column) -> Column:
    """A number with commas; null where it is none."""
    return F.expr("try_cast(x as double)") if text is None else F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same double in every engine."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def crore(text: Column) -> Column:
    """The first amount in a text in crore, by unit in the rules' order; an amount that is no number passes on to the next unit."""
    found = []
    for pattern, factor, digits in rules.MONEY:
        value = number(group(text, pattern))
        value = value / 100 if factor == 0.01 else value * factor
        found.append(value if digits is None else half_up(value, digits))
    return F.coalesce(*found)


def size_bucket(value: Column) -> Column:
    out = F.when(value.isNull(), "unknown")
    for least, label in rules.SIZES:
        out = out.when(value >= least, label)
    return out.otherwise("tiny")


def strategic_note(value: Column, government: Column, export: Column, surprised: Column) -> Column:
    amount = F.concat(F.lit("Rs."), F.format_string("%.0f", value), F.lit(" cr order"))
    first = F.when(value >= 1000, F.concat(amount, F.lit(" — mega size"))).when(value >= 100, amount)
    return F.concat_ws(" · ", first, F.when(government, "government/PSU contract"), F.when(export, "export component"), F.when(surprised == "positive", "positive surprise"))


def indian_number(cell: Column) -> Column:
    """A table cell's number: parentheses are negative, commas go, a last group of two digits after a blank is decimals; null for nil marks."""
    def of(s: Column) -> Column:
        bare = F.regexp_replace(F.replace(s, F.lit(","), F.lit("")), r"^[()]+|[()]+$", "")
        value = let(let(bare, spaced), lambda x: F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), x.try_cast("double")))
        return F.when(s.isin(rules.NIL), None).otherwise(F.when(s.startswith("(") & s.endswith(")"), -value).otherwise(value))

    def spaced(bare: Column) -> Column:
        joined = lambda p: F.when((F.size(p) >= 2) & F.element_at(p, -1).rlike(r"^\d{2}$"), F.concat(F.array_join(F.slice(p, 1, F.size(p) - 1), ""), F.lit("."), F.element_at(p, -1))).otherwise(F.replace(bare, F.lit(" "), F.lit("")))
        return let(F.split(F.trim(bare), r"\s+"), joined)

    return let(F.trim(cell), of)


def unit_factor(text: Column) -> Column:
    """Factor to crore: a declared unit, else lakh where seven numbers or more are grouped that way, else crore."""
    named = F.lower(F.rtrim(F.coalesce(*[group(text, rules.UNITS, i) for i in range(1, 6)]), F.lit(".")))
    declared = F.when(named.isin("million", "mn"), 0.1).when(named.isin("lakh", "lakhs", "lac", "lacs"), 0.01).when(named.isNotNull(), 1.0)
    return F.coalesce(declared, F.when(F.size(F.regexp_extract_all(text, F.lit(f"({rules.LAKH_NUMBER})"), 1)) >= 7, 0.01), F.lit(1.0))


def growth(now: Column, before: Column) -> Column:
    """Percent of the prior value's size, one digit; null without one."""
    return half_up((now - before) / F.abs(F.nullif(before, F.lit(0.0))) * 100, 1)


def cap_class(text: Column, value: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.when(low.contains("small"), "Small").when(low.contains("mid"), "Mid").when(low.contains("large"), "Large")
    return F.coalesce(named, F.when(value >= 20000, "Large").when(value >= 5000, "Mid").when(value > 0, "Small"))


# ---- dates and periods


def timestamp(raw: Column) -> Column:
    """The first of the feed's formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in rules.TIMESTAMPS])


def date_int(text: Column) -> Column:
    """YYYY-MM-DD... as the number YYYYMMDD, 0 where it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.replace(F.substring(text, 1, 10), F.lit("-"), F.lit("")).try_cast("int")).otherwise(0)


def period_label(day: Column) -> Column:
    """'Qn FYyyyy' of a fiscal year that begins in April; January to March is Q4."""
    q = F.floor((F.month(day) + 8) % 12 / 3) + 1
    year = F.year(day) + F.when(F.month(day) >= 4, 1).otherwise(0)
    return F.concat(F.lit("Q"), q.cast("string"), F.lit(" FY"), year.cast("string"))


def prior_period(period: Column) -> Column:
    """The same period a year before: Q1FY26, Q1 FY2027, 2025-Q1, FY2026, 2025-26; null for anything else."""
    q = F.regexp_extract(period, r"(?i)^(Q[1-4])\s*FY(\d{2,4})", 1)
    space = F.when(period.rlike(r"(?i)^Q[1-4]\s+FY"), " ").otherwise("")
    back = lambda pattern, n: (F.nullif(F.regexp_extract(period, pattern, n), F.lit("")).try_cast("int") - 1).cast("string")
    yearly = F.concat(F.lit("FY"), back(r"(?i)^FY(\d{4})", 1))
    year = back(r"(?i)^Q[1-4]\s*FY(\d{2,4})", 1)
    quarter = F.concat(F.upper(q), space, F.lit("FY"), F.when(F.length(year) < 2, F.concat(F.lit("0"), year)).otherwise(year))
    dashed = F.concat(back(r"^(\d{4})-Q[1-4]", 1), F.lit("-"), F.regexp_extract(period, r"^\d{4}-(Q[1-4])", 1))
    span = F.concat(back(r"^(\d{4})-\d{2,4}", 1), F.lit("-"), F.regexp_extract(period, r"^\d{4}-(\d{2,4})", 1))
    return F.coalesce(quarter, dashed, yearly, span)


def execution_months(text: Column) -> Column:
    """Months of a stated duration: years x 12; weeks / 4 and days / 30, at least one; halves go up."""
    n = number(group(text, r"(\d+(?:\.\d+)?)\s*(month|year|week|day)", 1))
    unit = F.lower(group(text, r"(\d+(?:\.\d+)?)\s*(month|year|week|day)", 2))
    rounded = lambda x: F.floor(x + 0.5).cast("int")
    return F.when(unit == "year", rounded(n * 12)).when(unit == "week", F.greatest(F.lit(1), rounded(n / 4))).when(unit == "day", F.greatest(F.lit(1), rounded(n / 30))).when(unit == "month", rounded(n))


def range_start(phrase: Column, as_of: Column) -> Column:
    """First day of a relative range: today, yesterday, this or last week, month, year, last N days."""
    n = F.regexp_extract(phrase, r"(?i)last\s+(\d+)\s+days?", 1).try_cast("int")
    week = F.trunc(as_of, "week")
    return (
        F.when(n.isNotNull(), F.date_sub(as_of, n)).when(phrase.contains("yesterday"), F.date_sub(as_of, 1)).when(phrase.contains("last week"), F.date_sub(week, 7))
        .when(phrase.contains("this week"), week).when(phrase.contains("this month"), F.trunc(as_of, "month")).when(phrase.contains("this year"), F.trunc(as_of, "year")).when(phrase.contains("today"), as_of)
    )


# ---- text


def words(text: Column) -> Column:
    """Distinct words of three letters or more, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{3,})"), 1))


def ranked_words(text: Column) -> Column:
    """Distinct runs of two letters or digits or more, lower-cased, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(rules.STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def doc_id(*fields: Column) -> Column:
    """md5 of the fields joined by |; null fields count as empty ones."""
    joined = [F.coalesce(f, F.lit("")) for f in fields]
    return F.md5(reduce(lambda a, b: F.concat(a, F.lit("|"), b), joined))


def guarded(details: Column, subject: Column) -> tuple[Column, Column]:
    """Over-long or NUL-bearing input is cut to 10 000 and 500 characters and loses its NULs."""
    odd = (F.length(details) > 10_000) | (F.length(subject) > 10_000) | details.contains("\0") | subject.contains("\0")
    cut = lambda c, n: F.when(odd, F.replace(F.substring(c, 1, n), F.lit("\0"), F.lit(""))).otherwise(c)
    return cut(details, 10_000), cut(subject, 500)


# ---- scores


def catalyst_score(subject: Column, details: Column) -> Column:
    """0 to 13 from the subject's base score and what the details say."""
    text = F.coalesce(details, F.lit(""))
    has = lambda p: text.rlike(_i(p))
    base = F.coalesce(*[F.when(subject == k, v) for k, v in rules.BASE_SCORES.items()])
    amount = number(group(text, rules.MONEY[0][0]))
    paid = group(text, rules.DIVIDEND).try_cast("double")
    orders = F.when(amount >= 1000, 13).when(amount >= 500, 12).when(amount >= 100, 11).otherwise(10)
    bought = F.when(amount >= 500, 11).when(amount >= 100, 10).otherwise(9)
    board = F.greatest(F.lit(6), F.when(has(rules.RESULTS), 8), F.when(has(rules.HIGH_VALUE), 9))
    press = F.when(has(rules.LOW_VALUE), 0).when(has(rules.HIGH_VALUE), 8).otherwise(3)
    dividend = F.when(paid >= 5, 5).when(paid >= 1, 4).when(paid.isNotNull(), 2).otherwise(4)
    other = F.coalesce(base, F.lit(3))
    return (
        F.when(subject == "Outcome of Board Meeting", board).when(subject == "Bagging/Receiving of orders/contracts", orders)
        .when(subject.isin("Press Release", "Press Release (Revised)", "General Updates", "Updates"), press).when(subject == "Dividend", dividend)
        .when(subject.isin("Change in Management", "Appointment", "Cessation", "Resignation"), F.when(has(rules.C_SUITE), 5).otherwise(1))
        .when(subject == "Acquisition", bought).when(subject.isin("Commencement of commercial production/operations", "Scheme of Arrangement", "Capacity addition"), base)
        .otherwise(F.when(has(rules.HIGH_VALUE), F.greatest(other, F.lit(7))).otherwise(other))
    )


def legacy_score(subject: Column, details: Column) -> Column:
    """The older gate's score, 0 to 13: unknown subjects have 2, acquisitions and sales their base, whatever the details say."""
    text = F.coalesce(details, F.lit(""))
    has = lambda p: text.rlike(_i(p))
    amount, paid = number(group(text, rules.MONEY[0][0])), group(text, rules.DIVIDEND).try_cast("double")
    high = has(rules.HIGH_VALUE_LEGACY)
    board = F.when(high, 9).when(has(rules.RESULTS), 8).otherwise(6)
    said = F.when(has(rules.LOW_VALUE), 0).when(high, 8).otherwise(3)
    orders = F.when(amount >= 1000, 13).when(amount >= 500, 12).when(amount >= 100, 11).otherwise(10)
    dividend = F.when(paid >= 5, 5).when(paid >= 1, 4).when(paid.isNotNull(), 2).otherwise(4)
    base = F.coalesce(*[F.when(subject == k, v) for k, v in rules.BASE_SCORES.items()], F.lit(2))
    return (
        F.when(subject == "Outcome of Board Meeting", board).when(subject.isin("General Updates", "Updates", "Press Release", "Press Release (Revised)"), said)
        .when(subject == "Bagging/Receiving of orders/contracts", orders).when(subject == "Dividend", dividend)
        .when(subject.isin("Appointment", "Change in Management", "Cessation", "Resignation"), F.when(has(rules.C_SUITE), 5).otherwise(1)).otherwise(base)
    )


# ---- narratives


def plain_number(x: Column) -> Column:
    """A number of two digits at most as text: without an exponent, one digit behind the point at least."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,2)").cast("string"), "0$", ""), r"\.$", ".0")


def narrative(company: Column, symbol: Column, period: Column, revenue: Column, revenue_growth: Column, pat: Column, pat_growth: Column, summary: Column | None = None, margin: Column | None = None, eps: Column | None = None, highlights: Column | None = None, guidance: Column | None = None) -> Column:
    """A result as a text to be found by: who and when, what was said, the figures that are there (none is 0) with their growth, highlights, guidance."""
    there = lambda x: x.isNotNull() & (x != 0)
    nothing = F.lit(None).cast("string")
    amount = lambda name, x: F.when(there(x), F.concat(F.lit(f"{name} Rs."), plain_number(x), F.lit(" cr")))
    grown = lambda x: F.when(x.isNotNull(), F.concat(F.lit("("), F.format_string("%+.1f", x), F.lit("% YoY)")))
    ebitda = nothing if margin is None else F.when(there(margin), F.concat(F.lit("EBITDA margin "), F.format_string("%.1f", margin), F.lit("%")))
    a_share = nothing if eps is None else F.when(there(eps), F.concat(F.lit("EPS Rs."), plain_number(eps)))
    figures = F.concat_ws(" ", amount("Revenue", revenue), grown(revenue_growth), F.lit("|"), amount("PAT", pat), grown(pat_growth), F.lit("|"), ebitda, a_share)
    head = F.concat(company, F.lit(" ("), symbol, F.lit(") "), period, F.lit(":"))
    marks = nothing if highlights is None else F.array_join(highlights, " | ")
    said = [F.nullif(x, F.lit("")) for x in (nothing if summary is None else summary, figures, marks, nothing if guidance is None else guidance)]
    return F.concat_ws(" ", head, *said)
