"""Facts from filing texts: orders, profit-and-loss lines, annexure rows, highlights. All expressions, no Python in tasks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .columns import half_up, let, number

# Patterns, labels and keyword lists must be these for the results to be right.

AMOUNT = r"(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d+)?)\s*(crore|cr\.?|lakh|lakhs|lacs?|million|mn|billion|bn)"
ORDER_VALUES = [
    r"(?:order|contract|LOA|letter\s+of\s+award|work\s+order|supply\s+order)[^.]*?(?:valued?\s+at|worth|amounting\s+to|of)\s*" + AMOUNT,
    r"(?:total\s+(?:order|contract|project|work)\s+value|order\s+(?:value|size)|contract\s+value)[^.]*?" + AMOUNT,
    r"(?:order|contract|project)[^.{}]{0,120}" + AMOUNT,
    AMOUNT,
]
ORDER_BOOK = r"\border[\s-]*(?:book|backlog|pipeline|position|status|inflow)\b"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
DURATION = r"(?:within|over|period\s+of|duration\s+of|to\s+be\s+(?:completed|executed)\s+in)\s*([\d]+)\s*(month|year|week|day)"
GOVERNMENT_CLIENT = r"\b(NHAI|NHPC|ONGC|NTPC|SAIL|BHEL|HAL|BEL|DRDO|ISRO|AAI|GAIL|Coal\s+India|IREDA|RVNL|IRCON|KRCL|NBCC|CPWD|PWD|NHIDCL|Ministry|Government|Railways|Metro|Municipal|Defence|Army|Navy|Air\s+Force|Border\s+Roads|State\s+Govt|Central\s+Govt|Public\s+Sector|PSU|PSE)\b"
ORDER_SECTORS = [
    ("defence", r"\b(defence|defense|military|army|navy|air force|DRDO|HAL|BEL|ordnance)\b"),
    ("railways", r"\b(railways?|RVNL|IRCON|metro|railway ministry)\b"),
    ("power", r"\b(power|electricity|solar|wind|energy|NTPC|NHPC)\b"),
    ("roads", r"\b(highway|road|bridge|NHAI|expressway|NHIDCL)\b"),
    ("water", r"\b(water|irrigation|sewage|sewerage|pipeline)\b"),
    ("oil_gas", r"\b(oil|gas|petrochemical|refinery|ONGC|GAIL)\b"),
    ("real_estate", r"\b(real estate|construction|building|township|residential|commercial)\b"),
    ("telecom", r"\b(telecom|5G|fibre|optic|broadband|BSNL)\b"),
]
STATEMENT_ROWS = {
    "revenue": ["total revenue from operations", "revenue from operations", "revenue from operation", "net sales", "net revenue from operations", "sales and services", "income from operations", "turnover", "revenue from contracts with customers", "gross premium", "premium earned", "net revenue", "income from revenue"],
    "interest_income": ["net interest income", "interest income", "interest earned"],
    "total_income": ["total income", "total revenue", "total income from operations"],
    "ebitda": ["ebitda", "operating profit", "profit from operations before finance", "earnings before interest"],
    "pbt": ["profit before tax", "profit/(loss) before tax", "profit / (loss) before tax", "profit before exceptional", "loss before tax", "loss/(profit) before tax"],
    "pat": ["net profit for the period", "net profit for the year", "profit for the period", "profit for the year", "profit/(loss) for the period", "profit/(loss) for the year", "profit after tax", "net profit after tax", "loss for the period", "loss for the year", "net profit", "net loss"],
    "eps_basic": ["earnings per share", "basic earnings per share", "eps - basic", "eps (basic)", "basic (in rs.)", "basic"],
    "eps_diluted": ["diluted earnings per share", "diluted (in rs.)", "diluted"],
    "finance_cost": ["finance costs", "finance cost", "interest expense", "interest and finance charges", "borrowing costs"],
    "depreciation": ["depreciation and amortisation", "depreciation and amortization", "depreciation & amortisation", "depreciation", "amortisation", "amortization"],
}
ANNEXURE_ROWS = {
    "client": ["name of the entity", "awarding the contract", "entity to which order"],
    "domestic": ["domestic", "international entity"],
    "description": ["significant terms", "terms and conditions", "nature of order", "nature of contract"],
    "duration": ["time period", "to be executed", "period of execution", "period by which"],
    "value": ["broad commercial consideration", "consideration or size", "size of the order", "broad consideration", "value of the contract", "value of the order"],
    "related_party": ["related party"],
}
MOST_CRORE = 500_000.0


def to_crore(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    scaled = F.when(u.startswith("la"), value / 100).when(u.startswith("m"), value / 10).when(u.startswith("b"), value * 100).otherwise(value)
    return half_up(scaled, 2)


def without_order_book(text: Column) -> Column:
    """The text without sentences on the order book."""
    return F.array_join(F.filter(F.split(text, SENTENCE_END), lambda s: ~s.rlike("(?i)" + ORDER_BOOK)), " ")


def _amounts(found: Column) -> Column:
    """The least positive value of matches that end in an amount."""
    amount = "(?i)" + AMOUNT + "$"
    value = F.transform(found, lambda m: let(F.regexp_extract(m, amount, 2), lambda unit: to_crore(number(F.regexp_extract(m, amount, 1)), unit)))
    return F.array_min(F.filter(value, lambda v: v > 0))


def order_value(clean: Column) -> Column:
    """In crore, from a text without sentences on the order book: the least positive amount of the first pattern that gives one."""
    low = F.lower(clean)
    about = low.contains("order") | low.contains("contract") | low.contains("loa") | low.contains("letter") | low.contains("project") | low.contains("work")
    tiers = [_amounts(F.regexp_extract_all(clean, F.lit("(?i)" + p), F.lit(0))) for p in ORDER_VALUES]
    return F.coalesce(*[F.when(about, t) for t in tiers[:-1]], tiers[-1])


def duration_months(text: Column) -> Column:
    """Whole months of a stated duration; weeks / 4.3; days are not read."""

    def read(found: Column) -> Column:
        n = F.nullif(F.regexp_extract(found, r"(\d+)\s*[A-Za-z]+$", 1), F.lit("")).try_cast("int")
        low = F.lower(found)
        return F.when(low.endswith("week"), F.floor(n / 4.3 + 0.5).cast("int")).when(low.endswith("year"), n * 12).when(low.endswith("month"), n)

    return let(F.regexp_extract(text, "(?i)" + DURATION, 0), read)


def order_wins(rows: DataFrame, text: str) -> DataFrame:
    """rows whose text has an order's value, with value_cr, client_type, sector, months.

    Each step is a generator over one value, which keeps the optimiser from working a step out again wherever the next one names it.
    """
    once = lambda df, value, name: df.select("*", F.explode(F.array_compact(F.array(value))).alias(name))
    some = once(rows, F.when(F.col(text).rlike("(?i)" + AMOUNT), without_order_book(F.col(text))), "_clean")
    found = once(some, order_value(F.col("_clean")), "value_cr").drop("_clean")
    found = found.withColumn("_low", F.lower(text))
    client = F.when(_word_of(F.col(text), F.col("_low"), GOVERNMENT_CLIENT), "Government / PSU").otherwise("Private sector")
    labels = F.array_sort(F.array_compact(F.array(*[F.when(_word_of(F.col(text), F.col("_low"), p), F.lit(label)) for label, p in ORDER_SECTORS])))
    sector = F.coalesce(F.nullif(F.array_join(labels, ", "), F.lit("")), F.lit("general"))
    return found.withColumns({"client_type": client, "sector": sector, "months": duration_months(F.col(text))}).drop("_low")


def _word_of(text: Column, low: Column, pattern: str) -> Column:
    """text.rlike(pattern), for a pattern of words between borders: the expression is tried only where the lower-case text holds the beginning of one of the words."""
    heads = {re.match(r"[A-Za-z0-9]+", word)[0].lower() for word in pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|")}
    heads = sorted(h for h in heads if not any(o != h and o in h for o in heads))
    return reduce(lambda a, b: a | b, [low.contains(h) for h in heads]) & text.rlike("(?i)" + pattern)


def first_number(text: Column) -> Column:
    """The first number of a text; parentheses are negative; bare whole numbers below 100 are row numbers and passed over."""
    found = F.regexp_extract_all(text, F.lit(r"\(\d[\d,]*(?:\.\d+)?\)|-?\d[\d,]*(?:\.\d+)?"), 0)
    real = F.filter(found, lambda x: x.startswith("(") | x.contains(",") | x.contains(".") | (x.try_cast("double") >= 100) | (x.try_cast("double") < 0))
    signed = lambda first: let(number(F.regexp_replace(first, r"[()]", "")), lambda plain: F.when(first.startswith("("), -plain).otherwise(plain))
    return let(F.get(real, 0), signed)


def results(lines: DataFrame, key: str, factor: Column) -> DataFrame:
    """key, revenue_cr, pat_cr, ebitda_cr, ebitda_margin, eps, confidence from lines of key, field, value (statements.line_values); texts without revenue and profit, or beyond belief, give no row."""
    wide = lines.groupBy(key).pivot("field", list(STATEMENT_ROWS)).agg(F.first("value"))
    some = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit(0.0)) for n in names])
    crore = lambda x: F.nullif(half_up(x * factor, 2), F.lit(0.0))
    zero = F.lit(0.0)
    built = F.when(F.col("pbt").isNotNull() & (F.col("finance_cost").isNotNull() | F.col("depreciation").isNotNull()), F.col("pbt") + F.coalesce("finance_cost", zero) + F.coalesce("depreciation", zero))
    eps = some("eps_basic", "eps_diluted")
    out = wide.select(
        key, crore(some("revenue", "total_income", "interest_income")).alias("revenue_cr"), crore(some("pat", "pbt")).alias("pat_cr"), F.coalesce(crore(F.col("ebitda")), crore(built)).alias("ebitda_cr"),
        F.when(F.abs(eps) < 500, eps).otherwise(eps * factor).alias("eps"),
    )
    margin = half_up(F.col("ebitda_cr") / F.col("revenue_cr") * 100, 1)
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("revenue_cr", "pat_cr", "ebitda_cr", "eps")), F.lit(0))
    out = out.withColumns({"ebitda_margin": F.when((F.col("revenue_cr") > 0) & margin.between(-100, 100), margin), "confidence": F.when(filled >= 3, "high").when(filled >= 1, "medium").otherwise("low")})
    fine = (F.coalesce(F.abs("revenue_cr"), zero) <= MOST_CRORE) & (F.coalesce(F.abs("pat_cr"), zero) <= MOST_CRORE)
    return out.where((F.col("revenue_cr").isNotNull() | F.col("pat_cr").isNotNull()) & fine)


def annexure(rows: Column) -> Column:
    """map of field -> text from table rows [number, particulars, description, ...]: the first row whose particulars hold a field's words, its last filled cell."""
    cells = lambda r: F.filter(F.slice(r, 3, F.greatest(F.size(r) - 2, F.lit(0))), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")

    def filled(names: list[str]):
        said = lambda r: F.lower(F.coalesce(F.get(r, 1), F.lit("")))
        return lambda r: reduce(lambda a, b: a | b, [said(r).contains(n) for n in names]) & (F.size(cells(r)) > 0)

    pairs = []
    for field, names in ANNEXURE_ROWS.items():
        row = F.get(F.filter(rows, filled(names)), 0)
        pairs.append(F.struct(F.lit(field).alias("k"), F.trim(F.try_element_at(cells(row), F.lit(-1))).alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.v.isNotNull()))


def rupees(cell: Column) -> Column:
    """A value cell in crore: a stated unit, else rupees of 1e7 and more, else lakh-sized numbers."""
    stated = to_crore(number(F.nullif(F.regexp_extract(cell, "(?i)" + AMOUNT, 1), F.lit(""))), F.regexp_extract(cell, "(?i)" + AMOUNT, 2))
    plain = number(F.nullif(F.regexp_extract(cell, r"([\d,]+(?:\.\d+)?)", 1), F.lit("")))
    return F.coalesce(stated, F.when(plain >= 1e7, half_up(plain / 1e7, 2)).when(plain >= 1e5, half_up(plain / 100, 2)).otherwise(plain))


def highlights(text: Column) -> Column:
    """map of 'key: value' strings of a JSON array; of equal keys the last counts; broken JSON gives an empty map."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    pairs = F.transform(F.filter(items, lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.array_append(F.filter(acc, lambda a: a.k != p.k), p))
    return F.map_from_entries(last)


def buyback(text: Column) -> Column:
    """struct of size_cr, max_price, method; null without a size. A size may stand before or after the word."""
    around = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)buyback\s+size[^.]*?" + AMOUNT, 0), F.lit("")), F.nullif(F.regexp_extract(text, "(?i)" + AMOUNT + r"[^.]*?buyback", 0), F.lit("")))
    size = to_crore(number(F.nullif(F.regexp_extract(around, "(?i)" + AMOUNT, 1), F.lit(""))), F.regexp_extract(around, "(?i)" + AMOUNT, 2))
    method = F.initcap(F.nullif(F.regexp_extract(text, "(?i)" + rules.BUYBACK_METHOD, 1), F.lit("")))
    return F.when(size > 0, F.struct(size.alias("size_cr"), number(F.nullif(F.regexp_extract(text, "(?i)" + rules.BUYBACK_PRICE, 1), F.lit(""))).alias("max_price"), method.alias("method")))


def credit_rating(text: Column) -> Column:
    """struct of agency, rating, previous, direction; the direction goes by the ratings' order from best to worst."""
    agency = F.nullif(F.regexp_extract(text, "(?i)" + rules.RATING, 1), F.lit(""))
    now, before = F.upper(F.regexp_extract(text, "(?i)" + rules.RATING, 2)), F.upper(F.nullif(F.regexp_extract(text, "(?i)" + rules.PREVIOUS_RATING, 1), F.lit("")))
    place = lambda c: F.nullif(F.array_position(F.array(*map(F.lit, rules.RATINGS)), c), F.lit(0).cast("long"))
    direction = F.when(place(now) < place(before), "upgrade").when(place(now) > place(before), "downgrade").when(place(now) == place(before), "unchanged")
    return F.when(agency.isNotNull(), F.struct(agency.alias("agency"), now.alias("rating"), before.alias("previous"), direction.alias("direction")))


def sanitised(text: Column) -> Column:
    """Injected instructions become [removed], runs of four non-ASCII characters or more a blank."""
    return F.regexp_replace(F.regexp_replace(text, "(?i)" + rules.INJECTION, "[removed]"), r"[^\x00-\x7F]{4,}", " ")


def question_kind(text: Column) -> Column:
    """order_win, financials, volume_breakout, announcements or all, by the words of a question."""
    said = F.split(F.lower(text), r"[^a-z0-9_]+")
    has = lambda words: F.arrays_overlap(said, F.array(*map(F.lit, words)))
    order, money, breakout = has(rules.ORDER_WORDS), has(rules.FINANCIAL_WORDS), has(rules.BREAKOUT_WORDS)
    subject = F.lower(text).rlike("|".join(rules.SUBJECT_WORDS))
    return F.when(breakout & ~order & ~money, "volume_breakout").when(order & ~money, "order_win").when(money & ~order, "financials").when(subject & ~order & ~money, "announcements").otherwise("all")


def ungrounded(answers: DataFrame, context: DataFrame, key: str, tolerance: float = 0.06) -> DataFrame:
    """key, value: amounts of 1 crore or more in an answer (column text) that no value of its context is near to; amounts after 'above Rs', 'over Rs' and the like are thresholds, not claims."""
    plain = F.regexp_replace(F.col("text"), r"(?i)\b(?:above|over|below|under|more\s+than|less\s+than|exceeding|minimum|minimum\s+of|at\s+least|upto|up\s+to|greater\s+than|smaller\s+than)\s+Rs\.?\s*[\d,.]+\s*(?:Cr|Crore)\b", "")
    said = F.regexp_extract_all(plain, F.lit(r"(?i)Rs\.?\s*([\d,]+(?:\.\d+)?)\s*(?:Crore|Cr)\b"), 1)
    claims = answers.select(key, F.explode(said).alias("v")).select(key, number(F.col("v")).alias("value")).where("value >= 1").distinct()
    known = context.where("value > 0").select(F.col(key).alias("_key"), F.col("value").alias("_known"))
    near = F.abs(F.col("value") - F.col("_known")) / F.greatest(F.col("_known"), F.lit(1.0)) < tolerance
    return claims.join(known, (F.col(key) == F.col("_key")) & near, "left_anti")


#: What statement lines of revenue and profit are called.
REVENUE_LINES = ["revenue from operations", "total revenue from operations", "net sales", "net revenue", "total income from operations"]
PROFIT_LINES = ["profit for the period", "profit for the year", "profit/(loss) for the period", "profit/(loss) for the year", "net profit", "profit after tax"]


def statement_values(items: Column) -> Column:
    """struct of revenue_now, revenue_before, pat_now, pat_before from a JSON object of line -> values: this period is the first value, the
    same one a year before the third. The first line of three values or more whose name holds one of the words counts."""
    lines = F.map_entries(F.from_json(items, "map<string,array<double>>"))

    def of(names: list[str]) -> Column:
        named = lambda x: reduce(lambda a, b: a | b, [F.lower(x.key).contains(n) for n in names]) & (F.size(x.value) >= 3)
        return F.get(F.filter(lines, named), 0).getField("value")

    revenue, profit = of(REVENUE_LINES), of(PROFIT_LINES)
    return F.struct(F.get(revenue, 0).alias("revenue_now"), F.get(revenue, 2).alias("revenue_before"), F.get(profit, 0).alias("pat_now"), F.get(profit, 2).alias("pat_before"))


TEMPLATE_CLIENT = r"(?i)^['\"]?order\s*\(s\)\s*/\s*contract\s*\(s\)\s*['\"]?\s*[;,]?\s*"


def client_name(cell: Column) -> Column:
    """A client's cell as a name: blanks joined, 80 characters, without the form's own words, a leading acronym out of its parentheses; 'not disclosed' for none."""
    joined = F.left(F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")), F.lit(80))
    bare = F.trim(F.regexp_replace(joined, TEMPLATE_CLIENT, ""))
    named = F.trim(F.regexp_replace(bare, r"^\(['\"]?(\w+)['\"]?\)\s+", "$1 "))
    return let(named, lambda x: F.when(x == "", "not disclosed").otherwise(x))


def duration_cell(cell: Column) -> Column:
    """A time period's cell, blanks joined; beyond 80 characters the first 77 and dots."""
    joined = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    return let(joined, lambda x: F.when(F.coalesce(cell, F.lit("")) == "", "not disclosed").when(F.length(x) <= 80, x).otherwise(F.concat(F.left(x, F.lit(77)), F.lit("..."))))


def is_annexure(table: Column) -> Column:
    """Four rows or more, the first four with particulars of an entity, order or contract."""
    cells = F.flatten(F.transform(F.slice(table, 1, 4), lambda r: F.coalesce(r, F.array().cast("array<string>"))))
    said = F.lower(F.array_join(F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != ""), " "))
    return (F.size(table) >= 4) & said.contains("particular") & (said.contains("entity") | said.contains("order") | said.contains("contract"))
