"""What a question asks for, as columns over a table of questions: symbols, days, thresholds, themes, sectors, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .columns import number

# Signal words, patterns and labels must be these for the results to be right.

NO_SYMBOLS = [
    "I", "A", "AT", "IN", "OF", "OR", "AND", "THE", "FOR", "BY", "TO", "DO", "IS", "IT", "BE", "ON", "NO", "SO", "UP", "AS",
    "EP", "IPO", "NSE", "BSE", "PAT", "NPA", "AUM", "API", "EPC", "LTD", "PVT", "CO", "INC", "PLC", "YOY", "QOQ", "TTM",
    "FY", "Q1", "Q2", "Q3", "Q4", "FROM", "WITH", "THAT", "THIS", "ALL", "ANY", "NOT", "TOP", "GET", "CAN", "YOU", "ME", "MY",
]
SYMBOL = r"\b([A-Z]{2,10})\b"
ISO_DAY, SLASHED_DAY = r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
MIN_SCORE = r"\b(?:score|ep\s+score)\s*(?:>=?|above|over|min(?:imum)?)\s*(\d+)"
HIGH_SCORE = r"\b(?:high|top|best)\s+(?:score[sd]?|rated)\b"
ORDER_VALUE = r"(?:above|over|more\s+than|greater\s+than|>=?|atleast|at\s+least)\s*(?:rs\.?\s*|inr\s*|₹\s*)?([\d,]+(?:\.\d+)?)\s*(crore|cr\.?|lakh|lakhs|million|mn|thousand)?"
LEAST_VALUE = r"(?:above|over|more\s+than|greater\s+than|>|≥|atleast|at\s+least)\s*(?:rs\.?\s*|inr\s*|₹\s*)?([\d,]+(?:\.\d+)?)\s*(crore|cr\.?|lakh|lakhs|million|mn)?"
PERCENT = r"(?:>|greater than|more than|above|over|atleast|at least)\s*(\d+(?:\.\d+)?)\s*%"
FINANCIAL = r"\b(revenue|PAT|EBITDA|EPS|profit|quarterly\s+result|annual\s+result|earnings|growth|margin|guidance|dividend)\b"
STRUCTURED = r"\b(score|ep\s+score|today|yesterday|\d{4}-\d{2}-\d{2}|top\s+\d+|largest|biggest|highest\s+score)\b"
SEMANTIC = r"\b(similar\s+to|like|related|about|theme|sector|companies\s+(that|which)|stocks\s+(with|having))\b"
SECTOR_WORDS = {
    "bank": ["bank", "banking", "banks", "psu bank", "private bank"],
    "financials": ["nbfc", "insurance", "amc", "asset management", "wealth management"],
    "healthcare": ["healthcare", "pharma", "pharmaceutical", "hospital", "drug", "medicine", "biotech", "diagnostic"],
    "i.t": ["information technology", "it sector", "software stocks", "tech stocks", "saas", "it companies"],
    "fmcg": ["fmcg", "fast moving", "consumer goods", "fmcg stocks", "hul", "dabur", "nestle", "britannia"],
    "auto": ["auto sector", "automobile", "automotive", "two-wheeler", "electric vehicle", "ev sector", "auto stocks"],
    "metals & mining": ["metals", "mining", "steel", "iron ore", "aluminium", "copper", "zinc", "metal stocks"],
    "energy": ["oil", "gas", "petroleum", "refinery", "ongc", "energy sector", "crude"],
    "chemicals": ["chemical", "chemicals", "specialty chemicals", "pesticide", "agrochemical", "fertilizer"],
    "realty": ["realty", "real estate", "property", "builder", "housing", "developer", "real-estate"],
    "telecom": ["telecom", "5g", "fibre", "fiber", "broadband", "telecom stocks"],
    "industrials": ["industrial", "industrials", "manufacturing", "engineering", "capital goods", "heavy industry"],
    "consumer discretionary": ["consumer discretionary", "retail", "hotel", "restaurant", "apparel", "fashion", "discretionary"],
    "aerospace & defence": ["aerospace", "defence", "defense", "military", "army", "navy", "hal", "bel", "drdo"],
    "textiles": ["textile", "textiles", "garment", "clothing", "yarn", "fabric"],
    "transportation": ["transport", "logistics", "shipping", "aviation", "airline", "port", "freight"],
    "media": ["media", "entertainment", "film", "television", "ott", "broadcasting"],
    "power & utilities": ["power sector", "electricity", "utility", "solar energy", "wind energy", "ntpc", "renewable energy"],
    "building materials": ["cement", "tiles", "paint", "glass", "sanitaryware", "building material", "plywood"],
    "railways": ["railway", "railways", "rail", "metro", "rvnl", "ircon"],
    "roads": ["road", "roads", "highway", "nhai", "expressway", "bridge"],
    "water": ["water", "irrigation", "sewage", "pipeline"],
}
SUBJECTS = {
    "acquisition": "Acquisition", "merger": "Amalgamation/Merger", "amalgamation": "Amalgamation/Merger", "demerger": "Demerger", "insolvency": "Corporate Insolvency Resolution Process",
    "nclt": "Corporate Insolvency Resolution Process", "cirp": "Corporate Insolvency Resolution Process", "buyback": "Buyback", "qip": "Qualified Institutional Placement", "rights issue": "Rights Issue",
    "open offer": "Public Announcement-Open Offer", "credit rating": "Credit Rating- Revision", "management": "Change in Management", "appointment": "Appointment", "appointed": "Appointment",
    "resignation": "Resignation of Director/KMP/SMP", "resigned": "Resignation of Director/KMP/SMP", "director": "Change in Director(s)", "ceo": "Change in Management", "cfo": "Change in Management",
    "cto": "Change in Management", "md": "Change in Management", "kmp": "Change in Management", "fundraising": "Fund Raising - Preferential Issue", "allotment": "Allotment of Securities",
    "preferential": "Fund Raising - Preferential Issue", "dividend": "Dividend",
}
ANNUAL = ["annual", "yearly", "fy2026", "fy2025", "fy2027", "full-year"]
QUARTERLY = ["quarterly", "quarter", "q1", "q2", "q3", "q4"]
CAPS = [("smallcap", ["smallcap", "small", "smallcaps"]), ("midcap", ["midcap", "mid", "midcaps"]), ("largecap", ["largecap", "large", "largecaps"])]
FAMILIES = {
    "breakout": ["breakout", "breakouts", "hvy", "volume", "surge", "spike", "momentum"],
    "order": ["order", "orders", "contract", "win", "wins", "bagged", "awarded", "loa"],
    "financial": ["revenue", "profit", "pat", "growth", "results", "earnings", "financial", "q1", "q2", "q3", "q4", "fy", "quarterly"],
    "capex": ["capacity", "expansion", "plant", "capex", "invest", "manufacturing", "greenfield", "brownfield", "facility"],
    "fundraise": ["qip", "fundrais", "allotment", "preferential", "ncd", "debenture", "rights issue"],
}
NEWS = [
    (["result", "results", "quarterly", "quarter", "revenue", "profit", "pat", "q1", "q2", "q3", "q4", "earnings", "financial"], "quarterly results FY2026 FY2027"),
    (["order", "contract", "win", "bagged", "awarded", "l1"], "order win contract 2026"),
    (["guidance", "outlook", "forecast", "target", "management"], "management guidance outlook 2026"),
]
LATEST_NEWS = "BSE NSE news 2026"
MOST_CHARACTERS = 1000


def _found(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + pattern, n), F.lit(""))


def said(text: Column) -> Column:
    """The words of a question, lower-cased."""
    return F.split(F.lower(text), r"\W+")


def _any(words: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def symbols(text: Column) -> Column:
    """Words of two to ten capitals that are none of the usual abbreviations; repeated ones stay."""
    return F.filter(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1)), lambda x: ~x.isin(NO_SYMBOLS))


def day(text: Column, as_of: Column) -> Column:
    """today, else an ISO day, else day/month/year, as text; what is no day of any calendar is not checked."""
    year = _found(text, SLASHED_DAY, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    parts = F.concat_ws("-", year, F.lpad(_found(text, SLASHED_DAY, 2), 2, "0"), F.lpad(_found(text, SLASHED_DAY, 1), 2, "0"))
    return F.when(text.rlike(r"(?i)\btoday\b"), as_of.cast("string")).otherwise(F.coalesce(_found(text, ISO_DAY), F.when(year.isNotNull(), parts)))


def min_score(text: Column) -> Column:
    return F.coalesce(_found(text, MIN_SCORE).try_cast("int"), F.when(text.rlike("(?i)" + HIGH_SCORE), 8))


def _crore(text: Column, pattern: str) -> Column:
    unit = F.lower(F.coalesce(_found(text, pattern, 2), F.lit("cr")))
    value = number(_found(text, pattern))
    return F.when(unit.startswith("lakh"), value / 100.0).when(unit.isin("million", "mn"), value / 10.0).when(unit == "thousand", value / 1000.0).otherwise(value)


def order_value(text: Column) -> Column:
    """The threshold on an order's value in crore."""
    return _crore(text, ORDER_VALUE)


def least_value(text: Column) -> Column:
    """The threshold of a question to the chat in crore: > but not >=, and no thousands."""
    return _crore(text, LEAST_VALUE)


def percent(text: Column) -> Column:
    return _found(text, PERCENT).try_cast("double")


def themes(text: Column) -> Column:
    """Labels of all themes that are named, in the table's order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(label)) for p, label in rules.THEMES]))


def intent(text: Column, as_of: Column) -> Column:
    """compound, financial, structured, semantic or hybrid. A symbol or a day makes a question structured."""
    money, like = text.rlike("(?i)" + FINANCIAL), text.rlike("(?i)" + SEMANTIC)
    exact = text.rlike("(?i)" + STRUCTURED) | (F.size(symbols(text)) > 0) | day(text, as_of).isNotNull()
    return F.when(money & (exact | like), "compound").when(money, "financial").when(exact & ~like, "structured").when(like & ~exact, "semantic").otherwise("hybrid")


def _first_held(text: Column, table: dict[str, str]) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(word), F.lit(label)) for word, label in table.items()])


def sector(text: Column) -> Column:
    """The first sector, in the table's order, with a word that the text holds anywhere."""
    return _first_held(text, {w: label for label, words in SECTOR_WORDS.items() for w in words})


def subject(text: Column) -> Column:
    return _first_held(text, SUBJECTS)


def period_type(text: Column) -> Column:
    words = said(text)
    return F.when(_any(words, ANNUAL) | F.lower(text).contains("full year"), "annual").when(_any(words, QUARTERLY), "quarterly")


def cap(text: Column) -> Column:
    words = said(text)
    return F.coalesce(*[F.when(_any(words, names), F.lit(label)) for label, names in CAPS])


def families(text: Column) -> Column:
    """Which kinds of condition a question names."""
    words = said(text)
    return F.array_compact(F.array(*[F.when(_any(words, wanted), F.lit(name)) for name, wanted in FAMILIES.items()]))


def is_compound(text: Column) -> Column:
    return F.size(families(text)) >= 2


def news_query(text: Column, symbol: Column, company: Column) -> Column:
    """What to search the news for: the company's first word, its symbol and words by the question's kind."""
    short = F.coalesce(F.nullif(F.element_at(F.split(company, " "), 1), F.lit("")), symbol)
    words = said(text)
    kind = F.coalesce(*[F.when(_any(words, wanted), F.lit(more)) for wanted, more in NEWS], F.lit(LATEST_NEWS))
    return F.concat_ws(" ", short, symbol, kind)


def refusal(text: Column) -> Column:
    """Why a message is not taken, null where it is."""
    size = F.length(text)
    return F.when(size > MOST_CHARACTERS, F.concat(F.lit("Message too long ("), size.cast("string"), F.lit(f" chars, max {MOST_CHARACTERS})."))).when(text.rlike("(?i)" + rules.INJECTION), "Message contains disallowed content.")


def read(questions: DataFrame, text: str, as_of: str) -> DataFrame:
    """questions with all that is read from them for routing."""
    t, d = F.col(text), F.col(as_of)
    return questions.select("*", intent(t, d).alias("intent"), symbols(t).alias("symbols"), day(t, d).alias("day"), min_score(t).alias("min_score"), order_value(t).alias("order_value"), themes(t).alias("themes"))


# Patterns of time phrases, in the order in which they are tried.
_DAY_PATTERN = r"(?i)\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b|\b(\d{4})-(\d{2})-(\d{2})\b|\b(\d{1,2})(?:st|nd|rd|th)?\s+(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{4})\b"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def date_range(text: Column, as_of: Column) -> Column:
    """first and last day of the time a question names; both null where it names none, or a day that is in no calendar.

    today, yesterday (and words that begin and end like it), this or last week, month and year (with or without a blank), last N days, then a day in
    one of three spellings. Weeks begin on Monday; running ones end on the day of asking.
    """
    has = lambda p: text.rlike(f"(?i){p}")
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    week, month, year = F.trunc(as_of, "week"), F.trunc(as_of, "month"), F.trunc(as_of, "year")
    last_days = F.regexp_extract(text, r"(?i)\blast\s+(\d+)\s+days?\b", 1).try_cast("int")
    part = lambda n: F.nullif(F.regexp_extract(text, _DAY_PATTERN, n), F.lit(""))
    named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.left(part(8), F.lit(3))))
    padded = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    spelt = F.when(part(7).isNotNull(), padded(part(9), named.cast("string"), part(7))).when(part(4).isNotNull(), padded(part(4), part(5), part(6))).when(part(1).isNotNull(), padded(part(3), part(2), part(1)))
    day_ = spelt.try_cast("date")
    return (
        F.when(has(r"\btoday\b"), span(as_of, as_of)).when(has(r"\by\w{4,10}day\b"), span(F.date_sub(as_of, 1), F.date_sub(as_of, 1)))
        .when(has(r"\b(?:this|current)\s*week\b"), span(week, as_of)).when(has(r"\blast\s*week\b"), span(F.date_sub(week, 7), F.date_sub(week, 1)))
        .when(has(r"\b(?:this|current)\s*month\b"), span(month, as_of)).when(has(r"\blast\s*month\b"), span(F.add_months(month, -1), F.date_sub(month, 1)))
        .when(has(r"\b(?:this|current)\s*year\b"), span(year, as_of)).when(has(r"\blast\s*year\b"), span(F.add_months(year, -12), F.date_sub(year, 1)))
        .when(last_days.isNotNull(), span(F.date_sub(as_of, last_days), as_of)).otherwise(span(day_, day_))
    )
