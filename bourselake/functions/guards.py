"""Guards on texts, and JSON as models write it: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Words, shares and lengths must be these for the results to be right.
COMMON = [
    "the", "of", "to", "and", "in", "is", "for", "on", "at", "by", "we", "as", "it", "be", "an", "or", "are", "not", "has", "our", "its", "was", "but", "had", "from", "with", "this", "that",
    "per", "net", "tax", "all", "any", "may",
]
NON_FINANCIAL = [
    "resignation", "resignations", "auditor resignation", "record date", "export certificate", "star export", "audio link", "conference call link", "investor meet", "analyst meet", "postal ballot", "notice of agm",
    "notice of egm", "scrutinizer report", "compliance certificate", "trading window", "insider trading", "code of conduct", "whistleblower", "change in registered", "change of address", "change in name",
    "disclosure under reg 30", "intimation of appointment", "intimation of resignation", "appointment of director", "allotment of warrants", "allotment of securities", "warrant allotment",
    "board approves allotment", "allotment letter", "convertible warrants", "exercise of warrants", "warrant holder", "investor presentation", "analyst presentation", "postal ballot notice", "notice of postal",
    "order book position", "order book update", "order book as on", "order book status", "order book details", "order book summary",
]
NOISE, REPEATED, SCRAMBLED, SHARES = 0.30, 0.05, 0.07, [("1/6", 1 / 6), ("1/4", 1 / 4), ("1/3", 1 / 3)]
#: The most common short words of further languages, for corpora that are not English alone.
COMMON_ELSEWHERE = {
    "de": ["der", "die", "und", "das", "den", "dem", "ein", "ist", "von", "zu", "mit", "auf", "für", "im", "es", "sie", "er", "des", "so"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "est", "que", "qui", "dans", "par", "pour", "sur", "au", "ce"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "un", "una", "que", "es", "por", "con", "para", "se", "su", "al", "lo"],
}


def garble_ratio(text: Column, sample: int = 1000) -> Column:
    """The share of the first characters that are beyond ASCII or control characters; 1 for no text."""
    noise = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"[^\x00-\x7F]|[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return let(F.substring(text, 1, sample), lambda x: F.when(F.length(x) == 0, 1.0).otherwise(noise(x) / F.length(x)))


def unique_ratio(text: Column) -> Column:
    """Different characters over all of the first 500, without blanks and line ends; null for 50 or fewer."""
    chars = F.filter(F.split(F.regexp_replace(F.substring(text, 1, 500), "[ \n]", ""), ""), lambda c: c != "")
    return let(chars, lambda c: F.when(F.size(c) > 50, F.size(F.array_distinct(c)) / F.size(c)))


def common_ratio(text: Column, share: float, words: list[str]) -> Column:
    """The share of common words among the words of two to four letters in 2 000 characters from a place in the text; null for fewer than 20."""
    window = F.lower(F.substring(text, F.floor(F.length(text) * F.lit(share)).cast("int") + 1, F.lit(2000)))
    short = F.filter(F.regexp_extract_all(window, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z]{2,4}$"))
    return let(short, lambda ws: F.when(F.size(ws) >= 20, F.size(F.filter(ws, lambda w: w.isin(words))) / F.size(ws)))


def rejected(text: Column, words: list[str] = COMMON) -> Column:
    """Why a text is too garbled to be read: noise, repeated, or scrambled at one of three places; null where it is not. A null text is noise."""
    text = F.coalesce(text, F.lit(""))
    where = [F.when((F.length(text) > 1500) & (common_ratio(text, share, words) < SCRAMBLED), f"scrambled at {name}") for name, share in SHARES]
    return F.coalesce(F.when(garble_ratio(text) > NOISE, "noise"), F.when(unique_ratio(text) < REPEATED, "repeated"), *where)


def is_non_financial(text: Column) -> Column:
    """Two phrases of administrative filings or more in the first 1 500 characters, or one where no amount is near."""
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 1500))
    hits = sum((low.contains(w).cast("int") for w in NON_FINANCIAL), F.lit(0))
    amount = F.substring(F.coalesce(text, F.lit("")), 1, 2000).rlike(r"\d{2,}[\.,]\d{2}")
    return let(hits, lambda n: (n >= 2) | ((n >= 1) & ~amount))


# ---- JSON

NULLS = ["null", "none", ""]


def outermost_object(text: Column) -> Column:
    """The first object of a text, by balanced braces outside of strings; null where it does not end. Fences around it go."""
    bare = F.regexp_replace(text, r"(?i)```(?:json)?\s*", "")
    rest = F.substring(bare, F.locate("{", bare), F.length(bare))
    # strings are pieces of their own, so their braces do not count
    pieces = F.regexp_extract_all(rest, F.lit(r'("(?:[^"\\]|\\[\s\S])*"|[{}]|[^"{}]+|")'), 1)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("taken"))

    def step(s: Column, piece: Column) -> Column:
        depth = s.depth + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(s.done, s).otherwise(F.struct(depth.alias("depth"), (depth == 0).alias("done"), F.array_append(s.taken, piece).alias("taken")))

    found = F.aggregate(pieces, begin, step, lambda s: F.when(s.done, F.array_join(s.taken, "")))
    return F.when(bare.contains("{"), found)


def json_fields(text: Column, names: list[str]) -> list[Column]:
    """Fields of a text's outermost object as strings; null words and absent fields are null, and so is everything where it is no JSON."""
    value = F.try_parse_json(outermost_object(text))
    out = []
    for n in names:
        field = F.try_variant_get(value, f"$.{n}", "string")
        out.append(F.when(~F.lower(field).isin(NULLS), field).alias(n))
    return out


def json_list(text: Column) -> Column:
    """A JSON array's items as strings; [] for anything else."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    is_list = whole.startswith("[") & F.try_parse_json(whole).isNotNull()
    return F.coalesce(F.when(is_list, F.from_json(whole, "array<string>")), F.array().cast("array<string>"))
