"""The Porter stemmer as column expressions, and tokens of the full-text index. Meant for distinct words: a few dozen tests each.

Whole texts have their words stemmed within the row (stemmed_line), by the same rules in Python, where a task keeps the stems of words it has met.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

# Fixed values of the published algorithm: suffixes and what they become, longest first.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al", "aliti": "al",
    "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "alli": "al", "ator": "ate", "bli": "ble", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]

# An initial y is written Y on the way: it is a consonant. Any other y is one only behind a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_ONCE, _EXACTLY_ONCE, _TWICE = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _CVC = "[aeiouy]", f"^{_C}[aeiouy][\\x00-\\x7F&&[^aeiouwxy]]$"
#: Shorter and longer words stay as they are.
SHORTEST, LONGEST = 3, 64


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.greatest(F.length(word) - n, F.lit(0)))


def _replaced(word: Column, rules: dict[str, str], measure: str, also: Callable[[str, Column], Column] | None = None) -> Column:
    """The first suffix that fits decides; it is replaced where what stands before it has the measure."""
    out = None
    for suffix, new in rules.items():
        stem = _cut(word, len(suffix))
        fits = stem.rlike(measure)
        if also is not None:
            fits = fits & also(suffix, stem)
        then = F.when(fits, F.concat(stem, F.lit(new))).otherwise(word)
        here = word.endswith(suffix) & (F.length(word) > len(suffix))
        out = F.when(here, then) if out is None else out.when(here, then)
    return out.otherwise(word)


def _mended(stem: Column) -> Column:
    """A stem that has lost -ed or -ing."""
    double = stem.rlike(r"([\x00-\x7F&&[^aeioulsz]])\1$|^Yy$")
    return F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(double, _cut(stem, 1)).when(stem.rlike(_EXACTLY_ONCE) & stem.rlike(_CVC), F.concat(stem, F.lit("e"))).otherwise(stem)


def _past(word: Column) -> Column:
    dropped = lambda n: F.when(_cut(word, n).rlike(_VOWEL), let(_cut(word, n), _mended)).otherwise(word)
    longer = lambda suffix: word.endswith(suffix) & (F.length(word) > len(suffix))
    return F.when(longer("eed"), F.when(_cut(word, 3).rlike(_ONCE), _cut(word, 1)).otherwise(word)).when(longer("ed"), dropped(2)).when(longer("ing"), dropped(3)).otherwise(word)


def _final_e(word: Column) -> Column:
    stem = _cut(word, 1)
    goes = stem.rlike(_TWICE) | (stem.rlike(_EXACTLY_ONCE) & ~stem.rlike(_CVC))
    return F.when(word.endswith("e") & goes, stem).otherwise(word)


def stem(word: Column) -> Column:
    """The Porter stem of a lower-case word; anything but a, e, i, o, u and y counts as a consonant, beyond ASCII as more than one."""
    plural = lambda w: F.regexp_replace(w, "^(?:(.+?)(ss|i)es|(.+?[^s])s)$", "$1$2$3")
    y_to_i = lambda w: F.when(w.endswith("y") & _cut(w, 1).rlike(_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)
    ion = lambda suffix, s: s.rlike("[st]$") if suffix == "ion" else F.lit(True)
    step_2, step_3 = (lambda w: _replaced(w, STEP_2, _ONCE)), (lambda w: _replaced(w, STEP_3, _ONCE))
    step_4 = lambda w: _replaced(w, dict.fromkeys(STEP_4, ""), _TWICE, ion)
    double_l = lambda w: F.when(w.endswith("ll") & _cut(w, 1).rlike(_TWICE), _cut(w, 1)).otherwise(w)
    out = F.regexp_replace(word, "^y", "Y")
    for step in (plural, _past, y_to_i, step_2, step_3, step_4, _final_e, double_l):
        out = let(out, step)
    whole = F.octet_length(word).between(SHORTEST, LONGEST)
    return F.when(whole, F.regexp_replace(out, "^Y", "y")).otherwise(word)


#: Letters and digits of ASCII and all beyond it; A-Z lower-cased.
_TOKEN = "([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_tokens(text: Column) -> Column:
    """Tokens of the full-text index before they are stemmed."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower()), F.lit(_TOKEN), 1)


def stemmed(tokens: DataFrame, column: str = "token") -> DataFrame:
    """tokens with the column's words stemmed: each distinct word once, joined back."""
    stems = tokens.select(F.col(column).alias("_word")).distinct().withColumn("_stem", stem(F.col("_word")))
    return tokens.join(stems, F.col(column) == F.col("_word")).withColumn(column, F.col("_stem")).drop("_word", "_stem")


# ---- the same stemmer within the row


@lru_cache(1 << 17)
def stem_of(word: str) -> str:
    """stem() of one word."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    has = lambda pattern, text: re.search(pattern, text) is not None
    once, exactly_once, twice = (lambda text, p=p: has(p, text) for p in (_ONCE, _EXACTLY_ONCE, _TWICE))
    cvc = lambda text: has(f"^{_C}[aeiouy](?![aeiouwxy])[\\x00-\\x7F]$", text)

    def mended(left: str) -> str:
        if left.endswith(("at", "bl", "iz")):
            return left + "e"
        if has(r"((?![aeioulsz])[\x00-\x7F])\1$|^Yy$", left):
            return left[:-1]
        return left + "e" if exactly_once(left) and cvc(left) else left

    def replaced(text: str, rules: dict[str, str], measure: Callable[[str], bool]) -> str:
        for suffix, new in rules.items():
            if text.endswith(suffix) and len(text) > len(suffix):
                left = text[: -len(suffix)]
                return left + new if measure(left) and (suffix != "ion" or left.endswith(("s", "t"))) else text
        return text

    w = re.sub("^(?:(.+?)(ss|i)es|(.+?[^s])s)$", r"\1\2\3", re.sub("^y", "Y", word))
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if once(w[:-3]) else w
    elif (w.endswith("ed") and len(w) > 2) or (w.endswith("ing") and len(w) > 3):
        left = w[:-2] if w.endswith("ed") else w[:-3]
        w = mended(left) if has(_VOWEL, left) else w
    if w.endswith("y") and has(_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(w, STEP_2, once), STEP_3, once)
    w = replaced(w, dict.fromkeys(STEP_4, ""), twice)
    if w.endswith("e") and (twice(w[:-1]) or (exactly_once(w[:-1]) and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and twice(w[:-1]):
        w = w[:-1]
    return re.sub("^Y", "y", w)


def _line(text: str) -> str:
    # a number is its own stem
    return " ".join(sorted({w if w.isdecimal() else stem_of(w) for w in text.split(" ")}))


def _lines(texts: pd.Series) -> pd.Series:
    return texts.map(_line)


def _in_order(lines: pd.Series) -> pd.Series:
    # every rule begins with a last letter
    return lines.map(lambda line: " ".join([stem_of(w) if "a" <= w[-1] <= "z" else w for w in line.split(" ")]) if line else line)


def stemmed_words(text: Column) -> Column:
    """Array of the stems of a text's plain tokens, as they come, repeats included. No word is shuffled."""
    line = F.pandas_udf(_in_order, "string")(F.array_join(plain_tokens(text), " "))
    return F.filter(F.split(line, " "), lambda w: w != "")


def stemmed_line(text: Column) -> Column:
    """The distinct stems of a text's plain tokens, sorted and joined by blanks. No word is shuffled."""
    return F.pandas_udf(_lines, "string")(F.array_join(plain_tokens(text), " "))
