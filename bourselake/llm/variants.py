"""Spelling variant grouping: words one edit apart, found by bands of a letter-parity mask.

A word's mask has one bit for each letter, set where the letter occurs an odd number of times. One inserted or deleted letter flips one bit, one
replaced letter flips two or (letters that share a bit) none. So of the three bands of a mask at least one is equal in
near words. Words meet on an equal band among words whose lengths fit: a pair's class is the length of its shorter word, and a word stands
in the class of its own length and in that of one letter less.

A band alone is shared by too many words: its pairs grow with the square of the vocabulary (4.5 billion over 0.1 GB of text). So a
band's group is split by what else an edit leaves alone: of three thirds of the letters, counted from both ends, it touches one. A word
stands in the group of a band once for each third left out, and near words share at least one of these splits. The masks of what meets
must differ in two bits at most; then the edit distance is verified. A pair that would meet several times counts where it meets first.

Words are counted in each task before they are shuffled. Links are rows of a distributed table; a word's form is the most frequent near word, if it
is `times` as frequent. Forms grow tenfold at each step, so roots are reached by doubling in few rounds, each written down.

A null or empty text has no word; a null doc_id counts as an empty string in the hash that decides which letter goes. Rows that repeat
count each. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, flat, forget, release_memory, slices, written
from .words import LOWER, find_runs, span_crcs

LEAST_LETTERS, LEAST_COUNT, TIMES, DROP = 7, 2, 10, 31
#: Distinct words that a task counts before it hands them on.
TALLY = 400_000
#: Letters by how common they are: they are dealt to the bands in turn, so that the bands are alike.
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
BANDS, BAND_BITS, THIRDS = 3, 21, 3

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def _bits() -> np.ndarray:
    """The mask's bit of each byte. Letters beyond ASCII are 0xC3 and a byte from 0x80 to 0xBF, which share the bits that are left."""
    def bit(nth: int) -> int:
        return 1 << (nth % BANDS * BAND_BITS + nth // BANDS)

    of = [0] * 256
    for nth, c in enumerate(LETTERS):
        of[ord(c)] = bit(nth)
    for b in range(0x80, 0xC0):
        of[b] = bit(len(LETTERS) + b % (BANDS * BAND_BITS - len(LETTERS)))
    return np.array(of, np.int64)


_BITS = _bits()


def runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """find_runs of A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and one byte."""
    wide = raw == 0xC3
    second = np.zeros_like(wide)
    second[1:] = wide[:-1]
    return find_runs(_ASCII[raw] | wide | second, offs)


def _without(word: bytes, nth: int) -> bytes:
    text = word.decode()
    return (text[:nth] + text[nth + 1 :]).encode()


def slice_words(ids: list[int | None], raw: np.ndarray, offs: np.ndarray, least: int, drop: int) -> list[bytes]:
    """The words of a slice that are long enough, after the letter that the hash of id and run takes out of one run in `drop`."""
    starts, ends, first = runs(raw, offs)
    low = LOWER[raw]
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    length = points[ends] - points[starts]
    fits = np.flatnonzero(length >= least)
    starts, ends, length = starts[fits], ends[fits], length[fits]
    text = np.searchsorted(first, fits, "right") - 1
    names = [f"{'' if i is None else i}:".encode() for i in ids]
    at = np.append(0, np.cumsum([len(x) for x in names]))
    front = span_crcs(np.frombuffer(b"".join(names), np.uint8), at[:-1], at[1:])
    h = span_crcs(low, starts, ends, front[text])
    data = low.tobytes()
    words = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    for i in np.flatnonzero(h % drop == 0).tolist():
        # a run of the least length becomes too short
        words[i] = _without(words[i], int(h[i]) % int(length[i])) if length[i] > least else b""
    return words


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word and n of every word that is long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tally: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            tally.pop(b"", None)
            out = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()).cast(pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])
            tally.clear()
            return out

        for x in slices(batches):
            tally.update(slice_words(col(x, "doc_id").to_pylist(), *flat(col(x, "text")), least_letters, drop))
            if len(tally) >= TALLY:
                yield flush()
        yield flush()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def parity_masks(words: DataFrame) -> DataFrame:
    """words with `mask`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, "word"):
            raw, offs = flat(col(x, "word"))
            yield pa.RecordBatch.from_arrays([col(x, "word"), col(x, "n"), pa.array(np.bitwise_xor.reduceat(_BITS[raw], offs[:-1]))], ["word", "n", "mask"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, mask long")


def _band(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(((1 << BAND_BITS) - 1) << BAND_BITS * k))


def _left_alone(word: Column, s: Column, third: int) -> list[Column]:
    """What an edit in this third leaves, in a pair whose shorter word has s letters: letters from the front and letters from the end."""
    front, end = F.floor(s * third / THIRDS).cast("int"), s - F.floor(s * (third + 1) / THIRDS).cast("int")
    return [F.substring(word, F.lit(1), front), F.right(word, end)]


def _keyed(masked: DataFrame, *classes: Column) -> DataFrame:
    """One row for each class, band and third: key (a hash), at (the band and the third), word, n, mask, letters."""
    rows = masked.withColumn("s", F.explode(F.array(*classes)))
    keys = [F.struct(F.xxhash64(F.lit(k), F.lit(t), "s", _band(F.col("mask"), k), *_left_alone(F.col("word"), F.col("s"), t)).alias("key"), F.lit(k * THIRDS + t).alias("at")) for k in range(BANDS) for t in range(THIRDS)]
    return rows.select(F.explode(F.array(*keys)).alias("k"), "word", "n", "mask", "letters").select("k.*", "word", "n", "mask", "letters")


def links(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of every two words (word, n) that are one edit apart, once: a is the shorter, or of one length the smaller."""
    masked = parity_masks(words).withColumn("letters", F.length("word"))
    a = _keyed(masked, F.col("letters")).select(F.col("key"), "at", *(F.col(c).alias(f"{c}_a") for c in ("word", "n", "mask", "letters")))
    b = _keyed(masked, F.col("letters"), F.col("letters") - 1).select("key", *(F.col(c).alias(f"{c}_b") for c in ("word", "n", "mask", "letters")))
    wa, wb, s = F.col("word_a"), F.col("word_b"), F.col("letters_a")
    flipped = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    one_length = F.col("letters_b") == s
    fits = (one_length & (wa < wb)) | (F.col("letters_b") == s + 1)
    # the first band and, of the thirds that might be left out, the first: elsewhere the pair has met already
    band, third = F.floor(F.col("at") / THIRDS), F.col("at") % THIRDS
    first = F.lit(True)
    for k in range(BANDS - 1):
        first = first & ((band <= k) | (_band(flipped, k) != 0))
    for t in range(THIRDS - 1):
        front, end = zip(_left_alone(wa, s, t), _left_alone(wb, s, t), strict=True)
        first = first & ((third <= t) | (front[0] != front[1]) | (end[0] != end[1]))
    near = fits & (F.bit_count(flipped) <= 2) & (F.levenshtein(wa, wb, 1) == 1) & first
    return a.join(b, (a["key"] == b["key"]) & near).select(wa.alias("a"), wb.alias("b"), F.col("n_a"), F.col("n_b"))


def _roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """word and root of every word with a form (word, form). A chain has at most log(most) steps to the base `times`."""
    now = forms.select("word", F.col("form").alias("root"))
    steps = max(1, int(math.log(max(most, 2), times)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        now = written(now.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root")), "roots")
    return now


def groups(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, drop: int = DROP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(word_counts(docs, least_letters, least_count, drop), "words")
    found = links(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    both = found.select(ends.alias("x")).select("x.*")
    # the most frequent, of equal ones the first in code-point order, which is that of the bytes
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    far = -F.col("best.down") >= times * F.col("n")
    near = written(best.select("word", "n_near", F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.down")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(near.where("form is not null"), most, times)
    told = words.join(near, "word", "left").join(roots, "word", "left")
    return told.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
