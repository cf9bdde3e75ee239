"""Language identification with error-correcting output codes.

Every language has a codeword; every bit of it is a binary classifier over hashed byte n-grams, learned to tell the languages
whose bit is set from the others. A text's margins, one for each bit, are compared with all codewords: each bit's loss is weighted
by how well its classifier parts the languages, and the language with the least loss is chosen. Where the second is nearly as
near, the answer is flagged as ambiguous.

Classifiers are linear: weights are log odds of n-gram frequencies between the two groups of languages, each document
counting alike and each language alike. A margin is scaled so that the mean of a bit's weaker group is 1. Learning takes about
SAMPLE_ROWS labelled texts at most, an equal share for each language, chosen by a hash of the text; prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import apart, col, flat, forget, held_out, slices, together

#: Labelled rows that classifiers are fitted on, at most about so many.
SAMPLE_ROWS = 40_000
#: Features: hashed byte n-grams of these lengths.
FEATURES, LENGTHS = 1 << 14, (1, 2, 3)
#: The answer is ambiguous where the runner-up's share of the score is within this of the winner's.
AMBIGUOUS = 0.2
#: A text of so many letters is rejected where it is ambiguous and its least loss is over FAR. Margins of zero have ln 2 = 0.69 on every bit, random letters 0.5
#: to 0.6, prose of the learned languages 0.1 to 0.3.
LETTERS, FAR = 200, 0.45
#: Steepness of the score.
SHARPNESS = 4.0
UNKNOWN = "und"

#: Letters (lower-cased ASCII, all of UTF-8) stay, anything else is a blank.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def features(raw: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Relative frequencies of the hashed n-grams of each text."""
    text = _FOLD[raw].astype(np.uint32)
    grams, value = [], np.zeros(len(text), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        value = value[: len(text) - n + 1] * np.uint32(0x01000193) + text[n - 1 :] + np.uint32(1) if n > 1 else text + np.uint32(1)
        if n in LENGTHS:
            mixed = value * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            grams.append(((mixed * np.uint32(0x85EBCA77)) >> np.uint32(18)).astype(np.int16))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        counts = np.zeros(FEATURES)
        for n, g in zip(LENGTHS, grams, strict=True):
            if b - a >= n:
                counts += np.bincount(g[a : b - n + 1], minlength=FEATURES)
        total = counts.sum()
        yield counts / total if total else counts


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1. Up to 7 languages: all distinct splits into two groups; more: columns of a seeded random code, the best of several."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    length, best = 15 * (n - 1).bit_length(), None
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, length))
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        usable = all(abs(c.sum()) < n for c in code.T)
        if usable and (best is None or far > best[0]):
            best = far, code
    if best is None:
        raise ValueError("no code found")
    return best[1]


class Classifier:
    """languages, code (language x bit), weights (feature x bit), bias and bit_weight (by bit)."""

    def __init__(self, means: dict[str, np.ndarray]):
        """means: each language's mean of its documents' features."""
        self.languages = sorted(means)
        self.code = codewords(len(self.languages))
        self.weights = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1])
        self.bit_weight = np.ones(self.code.shape[1])
        if len(self.languages) < 2:
            return
        table = np.stack([means[x] for x in self.languages])
        smooth = 0.01 / FEATURES
        for bit, code in enumerate(self.code.T):
            w = np.log(table[code > 0].mean(axis=0) + smooth) - np.log(table[code < 0].mean(axis=0) + smooth)
            at = table @ w
            low, high = at[code > 0].min(), at[code < 0].max()
            half = max((low - high) / 2, 1e-6)  # languages on the wrong side of each other: the bit says little
            self.weights[:, bit] = w / half
            self.bias[bit] = -(low + high) / 2 / half
            self.bit_weight[bit] = max(low - high, 0.0) + 1e-6
        self.bit_weight /= self.bit_weight.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous, the least loss) of each row of margins."""
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30) * 2))
        total = (loss * self.bit_weight).sum(axis=2)
        share = np.exp(-SHARPNESS * (total - total.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        second = order[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return total.argmin(axis=1), order[:, -1], order[:, -1] - second < AMBIGUOUS, total.min(axis=1)


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """From text and lang of rows with both: a bounded sample of distinct texts, an equal share of it for each language.

    A language with few texts is learned from all of them; a text that repeats, however often, counts once for its language.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    keyed = rows.withColumn("h", F.xxhash64("text", F.lit(1)))
    # one row for each language
    sizes = keyed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    share = sizes.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("langs")))).select("lang", F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("langs") / F.col("n")).alias("part"))
    some = keyed.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("part") * (1 << 20)).dropDuplicates(["lang", "h"]).select("text", "lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found: dict[str, list] = {}
        for x in slices(batches):
            for lang, f in zip(col(x, "lang").to_pylist(), features(*flat(col(x, "text"))), strict=True):
                of = found.setdefault(lang, [np.zeros(FEATURES), 0])
                of[0] += f
                of[1] += 1
        # a language's sums in blocks, so that they add up in many tasks
        out = [(lang, block, n, v.tolist()) for lang, (s, n) in found.items() for block, v in enumerate(s.reshape(64, -1))]
        lang, block, n, v = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(block, pa.int32()), pa.array(n, pa.int64()), pa.array(v, pa.list_(pa.float64()))], ["lang", "block", "n", "v"])

    blocks = some.mapInArrow(sums, "lang string, block int, n long, v array<double>")
    added = blocks.select("lang", "block", "n", F.posexplode("v").alias("at", "x")).groupBy("lang", "block", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means: dict[str, np.ndarray] = {}
    for r in added.toLocalIterator():  # FEATURES rows for each language
        means.setdefault(r.lang, np.zeros(FEATURES))[r.block * (FEATURES // 64) + r["at"]] = r.x / r.n
    return Classifier(means)


def predict(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of apart(docs) (id, text, row) with lang_pred, score (0 to 1), loss (of the chosen codeword, 0 at its best) and ambiguous.

    A text that is null or has no letter, and any text where nothing was learned, is `und` with score 0.
    """
    rows = apart(docs)
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        of: Classifier = sent.value
        for x in slices(batches):
            ok = np.array(col(x, "letters").to_pylist(), bool) & bool(of.languages)
            margins = np.zeros((x.num_rows, len(of.bias)))
            for i, f in enumerate(features(*flat(col(x, "text")))):
                at = np.flatnonzero(f)
                margins[i] = f[at] @ of.weights[at] + of.bias
            if of.languages:
                best, score, unsure, loss = of.decode(margins)
            else:
                best, score, unsure, loss = np.zeros(x.num_rows, int), np.zeros(x.num_rows), np.zeros(x.num_rows, bool), np.zeros(x.num_rows)
            lang = [of.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), ok.tolist(), strict=True)]
            new = [pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(loss), pa.array(np.where(ok, unsure, True))]
            yield pa.RecordBatch.from_arrays([col(x, "id"), col(x, "text"), col(x, "row"), *new], ["id", "text", "row", "lang_pred", "score", "loss", "ambiguous"])

    schema = StructType([*rows.schema, *StructType.fromDDL("lang_pred string, score double, loss double, ambiguous boolean")])
    return rows.withColumn("letters", letters).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns; learned from documents whose crc32(doc_id) mod 4 is not 2."""
    classifier = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = predict(docs.select("doc_id", "text"), classifier)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs whose language can be told, with all their columns. Learned from the rows of docs that have a lang.

    A row goes if it is `und`, or if no codeword is near: an ambiguous text of LETTERS letters or more whose classifiers' margins disagree
    with even the nearest codeword by a loss over FAR. Short texts are too little to judge by and stay.
    """
    found = predict(docs, learn(docs.where(~held_out(F.col("doc_id"), 4, 2))))
    far = F.col("ambiguous") & (F.col("loss") > FAR) & (F.length(F.regexp_replace("text", r"\P{L}+", "")) >= LETTERS)
    return together(found.where((F.col("lang_pred") != UNKNOWN) & ~far), docs.columns)
