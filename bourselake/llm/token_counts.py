"""Token counts by a two-tier lookup on the map side: no pre-token is shuffled.

Tier one is a broadcast hash table of frequent pre-tokens: a fixed number of slots with a 64-bit hash and a token
count. A slice's words are hashed and looked up together in numpy. What misses goes to tier two, a cache that a Python worker
keeps over all its tasks, and from there to the tokenizer. The table is filled from a sample of at most SAMPLE_ROWS
documents. It only saves time: a count is the same from either tier.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, flat, slices
from .tokenizer import Chunks, encoder, load
from .words import U, find_words, word_hashes

LIMIT = 2048
#: Rows of the sample that fills the table; entries and slots of the table.
SAMPLE_ROWS, FREQUENT, SLOTS = 20_000, 1 << 17, 1 << 19


def make_table(words: list[bytes], counts: list[int], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing, linear probing: hashes (0: free) and token counts by slot."""
    keys, values = np.zeros(slots, U), np.zeros(slots, np.uint16)
    if words:
        raw = np.frombuffer(b" ".join(words), np.uint8)
        starts, ends, _ = find_words(raw, np.array([0, len(raw)]))
        for h, n in zip(word_hashes(raw, starts, ends).tolist(), counts, strict=True):
            at = h & (slots - 1)
            while keys[at] and keys[at] != h:
                at = (at + 1) & (slots - 1)
            if h and n < 1 << 16:
                keys[at], values[at] = h, n
    return keys, values


def look_up(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Token counts, -1 where the table has none."""
    out = np.full(len(hashes), -1, np.int64)
    mask = U(len(keys) - 1)
    open_, at = np.arange(len(hashes)), hashes & mask
    while len(open_):
        found = keys[at]
        hit = found == hashes[open_]
        out[open_[hit]] = values[at[hit]]
        on = ~hit & (found != 0)
        open_, at = open_[on], (at[on] + U(1)) & mask
    return out


def frequent(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The most frequent pre-tokens of a sample of the documents, at most so many."""
    total = docs.count()
    part = min(1.0, sample_rows / max(total, 1))
    keyed = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    # distinct texts: one that repeats, however often, is in the sample once or not at all
    some = keyed.where(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20)).dropDuplicates(["h"]).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        for x in slices(batches):
            for t in col(x, "text").to_pylist():
                tally.update(t.encode().split())
        rows = [(w, n) for w, n in tally.most_common(most) if n > 1 and len(w) < 256]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    tallies = some.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [(bytes(r.word), r.n) for r in tallies.orderBy(F.desc("n"), "word").limit(most).collect()]


def counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_tokens, over_limit of every row. A null text is an empty one."""
    spark = docs.sparkSession
    content, name = load(tokenizer)
    of = encoder(content, name)
    two_tier = isinstance(of, Chunks)
    top = [w for w, _ in frequent(docs)] if two_tier else []
    tiers = spark.sparkContext.broadcast((content, name, *make_table(top, [len(of.ids(w)) // 4 for w in top])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, name, keys, values = tiers.value
        of = encoder(content, name)
        for x in slices(batches):
            raw, offs = flat(col(x, "text"))
            if two_tier:
                starts, ends, first = find_words(raw, offs)
                n = look_up(word_hashes(raw, starts, ends), keys, values)
                missed = np.flatnonzero(n < 0)
                data, memo, ids = raw.tobytes(), of.memo, of.ids
                words = [data[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
                n[missed] = [len(memo.get(w) or ids(w)) >> 2 for w in words]
                sums = np.append(0, np.cumsum(n))
                tokens = sums[first[1:]] - sums[first[:-1]]
            else:
                tokens = np.array([len(of.text_ids(t.encode())) // 4 if t else 0 for t in col(x, "text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), pa.array(np.diff(offs)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
