"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark, one scan of each text.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is WINDOW consecutive words of an item; an
item with fewer words (but some) is one window. Each item is cut into blocks of half a window; whatever holds a window holds one of its blocks
whole. So the patterns are blocks, " w1 w2 ... " over the words joined by one space (a match always covers whole words), and one node a character of the
benchmark is the most there is. The automaton reads the normalised text once. Around a match words are compared with the item's to both sides: a run of a
window's length or more is hit. Ends of matches are mapped back to words, and words to byte offsets of the original text.

The benchmark is gathered in parts of at most PART_BYTES of text: each part is sent to the workers as its words, in one broadcast of bounded size, and
each worker builds its automaton. A benchmark of any size is scanned for, one part after the other; what the parts have found goes with the rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import apart, col, flat, kept, release_memory, slices, together
from .words import LOWER, NOT_ALNUM, find_words, joined

WINDOW = 10
#: Normalised text of the benchmark in one automaton: 40 bytes a node, so about 100 MB in a worker.
PART_BYTES = 2 << 20
_NEW = ("n_words", "hit_from", "hit_to", "items")


def _words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = find_words(raw, np.array([0, len(raw)]), NOT_ALNUM)
    low = LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Machine:
    """The automaton over blocks, and the items' words to compare with."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, half = window, (window + 1) // 2
        self.items = [(item, words.split()) for item, words in items]
        found: dict[bytes, list[tuple[int, int, int]]] = {}
        for i, (_, words) in enumerate(self.items):
            if len(words) < window:
                blocks = [(0, len(words))] if words else []
            else:
                blocks = [(at, half) for at in range(0, len(words) - half + 1, half)]
            for at, n in blocks:
                found.setdefault(b" " + b" ".join(words[at : at + n]) + b" ", []).append((i, at, n))
        self.automaton = ahocorasick.Automaton()
        while found:
            pattern, places = found.popitem()
            self.automaton.add_word(pattern.decode("latin-1"), places)
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str, data: bytes, a: list[int], b: list[int]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit, and the items. text: the words joined, a blank in front; a and b: where they begin and end in data, and in text without that blank."""
        hit, items, done, low = None, set(), {}, a[0]
        for end, places in self.automaton.iter(text):
            # the pattern ends with the space after its last word; one more space stands in front of the text
            last = bisect.bisect_right(a, low + end - 1) - 1
            for i, at, n in places:
                item, words = self.items[i]
                left, right = last - n + 1, last + 1
                if len(words) >= self.window:
                    slant = (i, left - at)
                    if done.get(slant, 0) > last:  # in a run that has been followed already
                        continue
                    k = at - 1
                    while left and k >= 0 and words[k] == data[a[left - 1] : b[left - 1]]:
                        left, k = left - 1, k - 1
                    k = at + n
                    while right < len(a) and k < len(words) and words[k] == data[a[right] : b[right]]:
                        right, k = right + 1, k + 1
                    done[slant] = right
                    if right - left < self.window:
                        continue
                if hit is None:
                    hit = np.zeros(len(a), bool)
                hit[left:right] = True
                items.add(item)
        return hit, items


def machine(items: list[tuple[str, bytes]], window: int, key: str) -> Machine:
    """Built once in each worker."""
    return kept(("benchmark", key), lambda: Machine(items, window))


def scan(raw: np.ndarray, offs: np.ndarray, of: Machine) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None, set[str]]]:
    """For each text: its words, the starts and ends of its words in the original, which of them are hit, the items."""
    starts, ends, first = find_words(raw, offs, NOT_ALNUM)
    data, a, b = joined(LOWER[raw], starts, ends)
    text = data.decode("latin-1")
    live = len(of.automaton) > 0
    for i in range(len(offs) - 1):
        f, t = int(first[i]), int(first[i + 1])
        hit, items = None, set()
        if t > f and live:
            low, high = int(a[f]), int(b[t - 1]) + 1
            hit, items = of.find(" " + text[low:high], data, a[f:t].tolist(), b[f:t].tolist())
        yield t - f, starts[f:t] - offs[i], ends[f:t] - offs[i], hit, items


def _parts(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items' words, joined by blanks, in parts of at most so many bytes. A longer item goes on in the next part, a window less one word earlier."""
    part, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null").toLocalIterator():
        words, at = _words(text or ""), 0
        while True:
            n, bytes_ = 0, 0
            while at + n < len(words) and (n < 2 * window or bytes_ + len(words[at + n]) < most):
                bytes_ += len(words[at + n]) + 1
                n += 1
            if part and size + bytes_ > most:
                yield part
                part, size = [], 0
            part.append((item, b" ".join(words[at : at + n])))
            size += bytes_
            if at + n >= len(words):
                break
            at += n - window + 1
    if part:
        yield part


def _scanned(rows: DataFrame, items, window: int, key: str) -> DataFrame:
    """rows (id, text, row) with n_words, hit_from and hit_to (bytes of the hit words) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = machine(items.value, window, key)
        for x in slices(batches):
            out = []
            for n, starts, ends, hit, found in scan(*flat(col(x, "text")), of):
                if hit is None:
                    out.append((n, [], [], []))
                else:
                    out.append((n, starts[hit].tolist(), ends[hit].tolist(), sorted(found)))
            n, a, b, found = (list(v) for v in zip(*out, strict=True))
            new = [pa.array(n, pa.int64()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([col(x, "id"), col(x, "text"), col(x, "row"), *new], ["id", "text", "row", *_NEW])

    found = ", ".join(f"{c} {k}" for c, k in zip(_NEW, ("long", "array<int>", "array<int>", "array<string>"), strict=True))
    return rows.mapInArrow(run, _with(rows, found))


def _with(rows: DataFrame, more: str) -> StructType:
    return StructType([*rows.select("id", "text", "row").schema, *StructType.fromDDL(more)])


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """id, text, row of apart(docs) with n_words, hit_from, hit_to and items."""
    spark, rows, found = docs.sparkSession, apart(docs), None
    for part in _parts(benchmark, part_bytes, window):
        key = hashlib.sha256(repr((window, part)).encode()).hexdigest()
        if found is not None:  # one more part: what the parts before have found goes with the row
            rows = found.select("id", "text", F.struct("row", *_NEW[1:]).alias("row"))
        of = _scanned(rows, spark.sparkContext.broadcast(part), window, key)
        if found is not None:
            both = [F.array_sort(F.array_union(c, F.col("row").getField(c))).alias(c) for c in _NEW[1:]]
            of = of.select("id", "text", F.col("row.row").alias("row"), "n_words", *both)
        found = of
    return _scanned(rows, spark.sparkContext.broadcast([]), window, "") if found is None else found


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text, n_words, hit_from, hit_to (byte offsets of each hit word in the original text) and items (item ids, sorted strings) of every row.

    A null or empty text has no words. Items that are null, or have no word, never occur. An empty benchmark hits nothing. Several
    items of one id count as one id. Byte offsets are those of the UTF-8 text.
    """
    return _hits(docs, benchmark, window, part_bytes).select(F.col("id").alias("doc_id"), "text", *_NEW)


def digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    n_hit = F.size("hit_from").cast("long")
    return hits(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every hit word cut from its text; what separates it from the next word goes with it. Clean texts stay as they are, and so do further columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for text, a, b in zip(col(x, "text").to_pylist(), col(x, "hit_from").to_pylist(), col(x, "hit_to").to_pylist(), strict=True):
                if a:
                    raw, kept, at = text.encode(), [], 0
                    for s, e in zip(a, b, strict=True):
                        if raw[at:s].translate(_BLANK).strip() or at == 0:
                            kept.append(raw[at:s])
                        at = e
                    kept.append(raw[at:])
                    text = b"".join(kept).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), col(x, "row")], ["text", "row"])
        release_memory()

    found = _hits(docs, benchmark, window, PART_BYTES)
    return together(found.mapInArrow(run, found.select("text", "row").schema), docs.columns)


#: Separators become blanks.
_BLANK = bytes(0x20 if NOT_ALNUM[b] else b for b in range(256))
