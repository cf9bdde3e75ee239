"""Repeated passages, found by relative Lempel-Ziv parsing of documents against indexed blocks of the corpus.

A document is parsed into factors: longest matches that occur earlier in the corpus (smaller doc_id, or earlier in the same document),
and literal words between them. A factor is sufficiently long if it has WINDOW words or more; shorter ones are literals here. Every
window that straddles the end of a factor is looked up by itself, so factors overlap where both ends occur earlier.

1. A task takes its documents in slices of BLOCK_BYTES. A slice is a reference block, indexed by the hash of each window. Its documents
   are parsed greedily: where a window is in the index, the match with its source is extended word by word as far as it goes, and
   the parse goes on behind it (first the windows across the boundary). Sources are the block itself and a bounded
   reference of passages that have repeated in the task's blocks before. Matches are compared on the hashes of their words,
   64 bits for each word. A passage, however frequent, so leaves a task about once.
2. What stays new is parsed against all other blocks. Their index is cut by anchors: a window belongs to the smallest hash among its
   runs of ANCHOR words, and equal windows have equal anchors. Neighbouring windows of one anchor travel as one phrase of up to
   WINDOW - ANCHOR + 1 windows with 64 bits of hash each; the shuffle brings a phrase to the one part of the index that can hold its
   windows, and phrases whose anchor nobody else has end there. The first of equal windows by (doc_id, start) is their source.
3. Pieces that follow their source word by word become one factor (joined_factors): the longest match again.

Between blocks, windows are equal if 128 bits of hash agree: the anchor's 64 and the window's 64.
Rows of one doc_id and one text are one document, repeated: all get the same result. A null doc_id comes after all others. Rows with
one doc_id and several texts go by a hash of the text. Null, empty and short texts have no factor. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, col, flat, forget, longs, release_memory, slices, together
from .words import U, find_words, run_hashes, word_hashes

WINDOW, ANCHOR = 20, 5
#: Bytes of text in a reference block, and windows in the reference that a task keeps.
BLOCK_BYTES, REFERENCE = 2 << 20, 1 << 17
LAST = 2**63 - 1
#: Bytes of a window's hash.
REST = 8
_PIECES = "d long, k int, at int, n int, ref_d long, ref_k int, ref_at int"
_PHRASES = f"g long, {_PIECES}, rest binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and their lengths; breaks: True at the first of each."""
    begins = np.flatnonzero(breaks)
    return begins, np.diff(np.append(begins, len(breaks)))


def _match(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two stretches have in common from their beginning."""
    n, step, at = min(len(a), len(b)), 64, 0
    a, b = a[:n], b[:n]
    while at < n:
        same = a[at : at + step] == b[at : at + step]
        if not same.all():
            return at + int(same.argmin())
        at += len(same)
        step *= 4
    return n


class Reference:
    """Windows that have repeated in a task's blocks: hash -> where it first was (d, k, at). The latest stay."""

    def __init__(self, most: int):
        self.most = most
        self.h, self.where = np.empty(0, U), np.empty((0, 3), np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for none."""
        if not len(self.h):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def add(self, h: np.ndarray, where: np.ndarray) -> None:
        """h: distinct, in order of their last use, none known yet; beyond the bound the older half goes."""
        if len(self.h) + len(h) > self.most:
            self.h, self.where = np.empty(0, U), np.empty((0, 3), np.int64)
            h, where = h[-self.most :], where[-self.most :]
        order = np.argsort(np.append(self.h, h), kind="stable")
        self.h, self.where = np.append(self.h, h)[order], np.concatenate([self.where, where])[order]


def _parse(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    anchor, most, block = min(ANCHOR, window), REFERENCE, BLOCK_BYTES
    names = [f.split()[0] for f in _PHRASES.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = Reference(most)
        for x in slices(batches, most=block):
            d, k = longs(col(x, "d"), LAST), longs(col(x, "k"), 0)
            order = np.lexsort((k, d))
            order = order[np.append(True, (k[order][1:] != k[order][:-1]) | (d[order][1:] != d[order][:-1]))]
            d, k = d[order], k[order]
            raw, offs = flat(col(x, "text").take(pa.array(order)))
            starts, ends, first = find_words(raw, offs)
            if len(starts) < window:
                continue
            hashes = word_hashes(raw, starts, ends)
            doc = np.repeat(np.arange(len(d), dtype=np.int32), np.diff(first))
            fits = np.arange(len(starts)) + window <= first[doc + 1]  # a window starts here
            valid = np.flatnonzero(fits)
            if not len(valid):
                continue
            whole = run_hashes(hashes, window)
            # the block's index: each window's earliest place
            _, where, which = np.unique(whole[valid], return_index=True, return_inverse=True)
            source = np.full(len(starts), -1, np.int64)
            source[valid] = valid[where[which]]
            place = np.flatnonzero(source == np.arange(len(starts)))  # first of their kind in the block
            old = known.find(whole[place])
            spot = np.stack([d[doc[place]], k[doc[place]], place - first[doc[place]]], axis=1)
            # earlier by (d, k, at), both sorted by significance
            was = known.where[old] if len(known.h) else spot
            earlier = (old >= 0) & ((was[:, 0] < spot[:, 0]) | ((was[:, 0] == spot[:, 0]) & ((was[:, 1] < spot[:, 1]) | ((was[:, 1] == spot[:, 1]) & (was[:, 2] < spot[:, 2])))))
            told = np.full(len(starts), -1, np.int64)  # place in the kept reference
            told[place[earlier]] = old[earlier]
            repeats = np.flatnonzero(((source >= 0) & (source < np.arange(len(starts)))) | (told >= 0))

            # greedy parse: longest match with the source, then the windows across its end
            factors: list[tuple[int, int, int, int, int]] = []
            i, n = 0, len(repeats)
            while i < n:
                at = int(repeats[i])
                end = int(first[doc[at] + 1])
                if told[at] >= 0:  # from the kept reference: as far as its windows follow each other there
                    rd, rk, ra = known.where[told[at]].tolist()
                    words = window
                    while at + words - window + 1 < len(told) and (t := told[at + words - window + 1]) >= 0 and known.where[t].tolist() == [rd, rk, ra + words - window + 1]:
                        words += 1
                else:
                    s = int(source[at])
                    words = _match(hashes[at:end], hashes[s : int(first[doc[s] + 1])])
                    if words < window:  # equal hashes of unequal words
                        i += 1
                        continue
                    rd, rk, ra = int(d[doc[s]]), int(k[doc[s]]), s - int(first[doc[s]])
                factors.append((at, words - window + 1, rd, rk, ra))
                i = int(np.searchsorted(repeats, at + words - window + 1))
            if factors:
                f = np.array(factors, np.int64)
                o = f[:, 0]
                own = (d[doc[o]] * 31 + o) * 0x9E3779B1  # rows of their own: they only pass the index, whatever part it is
                cols = [own, d[doc[o]], k[doc[o]], o - first[doc[o]], f[:, 1], f[:, 2], f[:, 3], f[:, 4]]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(cols, _KINDS, strict=False)), pa.nulls(len(o), pa.binary())], names)

            # what has repeated here is kept for the task's next blocks
            again = np.unique(source[(source >= 0) & (source < np.arange(len(starts)))])
            again = again[known.find(whole[again]) < 0]
            if len(again):
                known.add(whole[again], np.stack([d[doc[again]], k[doc[again]], again - first[doc[again]]], axis=1))

            # phrases for all other blocks: neighbouring new windows with one anchor
            fresh = place[~earlier]
            if not len(fresh):
                continue
            anchors = run_hashes(hashes, anchor)
            smallest = sliding_window_view(anchors, window - anchor + 1)
            low = np.concatenate([v + smallest[v].argmin(axis=1) for v in np.array_split(fresh, 1 + len(fresh) // (1 << 16))])
            goes_on = np.append(False, (fresh[1:] == fresh[:-1] + 1) & (low[1:] == low[:-1]) & (doc[fresh[1:]] == doc[fresh[:-1]]))
            b, n = _runs(~goes_on)
            o = fresh[b]
            data = whole[fresh].astype(">u8").tobytes()
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((np.append(b, len(fresh)) * REST).astype(np.int32)), pa.py_buffer(data)])
            cols = [anchors[low[b]].view(np.int64), d[doc[o]], k[doc[o]], o - first[doc[o]], n]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(cols, _KINDS, strict=False)), *(pa.nulls(len(b), t) for t in _KINDS[5:8]), packed], names)

    return parse


def _texts(docs: DataFrame) -> DataFrame:
    """The rows of apart() with d and k, which name a document: its doc_id (LAST for null) and a hash of its text."""
    return docs.withColumns({"d": F.coalesce("id", F.lit(LAST)), "k": F.xxhash64("text").bitwiseAND(F.lit(2**31 - 1)).cast("int")})


def pieces(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, k, at, n, ref_d, ref_k, ref_at: matches of n windows; parts of factors where anchors have cut them."""
    phrases = texts.select("d", "k", "text").where("text is not null").mapInArrow(_parse(window), _PHRASES)
    met = phrases.withColumn("same", F.count("*").over(Window.partitionBy("g"))).where("same > 1 or rest is null")
    own = F.col("rest").isNull()
    each = met.select("*", F.explode(F.when(own, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))).alias("p"))
    each = each.withColumn("w", F.substring("rest", F.col("p") * REST + 1, F.lit(REST))).drop("rest", "same")
    order = Window.partitionBy("g", "w").orderBy("d", "k", F.col("at") + F.col("p"))
    first = F.first(F.struct("d", "k", (F.col("at") + F.col("p")).alias("at"))).over(order)
    ranked = each.select("*", F.when(F.col("w").isNotNull(), F.rank().over(order)).alias("r"), first.alias("f")).where("w is null or r > 1")
    own = F.col("w").isNull()
    ref = [F.coalesce("ref_d", "f.d").alias("ref_d"), F.coalesce("ref_k", "f.k").alias("ref_k"), F.when(own, F.col("ref_at")).otherwise(F.col("f.at") - F.col("p")).alias("ref_at")]
    joined = ranked.groupBy("g", "d", "k", "at", "n", own.alias("own"), *ref).agg(F.min("p").alias("low"), F.max("p").alias("high"))
    return joined.select("d", "k", (F.col("at") + F.col("low")).alias("at"), F.when(F.col("own"), F.col("n")).otherwise(F.col("high") - F.col("low") + 1).cast("int").alias("n"), "ref_d", "ref_k", (F.col("ref_at") + F.col("low")).alias("ref_at"))


def joined_factors(parts: list[dict], window: int = WINDOW) -> list[tuple[int, int, tuple[int, int, int]]]:
    """(first word, words, source (d, k, first word)) of a document's factors, by their place: pieces that go on in one source are one factor."""
    out: list[list] = []
    at_end: dict[tuple[int, int, int], list] = {}  # (source, shift) -> the factor that has it
    for p in sorted(parts, key=lambda p: (p["at"], -p["n"])):
        key = p["ref_d"], p["ref_k"], p["ref_at"] - p["at"]
        last = at_end.get(key)
        if last is not None and p["at"] <= last[0] + last[1]:  # windows without a gap
            last[1] = max(last[1], p["at"] + p["n"] - last[0])
        else:
            last = at_end[key] = [p["at"], p["n"], (p["ref_d"], p["ref_k"], p["ref_at"])]
            out.append(last)
    return [(at, n + window - 1, ref) for at, n, ref in out]


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id (null: the last long), k (hash of the text), factors: array of (at, words, ref_d, ref_k, ref_at) of every document that has any."""
    found = pieces(_texts(apart(docs)), window).groupBy("d", "k").agg(F.collect_list(F.struct("at", "n", "ref_d", "ref_k", "ref_at")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [[(a, n, *ref) for a, n, ref in joined_factors(p, window)] for p in col(x, "parts").to_pylist()]
            kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("ref_d", pa.int64()), ("ref_k", pa.int32()), ("ref_at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([col(x, "d"), col(x, "k"), pa.array([[dict(zip(("at", "words", "ref_d", "ref_k", "ref_at"), f, strict=True)) for f in r] for r in rows], kind)], ["doc_id", "k", "factors"])

    return found.mapInArrow(run, "doc_id long, k int, factors array<struct<at:int,words:int,ref_d:long,ref_k:int,ref_at:int>>")


def _with_pieces(rows: DataFrame, window: int) -> DataFrame:
    """rows with the text as zstd-compressed bytes (it is the bulk of the shuffle), and at and n of the document's pieces."""
    keyed = _texts(rows)
    names = keyed.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        put = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for x in batches:
            text = pa.array([None if t is None else put(t.encode()) for t in col(x, "text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([text if c == "text" else col(x, c) for c in names], names)
        release_memory()

    packed = keyed.mapInArrow(pack, keyed.withColumn("text", F.col("text").cast("binary")).schema)
    of = pieces(keyed, window).groupBy("d", "k").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    return packed.join(of, ["d", "k"], "left")


def _cut(window: int, x: pa.RecordBatch) -> Iterator[tuple[bytes | None, int, int, bytes]]:
    """(text, words, removed words, kept words joined by a space) of each row: what a factor covers goes."""
    at, n = col(x, "at"), col(x, "n")
    get = zstandard.ZstdDecompressor().decompress
    for i, packed in enumerate(col(x, "text").to_pylist()):
        text = None if packed is None else get(packed)
        kept = words = (text or b"").split()
        if at[i].is_valid:
            gone = np.zeros(len(words) + 1, np.int64)
            a = at[i].values.to_numpy()
            np.add.at(gone, a, 1)
            np.subtract.at(gone, a + n[i].values.to_numpy() + (window - 1), 1)
            keep = np.cumsum(gone) == 0
            kept = [w for w, k in zip(words, keep.tolist(), strict=False) if k]
        yield text, len(words), len(words) - len(kept), b" ".join(kept)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in batches:
            rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for _, n, gone, kept in _cut(window, x)]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([col(x, "id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        release_memory()

    rows = apart(docs.select("doc_id", "text")).drop("row")
    return _with_pieces(rows, window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the removed words cut from text: the kept words joined by one space. Texts without a repeat stay as they are, and so do further columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for x in batches:
            new = [kept if gone else text for text, _, gone, kept in _cut(window, x)]
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else t.decode() for t in new], pa.string()), col(x, "row")], ["text", "row"])
        release_memory()

    rows = apart(docs)
    return together(_with_pieces(rows, window).mapInArrow(run, rows.select("text", "row").schema), docs.columns)
