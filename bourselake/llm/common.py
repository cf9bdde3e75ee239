"""Shared helpers of the corpus operators: input tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows and bytes of an Arrow batch between Spark and Python: texts are long, and a batch is held as a whole on both sides.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches in rows and bytes; a smaller setting of the session's own stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(size), re.I)
    if now and not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what setCheckpointDir has set. Only a master on this
    machine gets one of its own where neither is there; on a cluster nobody else would see it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bourselake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job needs only on its way, in a folder of their own below the shared one; it is deleted at the end of the with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def apart(docs: DataFrame) -> DataFrame:
    """id (doc_id as a long), text (string) and row: a struct of all columns of docs but text. Nothing that a stage adds can clash with a name in docs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))


def together(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns `names` of what apart() has taken apart."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names))


def with_text_hash(docs: DataFrame) -> DataFrame:
    """id (doc_id as a long), t (a hash of the text; id and t tell rows of one doc_id apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def held_out(doc_id, parts: int, part: int):
    """True where crc32(doc_id as text) mod parts is part; a null doc_id is never held out."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % parts == part, F.lit(False))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the offsets of each text in them. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_kept: dict = {}


def kept(key, make):
    """What a worker keeps from task to task: one thing, made when it is first asked for. Another key drops it."""
    if key not in _kept:
        _kept.clear()
        release_memory()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """For tasks that keep nothing: drops what another operator's tasks have left in this worker."""
    if _kept:
        _kept.clear()
        release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system: a worker that is kept for later tasks doesn't hold on to its largest moment."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds at most so many bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(values: pa.Array, null: int) -> np.ndarray:
    return values.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)
