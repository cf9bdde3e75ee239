"""Token ids in Parquet list columns: dictionary-coded ids, delta-coded metadata, bounded row groups and pages.

A file's rows ascend by doc_id; files ascend by their number. Columns: doc_id, part (the file's number), offset (ids of the
file before this document), n_tokens, ids. Ids are dictionary-coded (a vocabulary's dictionary page is small), the other columns
delta-coded. Row groups and pages are bounded, and Parquet's page index lets a reader skip pages: a filter on doc_id or a
selection of columns reads little more than what it asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, slices
from .tokenizer import encoder, load

END = 1
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 1024,
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = "doc_id long, part int, offset long, n_tokens int, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes every text and writes the files. A null text is an empty one; each document ends with the id `end`.

    Null doc_ids come first. Rows of one doc_id go by a hash of their text; repeated rows are written as often as they are there.
    """
    source = docs.sparkSession.sparkContext.broadcast(load(tokenizer))
    last = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, before = encoder(*source.value), 0
        for x in slices(batches):
            packed = [of.text_ids(t.encode()) + last if t else last for t in col(x, "text").to_pylist()]
            n = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), pa.array(before + ends - n), pa.array(n, pa.int32()), ids], ["doc_id", "offset", "n_tokens", "ids"])
            before += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    coded = sorted_rows.mapInArrow(encode, "doc_id long, offset long, n_tokens int, ids array<int>")
    coded.select("doc_id", F.spark_partition_id().alias("part"), "offset", "n_tokens", "ids").write.options(**FILE_OPTIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents; the filter reaches row groups and pages."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, offset, n_tokens, start: metadata only, ids are not read. start: ids of all documents before."""
    rows = read(spark, path).select("doc_id", "part", "offset", "n_tokens")
    return _with_start(rows, spark, path)


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # One row for each file: small however many documents there are.
    files = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = files.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """The contract's columns from the files: doc_id, start, n_tokens, ids_crc32."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = col(x, "ids")
            at = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([col(x, "doc_id"), col(x, "part"), col(x, "offset"), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "offset", "n_tokens", "ids_crc32"])

    rows = read(spark, path).mapInArrow(crc, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")
    return _with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
