"""Structured Streaming jobs for incremental ingest. Each runs with availableNow and can be started again from its checkpoint."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a master on this machine does without it; on a cluster nobody else would see another folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: tables on their way need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bourselake-stream-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event feed as a stream; timestamps without a zone are taken as the session's, so that they can carry a watermark."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path + "*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """The first of equal keys within the watermark; state is dropped beyond it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str, delay: str, *keys: str) -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("date").alias("day"), *keys, "n")


def sliding(events: DataFrame, width: str, step: str, delay: str, *keys: str) -> DataFrame:
    """Counts in windows that overlap: each event is in width / step of them. A row is dropped from the windows that the watermark has passed, from no other."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), "n")


def alerts(events: DataFrame, watched: DataFrame, key: str) -> DataFrame:
    """Events of watched keys: a stream joined with a static table."""
    return events.join(watched.select(key).distinct(), key, "left_semi")


def _ended(q, timeout: int | None) -> None:
    if timeout is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout):
        raise TimeoutError("the stream has not ended")


def run_to_table(stream: DataFrame, mode: str = "append", timeout: int | None = None) -> DataFrame:
    """Runs all there is, however long it takes (timeout: seconds). Append mode leaves files; complete mode keeps the last batch's rows."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    try:
        _ended(q, timeout)
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def ingest(stream: DataFrame, target: str, key: list[str], order: list[str], day: str, checkpoint: str, timeout: int | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Insert-or-ignore of each batch into a Parquet table partitioned by `day`.

    A batch is compared with the partitions of its own days only, and only those are written again; a batch that is run twice changes nothing.
    """
    from ..operators.merge import insert_ignore

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = (enrich(batch) if enrich else batch).persist()
        try:
            exists = spark._jvm.org.apache.hadoop.fs.Path(target)
            fs = exists.getFileSystem(spark._jsc.hadoopConfiguration())
            old = spark.read.schema(rows.schema).parquet(target).join(rows.select(day).distinct(), day, "left_semi") if fs.exists(exists) else rows.limit(0)
            merged = insert_ignore(old.select(*rows.columns), rows, key, [F.col(c) for c in order])
            staged = f"{checkpoint}/staged-{number}"
            merged.write.mode("overwrite").parquet(staged)
            spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)
        finally:
            rows.unpersist()

    q = stream.writeStream.option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).foreachBatch(write).start()
    try:
        _ended(q, timeout)
    finally:
        q.stop()


__all__ = ["alerts", "deduplicated", "ingest", "read_events", "run_to_table", "sessions", "setting", "shared_folder", "sliding", "tumbling"]
