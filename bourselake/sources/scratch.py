"""Tables on their way: spread over the cores, or written once to the shared folder and read back, so that what uses them twice reads files and lost executors cost little."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.jobs import shared_folder


class Scratch:
    """A folder of its own below the shared one; drop() deletes it when nothing reads from it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(rows: DataFrame) -> DataFrame:
    """A scanned table over as many partitions as there are cores, where its files give fewer: for much work a row. A table with more splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
