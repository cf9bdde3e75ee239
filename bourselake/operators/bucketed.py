"""A table in hash buckets whose writes touch only the buckets they must: upserts, inserts and deletes by key, one atomic step each.

Rows lie in `buckets` folders by a hash of their key, sorted by it, with Parquet Bloom filters on the key's columns. A change reads the buckets that its
batch's keys fall into, merges, writes those anew beside the old ones and adds one version (sources.versions) that names the folder of every bucket. All
other buckets keep their files; until the version is there readers see the former table. A look-up by keys opens only the buckets of those keys.

With `unique` a second column of unique values (a URL) has an index of its own in buckets: value and bucket of its row. So an update by that column finds
the row wherever it lies, and both are switched by the same version.

The first batch sets the schema. Nulls hash like any value; inserts take rows with a null in the key as new, always, as SQL's UNIQUE does.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.versions import Versions
from . import merge

BUCKETS = 64


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS, unique: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.unique = spark, path.rstrip("/"), key, buckets, unique
        self.versions = Versions(spark, path)

    # ---- reading

    def read(self) -> DataFrame:
        """The table as it is now."""
        state = self.versions.latest()
        return self._rows(state, "files", None)

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys (columns named like the table's key), from the buckets of those keys only."""
        state, wanted = self.versions.latest(), keys.select(*self.key).distinct()
        return self._rows(state, "files", self._touched(wanted, self.key)).join(wanted, self.key, "left_semi")

    def get_ids(self, ids: list) -> DataFrame:
        """Rows of a few values of a one-column key: the comparison reaches the files' Bloom filters and statistics."""
        state = self.versions.latest()
        kind = _schema(state)[self.key[0]].dataType.simpleString()
        buckets = self._touched(self.spark.createDataFrame([(i,) for i in ids], f"`{self.key[0]}` {kind}"), self.key)
        return self._rows(state, "files", buckets).where(F.col(self.key[0]).isin(ids))

    def _rows(self, state: dict, kind: str, buckets: list[int] | None) -> DataFrame:
        schema = _schema(state) if kind == "files" else StructType.fromJson(json.loads(state["index_schema"]))
        at = state.get(kind, {})
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in sorted(at.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame, columns: list[str]) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket(columns).alias("b")).distinct().collect())  # at most a row a bucket

    # ---- writing

    def upsert(self, batch: DataFrame, order: list[Column]) -> int:
        """Rows of the batch in place of those of the same key; of several in the batch the last by `order`."""
        return self._change(batch, lambda old, new: merge.upsert(old, new, self.key, order))

    def insert_ignore(self, batch: DataFrame, order: list[Column]) -> int:
        """The batch's rows of new keys, of each key the first by `order`."""
        return self._change(batch, lambda old, new: merge.insert_ignore(old, new.select(*old.columns), self.key, order))

    def replace_groups(self, batch: DataFrame) -> int:
        """The batch in place of all rows of its keys: a key that names groups of rows."""
        return self._change(batch, lambda old, new: merge.replace_groups(old, new, self.key))

    def delete(self, keys: DataFrame) -> int:
        return self._change(keys.select(*self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti").select(*old.columns), rows=False)

    def update_or_insert(self, batch: DataFrame, order: Column) -> int:
        """By the unique column, see merge.update_or_insert: also the buckets that the batch's values lie in now are merged."""
        return self._change(batch, lambda old, new: merge.update_or_insert(old, new, self.unique, self.key, order), by_unique=True)

    def _change(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], rows: bool = True, by_unique: bool = False) -> int:
        """Merges the batch into its buckets; the number of the new version."""
        state = self.versions.latest()
        incoming = self.versions.folder("incoming")
        batch.write.parquet(f"{self.path}/{incoming}")
        batch = self.spark.read.schema(batch.schema).parquet(f"{self.path}/{incoming}")
        if "schema" not in state:
            if not rows:
                return state["version"]
            state = {**state, "schema": batch.schema.json(), "files": {}, "index": {}}
        schema = _schema(state)
        touched = self._touched(batch, self.key)
        of_unique, known = [], None
        if self.unique and rows:
            one = StructType([schema[self.unique]]).add("at", "integer")
            state.setdefault("index_schema", one.json())
            of_unique = self._touched(batch, [self.unique])
            known = self._rows(state, "index", of_unique)
            if by_unique:
                met = known.join(batch.select(self.unique), self.unique, "left_semi").select("at").distinct().collect()  # at most a row a bucket
                touched = sorted({*touched, *(r["at"] for r in met)})
        columns = schema.names
        old = self._rows(state, "files", touched)
        files = dict(state["files"])
        self._put(change(old, batch).select(*columns), "data", self.key, touched, files)
        new = {**state, "files": files}
        if known is not None:
            values = batch.select(self.unique).distinct()
            now = self._rows(new, "files", touched).select(self.unique, self._bucket(self.key).alias("at")).join(values, self.unique, "left_semi")
            index = dict(state["index"])
            self._put(known.join(values, self.unique, "left_anti").unionByName(now), "index", [self.unique], of_unique, index)
            new["index"] = index
        number = self.versions.commit(new)
        self.versions.drop([incoming])
        return number

    def _put(self, rows: DataFrame, kind: str, columns: list[str], touched: list[int], files: dict[str, str]) -> None:
        """Writes the new content of the touched buckets and notes it in files."""
        folder = self.versions.folder(kind)
        writer = rows.withColumn("_bucket", self._bucket(columns)).repartition("_bucket").sortWithinPartitions("_bucket", *columns).write.partitionBy("_bucket")
        for c in columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{folder}")
        fs, p = self.versions._fs(f"{self.path}/{folder}")
        written = {f.getPath().getName().removeprefix("_bucket=") for f in fs.listStatus(p) if f.isDirectory()}
        for b in map(str, touched):
            files.pop(b, None)
            if b in written:
                files[b] = folder

    def vacuum(self) -> None:
        """Deletes what only former versions have: for when nobody reads those any more."""
        state = self.versions.latest()
        named = {f"{folder}/_bucket={b}" for kind in ("files", "index") for b, folder in state.get(kind, {}).items()}
        folders = {name.rpartition("/")[0] for name in named}
        fs, _ = self.versions._fs(self.path)

        def below(name: str) -> list[str]:
            _, p = self.versions._fs(f"{self.path}/{name}")
            return [f"{name}/{f.getPath().getName()}" for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []

        for kind in ("data", "index", "incoming"):
            for folder in below(kind):
                self.versions.drop([b for b in below(folder) if b not in named] if folder in folders else [folder])
        self.versions.forget()


def _schema(state: dict) -> StructType:
    return StructType.fromJson(json.loads(state["schema"]))
