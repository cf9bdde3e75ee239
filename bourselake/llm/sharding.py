"""Shards by fixed virtual slots: records hash into SLOTS slots, a versioned map says which shard has which slot.

Bytes are aggregated by slot; there are SLOTS rows of that at most, whatever the input, and only these reach the driver. The first
version of the map deals slots out by size, largest first, each to the shard with the fewest bytes. Rebalancing edits the map: it
writes a new version in which few slots have moved, and records only move with their slot. The law is `bytes`: shards get nearly
equal sizes. A third of all rows in one source or one group of copies does no harm: slots come from doc_id and text.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
MAP = "version int, virtual_slot int, shard int, bytes long, rows long, first_slot long"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with size (UTF-8 bytes of text, none for null, and one) and virtual_slot.

    The slot comes from doc_id and a hash of the text, so that rows without an id, or of one id, spread too. Rows equal in both are one
    record, repeated, and share a slot: a doc_id repeated with one text in masses makes one slot that is larger than others.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    return docs.withColumns({"size": size, "virtual_slot": F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(slots)).cast("int")})


def slot_sizes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of all slots in use: a bounded list."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r.virtual_slot, r.bytes, r.rows) for r in found)


def deal(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """slot -> shard: largest slot first, to the shard with the fewest bytes; ties to the smaller numbers."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        have, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (have + size, shard))
    return out


def rebalance(now: dict[int, int], sizes: list[tuple[int, int, int]], shards: int, slack: float = 0.01) -> dict[int, int]:
    """The next version of a map: slots of shards that are gone and new slots are dealt out, then slots move from the fullest shard
    to the emptiest one while that brings the two closer, until the fullest is within slack of the mean. Few slots move."""
    size = {s: b for s, b, _ in sizes}
    out = {s: k for s, k in now.items() if s in size and k < shards}
    load = Counter({k: 0 for k in range(shards)})
    for s, k in out.items():
        load[k] += size[s]
    for s in sorted(size.keys() - out.keys(), key=lambda s: (-size[s], s)):
        out[s] = min(load, key=lambda k: (load[k], k))
        load[out[s]] += size[s]
    mean = sum(size.values()) / shards
    for _ in range(len(size)):
        full, empty = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        gap = load[full] - load[empty]
        fits = [s for s, k in out.items() if k == full and 0 < size[s] < gap]
        if load[full] <= mean * (1 + slack) and load[empty] >= mean * (1 - slack) or not fits:
            break
        move = min(fits, key=lambda s: (abs(gap - 2 * size[s]), s))
        out[move] = empty
        load[full] -= size[move]
        load[empty] += size[move]
    return out


def map_rows(version: int, assigned: dict[int, int], sizes: list[tuple[int, int, int]]) -> list[tuple]:
    """The rows of a map's version. first_slot: the first gapless number in its shard that the records of the virtual slot get."""
    at: Counter[int] = Counter()
    out = []
    for slot, size, rows in sizes:
        shard = assigned[slot]
        out.append((version, slot, shard, size, rows, at[shard]))
        at[shard] += rows
    return out


def store_map(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Appends a version to the stored map."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest if none is named."""
    rows = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(version))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The rows of sized() with shard, slot (gapless from 0 in each shard: by virtual slot, then doc_id, nulls first) and version.

    Numbers come from each virtual slot's own order and the map's first numbers, so no shard has to be sorted as a whole.
    """
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    own = rows.withColumn("_nth", F.row_number().over(order) - 1)
    # the map has at most SLOTS rows
    return own.join(F.broadcast(slot_map.select("virtual_slot", "shard", "first_slot", "version")), "virtual_slot").withColumn("slot", F.col("first_slot") + F.col("_nth")).drop("_nth", "first_slot")


def digests(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """The contract's columns: doc_id, size, text_crc32, law, shard, slot, grown_shard; then virtual_slot and the map's version.

    text_crc32 of a null text is null. Repeated rows each get a place of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    sizes = slot_sizes(rows)
    store_map(spark, path, map_rows(1, deal(sizes, shards), sizes))
    thin = rows.select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "virtual_slot")
    found = assign(thin, load_map(spark, path, 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
