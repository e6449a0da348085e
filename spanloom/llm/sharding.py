"""Sharding over fixed virtual slots.

Every row hashes into one of a fixed number of virtual slots; bytes and rows are
summed per slot, and a slot-to-shard map, stored with a version, says where each
slot lives. A rebalance edits the map, never the hash: slots move from shards
that hold too much to those that hold too little, largest useful slot first.
Shard sizes are balanced by bytes. A row's place in its shard is its slot's
offset there plus its place in the slot, so numbering needs no shard-wide sort.

Defined results: a null text has size 1 and counts as empty; null ids hash as
null; very long texts are hashed and measured whole; repeated rows get places of their own, in one slot; an empty table gives no
rows and a map of empty slots; other columns are ignored. Only the map (one row a slot, a parameter) ever
reaches the driver.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import read
from spanloom.session import shared_dir

SLOTS, SHARDS = 4096, 16


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by virtual slot: at most one entry a slot."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {r.vslot: (r.bytes, r.rows) for r in found.collect()}


def initial_map(sizes: dict[int, tuple[int, int]], shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first to the shard with the fewest bytes so far; empty slots by turns."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(sizes, key=lambda k: (-sizes[k][0], k)):
        load, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + sizes[slot][0], shard))
    return {slot: placed.get(slot, slot % shards) for slot in range(slots)}


def rebalanced(current: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edited map for ``shards`` shards: moves slots out of overfull shards until all are near the mean."""
    edited = {slot: shard for slot, shard in current.items() if shard < shards}
    load = dict.fromkeys(range(shards), 0)
    weight = {slot: sizes.get(slot, (0, 0))[0] for slot in current}
    for slot, shard in edited.items():
        load[shard] += weight[slot]
    for slot in sorted(current.keys() - edited.keys(), key=lambda k: (-weight[k], k)):
        to = min(load, key=lambda s: (load[s], s))
        edited[slot] = to
        load[to] += weight[slot]
    mean = sum(load.values()) / shards
    held = {s: sorted((k for k in edited if edited[k] == s), key=lambda k: (-weight[k], k)) for s in range(shards)}
    while True:
        full, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        room = min(load[full] - mean, mean - load[low])
        moved = next((k for k in held[full] if 0 < weight[k] <= max(room, (load[full] - load[low]) / 2)), None)
        if load[full] <= mean * (1 + tolerance) or moved is None:
            return edited
        held[full].remove(moved)
        held[low].append(moved)
        held[low].sort(key=lambda k: (-weight[k], k))
        edited[moved] = low
        load[full] -= weight[moved]
        load[low] += weight[moved]


def stored_map(spark: SparkSession, slot_map: dict[int, int], sizes: dict[int, tuple[int, int]], version: int, folder: str) -> DataFrame:
    """Writes one version of the map under ``folder`` and reads it back.

    Columns: version, vslot, shard, bytes, rows and start, the rows of the shard in earlier slots.
    """
    rows, seen = [], {}
    for slot in sorted(slot_map):
        size, n = sizes.get(slot, (0, 0))
        shard = slot_map[slot]
        rows.append((version, slot, shard, size, n, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    path = f"{folder}/version={version}"
    frame = spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long, rows long, start long")
    frame.drop("version").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("version", F.lit(version))


def read_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """A stored version of the map."""
    return {r.vslot: r.shard for r in spark.read.parquet(f"{folder}/version={version}").select("vslot", "shard").collect()}


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None, version: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot (the row's place in its shard, from 0).

    Version 0 of the map is none: a first one is made. Of any later ``version`` in ``folder`` the map is read
    and edited for the rows and the number of shards at hand. Either way the next version is written, and rows are placed by it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), text, slots).alias("vslot"),
    )
    sizes = slot_sizes(rows)
    folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    placed = rebalanced(read_map(spark, folder, version), sizes, shards) if version else initial_map(sizes, shards, slots)
    slot_map = stored_map(spark, placed, sizes, version + 1, folder)
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    # One row a slot: the broadcast is bounded by the number of slots.
    return numbered.join(F.broadcast(slot_map.select("vslot", "shard", "start")), "vslot").select(
        "doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
