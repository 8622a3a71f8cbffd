"""Operator 6 (DataFrame functions only). Sharding through fixed virtual slots.

A record hashes to one of ``SLOTS`` virtual slots, for good: by its identifier, size and checksum, so rows that share
an identifier or have none are spread. Records that are alike in all three are dealt to slots by their place in the
table, so that many copies of one are spread too. A small map says which shard holds each slot.
The first map is made from the bytes in each slot (largest first, to the emptiest shard); later ones edit the
map before, moving as few slots as bring the shards back within a tolerance, and each is stored as a new version.
The law it keeps is ``bytes``: sizes near equal. Only the loads of the slots, at most ``SLOTS`` rows, reach the
driver, whatever the number of records.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, save, unsigned_crc32

SLOTS = 4096
SHARDS = 24


#: Parts of a slot in which rows are numbered.
PARTS = 16


def slot_loads(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(rows, bytes) of every slot, from ``records(virtual_slot, size)``."""
    loads = [(0, 0)] * slots
    for slot, rows, size in records.groupBy("virtual_slot").agg(F.count("*"), F.sum("size")).collect():
        loads[slot] = (rows, size)
    return loads


def first_map(loads: list[tuple[int, int]], shards: int) -> list[int]:
    """Slots by falling bytes, each to the shard with the fewest bytes (ties: fewest slots, lowest number)."""
    heap, found = [(0, 0, s) for s in range(shards)], [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i][1], i)):
        size, count, shard = heapq.heappop(heap)
        found[slot] = shard
        heapq.heappush(heap, (size + loads[slot][1], count + 1, shard))
    return found


def rebalanced(slot_map: list[int], loads: list[tuple[int, int]], shards: int, tolerance: float = 0.02) -> list[int]:
    """The next map: slots move from the fullest to the emptiest shard until all are within ``tolerance`` of the
    mean, or no move helps. Slots of shards that are no more are dealt out first. Other slots stay."""
    found, sizes = list(slot_map), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(found):
        if shard < shards:
            sizes[shard] += loads[slot][1]
            held[shard].append(slot)
    for slot in sorted((i for i, s in enumerate(found) if s >= shards), key=lambda i: -loads[i][1]):
        to = min(range(shards), key=lambda s: (sizes[s], s))
        found[slot] = to
        sizes[to] += loads[slot][1]
        held[to].append(slot)
    mean = sum(sizes) / shards
    while True:
        high, low = max(range(shards), key=lambda s: (sizes[s], -s)), min(range(shards), key=lambda s: (sizes[s], s))
        gap = sizes[high] - sizes[low]
        if sizes[high] <= mean * (1 + tolerance) and sizes[low] >= mean * (1 - tolerance):
            return found
        # the slot nearest to half the gap; anything smaller than the gap makes both shards nearer
        fitting = [s for s in held[high] if 0 < loads[s][1] < gap]
        if not fitting:
            return found
        slot = min(fitting, key=lambda s: (abs(2 * loads[s][1] - gap), s))
        held[high].remove(slot)
        held[low].append(slot)
        found[slot] = low
        sizes[high] -= loads[slot][1]
        sizes[low] += loads[slot][1]


def write_map(spark: SparkSession, path: str, slot_map: list[int], version: int) -> None:
    """Appends one version of the map: version, virtual_slot, shard."""
    rows = spark.range(len(slot_map)).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("virtual_slot"), _lookup(slot_map, F.col("id").cast("int")).alias("shard"))
    rows.coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """A version of the map, the newest unless one is named."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return version, [r[0] for r in table.where(F.col("version") == version).orderBy("virtual_slot").select("shard").collect()]


def _lookup(values: list[int], slot: Column) -> Column:
    """The value of a slot, from a constant array that travels with the plan."""
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), slot).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32, place (a number for each row)."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), unsigned_crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds virtual_slot and part to ``records(doc_id, size, text_crc32, place)``, which must be a written table."""
    same = ["size", "text_crc32"]
    copied = records.groupBy("doc_id", *same).count().where("count > 1").select(F.col("doc_id").alias("_doc_id"), *(F.col(c).alias(f"_{c}") for c in same))
    alike = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_text_crc32"))
    own = F.when(F.col("_size").isNotNull(), F.col("place"))
    slot = F.pmod(F.xxhash64("doc_id", *same, own), F.lit(slots)).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "place"), F.lit(PARTS)).cast("int")
    return records.join(copied, alike, "left").select("doc_id", *same, "place", slot.alias("virtual_slot"), part.alias("part"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Deals all rows of ``docs(doc_id, text)`` out to shards and numbers them inside each shard from 0.

    ``map_path``: where versions of the map are stored; if one is there already, it is edited, else the first is
    made. A null text has 8 bytes and the crc32 of no bytes; repeated rows all get places of their own; other
    columns are not carried. No rows: an empty result and an empty map.
    """
    spark = docs.sparkSession
    records = save(slotted(save(sized(docs), "sized"), slots), "slotted")
    loads = slot_loads(records, slots)
    if map_path is None:
        map_path, version, slot_map = new_path(spark, "slot-map"), 1, first_map(loads, shards)
    else:
        try:
            version, before = read_map(spark, map_path)
            version, slot_map = version + 1, rebalanced(before, loads, shards)
        except Exception as e:  # no map yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            version, slot_map = 1, first_map(loads, shards)
    write_map(spark, map_path, slot_map, version)
    filled, begins = [0] * shards, []
    for slot, (rows, _) in enumerate(loads):  # slots follow each other inside a shard
        begins.append(filled[slot_map[slot]])
        filled[slot_map[slot]] += rows
    # rows of a slot are numbered in parts: those of the parts before, then those before it in its own part
    filled_parts = records.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))  # at most SLOTS * PARTS rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "place")) - 1
    numbered = records.withColumn("own", own).join(filled_parts.select("virtual_slot", "part", before.alias("before")), ["virtual_slot", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _lookup(slot_map, F.col("virtual_slot")).cast("int").alias("shard"),
        (_lookup(begins, F.col("virtual_slot")) + F.col("before") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir, "doc_id", "text"))
