"""Snapshots: a Parquet directory for each sequence number, with its metadata as columns of one small table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dag import union
from ..operators.reduce import ReduceConfig, Reduced, reduce
from ..plans.steps import Step
from ..schema import EVENTS, KEY
from .wal import Store


@dataclass
class Snapshot:
    seq: int
    timestamp: int
    source_event_count: int
    events: DataFrame


def write_snapshot(events: DataFrame, path: str, seq: int, source_event_count: int, timestamp: int | None = None) -> Snapshot:
    spark, now = events.sparkSession, int(time.time()) if timestamp is None else timestamp
    events.write.mode("overwrite").parquet(f"{path}/seq={seq}/events")
    spark.createDataFrame([(seq, now, source_event_count)], "seq long, timestamp long, source_event_count long").coalesce(1).write.mode("overwrite").parquet(f"{path}/seq={seq}/meta")
    return read_snapshot(spark, path, seq)


def read_snapshot(spark: SparkSession, path: str, seq: int) -> Snapshot:
    """Ids are taken as they are stored."""
    meta = spark.read.parquet(f"{path}/seq={seq}/meta").first()
    return Snapshot(meta["seq"], meta["timestamp"], meta["source_event_count"], spark.read.schema(EVENTS).parquet(f"{path}/seq={seq}/events"))


def to_json(snapshot: Snapshot) -> DataFrame:
    """One column of JSON lines: the metadata, then the events."""
    spark = snapshot.events.sparkSession
    meta = spark.createDataFrame([(snapshot.seq, snapshot.timestamp, snapshot.source_event_count)], "seq long, timestamp long, source_event_count long")
    return meta.select(F.to_json(F.struct("*")).alias("value")).unionByName(snapshot.events.select(F.to_json(F.struct("*")).alias("value")))


def from_json(lines: DataFrame) -> Snapshot:
    """Back from ``to_json``, in any order of lines."""
    meta = lines.select(F.from_json("value", "seq long, timestamp long, source_event_count long").alias("m")).where("m.seq IS NOT NULL").first()["m"]
    events = lines.select(F.from_json("value", EVENTS).alias("e")).where("e.id IS NOT NULL").select("e.*")
    return Snapshot(meta["seq"], meta["timestamp"], meta["source_event_count"], events)


def wal_tail(snapshot: Snapshot, wal: DataFrame) -> DataFrame:
    """Logged events that the snapshot does not hold. A no-op that was eliminated before it is among them."""
    return wal.join(snapshot.events.select(*KEY), KEY, "left_anti")


def recover(snapshot: Snapshot, store: Store, config: ReduceConfig | None = None) -> tuple[Reduced, int]:
    """The history from a snapshot and the log after it, reduced once, and how many events were replayed."""
    tail = Step(wal_tail(snapshot, store.load_all()), "tail").df
    return reduce(union(snapshot.events, tail), config, before=snapshot.events), tail.count()


def replay(store: Store, config: ReduceConfig | None = None) -> tuple[Reduced, int]:
    """The history from the whole log."""
    events = Step(store.load_all(), "log").df
    return reduce(events, config), events.count()
