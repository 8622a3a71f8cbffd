"""Projections: application state from a normalized history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_i64, as_str, get, value_of
from ..plans.steps import numbered
from ..schema import HISTORY
from .order import with_depth

Projection = Callable[[DataFrame], DataFrame]
_registry: dict[str, Projection] = {}


def register_projection(name: str, projection: Projection) -> None:
    """Makes a projection known by name; a later one of the same name replaces it."""
    _registry[name] = projection


def project(events: DataFrame, name: str) -> DataFrame:
    return _registry[name](events)


def projections() -> list[str]:
    return sorted(_registry)


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.where((F.col("tag") == "Data") & (F.col("kind") == kind)).withColumn("value", value_of("payload_json"))


def _ordered(events: DataFrame) -> DataFrame:
    """With depth; one that is there already is used. Events without a place in the order go."""
    return (events if "depth" in events.columns else with_depth(events)).where("depth IS NOT NULL")


def _writes(events: DataFrame, kind: str) -> DataFrame:
    """Writes with a key that is a string and a val that is there, null or not: key, val (JSON)."""
    writes = _of(events, kind).withColumn("key", as_str(get(F.col("value"), "key"))).withColumn("_val", get(F.col("value"), "val"))
    return writes.where(F.col("key").isNotNull() & F.col("_val").isNotNull()).withColumn("val", F.to_json("_val")).drop("_val")


def key_value(events: DataFrame) -> DataFrame:
    """The last write of each key in causal order: history_id, key, val (JSON)."""
    return _writes(_ordered(events), "set").groupBy(HISTORY, "key").agg(F.max_by("val", F.struct("depth", "id")).alias("val"))


def log(events: DataFrame) -> DataFrame:
    """The values of log events in causal order: history_id, pos (from 0), value (JSON)."""
    every = numbered(_of(_ordered(events), "log").select(HISTORY, "depth", "id", F.to_json("value").alias("value")), HISTORY, "depth", "id", name="_at")
    first = every.groupBy(HISTORY).agg(F.min("_at").alias("_first"))
    return every.join(first, HISTORY).select(HISTORY, (F.col("_at") - F.col("_first")).alias("pos"), "value")


def log_array(events: DataFrame) -> DataFrame:
    """One row for each history: history_id, entries (array of JSON values in order)."""
    rows = _of(_ordered(events), "log").groupBy(HISTORY).agg(F.array_sort(F.collect_list(F.struct("depth", "id", F.to_json("value").alias("value")))).alias("x"))
    return rows.select(HISTORY, F.transform("x", lambda x: x["value"]).alias("entries"))


def counter(events: DataFrame) -> DataFrame:
    """The sum of the integers of increments, in any order and whether their ancestry is complete or not:
    history_id, total. A sum beyond 64 bits is an error."""
    found = _of(events, "increment").groupBy(HISTORY).agg(F.sum(as_i64(F.col("value"))).alias("total"))
    return events.select(HISTORY).distinct().join(found, HISTORY, "left").select(HISTORY, F.coalesce("total", F.lit(0).cast("long")).alias("total"))


def lww_register(events: DataFrame) -> DataFrame:
    """The write with the greatest ts of each key (ties: the later in causal order): history_id, key, val."""
    writes = _writes(_ordered(events), "write").withColumn("ts", as_i64(get(F.col("value"), "ts"))).where("ts IS NOT NULL")
    return writes.groupBy(HISTORY, "key").agg(F.max_by("val", F.struct("ts", "depth", "id")).alias("val"))


def two_phase_set(events: DataFrame) -> DataFrame:
    """What was added and never removed, in any order: history_id, item (JSON)."""
    added = _of(events, "add").select(HISTORY, F.to_json("value").alias("item")).distinct()
    return added.join(_of(events, "rem").select(HISTORY, F.to_json("value").alias("item")), [HISTORY, "item"], "left_anti")


def fold(events: DataFrame, value: Column, empty, step: Callable, kind: str | None = None) -> DataFrame:
    """A projection by folding values in causal order: ``step(state, value)`` over Columns, from ``empty``."""
    rows = _ordered(events)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    lists = rows.groupBy(HISTORY).agg(F.array_sort(F.collect_list(F.struct("depth", "id", value.alias("v")))).alias("x"))
    return lists.select(HISTORY, F.aggregate("x", empty, lambda s, x: step(s, x["v"])).alias("state"))


def signed_counter(old: DataFrame, delta_events: DataFrame) -> DataFrame:
    """Retraction: ``old(history_id, total)`` after events with ``sign`` 1 or -1 came or went."""
    change = _of(delta_events, "increment").groupBy(HISTORY).agg(F.sum(as_i64(F.col("value")) * F.col("sign")).alias("change"))
    return old.join(change, HISTORY, "full").select(HISTORY, (F.coalesce("total", F.lit(0)) + F.coalesce("change", F.lit(0))).cast("long").alias("total"))


def log_window(events: DataFrame) -> DataFrame:
    """The log of many short histories: positions by a window over each."""
    place = F.row_number().over(Window.partitionBy(HISTORY).orderBy("depth", "id")) - 1
    return _of(_ordered(events), "log").select(HISTORY, place.cast("long").alias("pos"), F.to_json("value").alias("value"))


for _name, _fn in (("key_value", key_value), ("log", log), ("counter", counter), ("lww_register", lww_register), ("two_phase_set", two_phase_set)):
    register_projection(_name, _fn)
