"""Causal depth and topological order. Depth is the longest path from a root; events whose ancestry is incomplete
and those on a cycle have none, so they are in no order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.steps import Step, numbered
from ..schema import HISTORY, KEY
from .dag import edges


def chain_depth(events: DataFrame, *sequence: str) -> DataFrame:
    """Depth where every history is a chain in a known sequence: one window, no rounds."""
    return events.withColumn("depth", F.row_number().over(Window.partitionBy(HISTORY).orderBy(*sequence)).cast("long") - 1)


def forest_depth(events: DataFrame) -> DataFrame:
    """history_id, id, depth where no event has two parents, by pointer doubling: log(depth) rounds."""
    links = events.select(*KEY, F.get("parents", F.lit(0)).alias("anc"))
    known = events.select(HISTORY, F.col("id").alias("anc"), F.lit(True).alias("there"))
    start = links.join(known, [HISTORY, "anc"], "left").select(
        *KEY, F.when(F.col("there"), F.col("anc")).alias("anc"), F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("dist"), (F.col("anc").isNull() | F.col("there").isNotNull()).alias("ok")
    )
    now = Step(start, "pointers")
    left = now.df.where("anc IS NOT NULL").count()
    for _ in range(64):
        if not left:
            break
        a, b = now.df.alias("a"), now.df.alias("b")
        jumped = a.join(b, F.expr("a.history_id = b.history_id AND a.anc = b.id"), "left").select(
            "a.history_id", "a.id", F.col("b.anc").alias("anc"), (F.col("a.dist") + F.coalesce("b.dist", F.lit(0))).alias("dist"), (F.col("a.ok") & F.coalesce("b.ok", F.lit(True))).alias("ok")
        )
        before, now = now, Step(jumped, "pointers")
        before.drop()
        last, left = left, now.df.where("anc IS NOT NULL").count()
        if left == last and _ > 40:  # only cycles are left
            break
    return now.df.where("anc IS NULL AND ok").select(*KEY, F.col("dist").alias("depth"))


def level_depth(events: DataFrame) -> DataFrame:
    """history_id, id, depth of any DAG, level by level: an event is placed in the round after its last parent.
    Each round touches only the links out of the level before."""
    links = Step(edges(events), "edges").df
    need = Step(events.select(*KEY, F.size("parents").cast("long").alias("need")), "need").df
    level = need.where("need = 0").select(*KEY, F.lit(0).cast("long").alias("depth"))
    found, waiting, depth = level, None, 0
    while not level.isEmpty():
        depth += 1
        freed = links.join(level.select(HISTORY, F.col("id").alias("parent")), [HISTORY, "parent"]).groupBy(HISTORY, F.col("child").alias("id")).agg(F.count("*").alias("have"))
        if waiting is None:
            more = freed.join(need, KEY).select(*KEY, "need", "have")
        else:
            more = freed.unionByName(waiting.select(*KEY, "have")).groupBy(*KEY).agg(F.sum("have").alias("have")).join(need, KEY).select(*KEY, "need", "have")
        state = Step(more, "open").df
        level = state.where("have = need").select(*KEY, F.lit(depth).cast("long").alias("depth"))
        waiting = state.where("have < need")
        found = found.unionByName(level)
    return found


def grouped_depth(events: DataFrame) -> DataFrame:
    """history_id, id, depth for many small histories: each is ordered in one task, in one pass over the data."""

    def place(table: pa.Table) -> pa.Table:
        need, kids = {}, {}
        for i, parents in zip(table["id"].to_pylist(), table["parents"].to_pylist(), strict=True):
            need[i] = len(parents)
            for p in parents:
                kids.setdefault(p, []).append(i)
        level, depth, ids, depths = [i for i, n in need.items() if n == 0], 0, [], []
        while level:
            ids += level
            depths += [depth] * len(level)
            after = []
            for i in level:
                for k in kids.get(i, ()):
                    need[k] -= 1
                    if need[k] == 0:
                        after.append(k)
            level, depth = after, depth + 1
        return pa.table([pa.array([table[HISTORY][0].as_py()] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(depths, pa.int64())], [HISTORY, "id", "depth"])

    return events.select(*KEY, "parents").groupBy(HISTORY).applyInArrow(place, "history_id string, id string, depth long")


#: The most events, and bytes of payloads and parents, of a history that one task takes as a whole.
TASK_EVENTS = 1 << 20
TASK_BYTES = 256 << 20


def fits_tasks(events: DataFrame, payloads: bool = False) -> bool:
    """Whether every history is within those bounds."""
    own = F.length("id") + F.coalesce(F.aggregate("parents", F.lit(0), lambda n, x: n + F.length(x)), F.lit(0))
    own = own + F.coalesce(F.length("payload_json"), F.lit(0)) if payloads else own
    sizes = events.groupBy(HISTORY).agg(F.count("*").alias("n"), F.sum(own).alias("bytes"))
    n, size = sizes.agg(F.max("n"), F.max("bytes")).first()
    return (n or 0) <= TASK_EVENTS and (size or 0) <= TASK_BYTES


def depth(events: DataFrame, method: str = "auto") -> DataFrame:
    """history_id, id, depth. ``method``: grouped, forest, levels, or auto: grouped where every history fits a task,
    whatever its depth; else forest where no event has two parents, and levels."""
    if method == "auto":
        method = "grouped" if fits_tasks(events) else "levels" if not events.where(F.size("parents") > 1).isEmpty() else "forest"
    return {"forest": forest_depth, "levels": level_depth, "grouped": grouped_depth}[method](events)


def with_depth(events: DataFrame, method: str = "auto") -> DataFrame:
    """``events`` with depth, null where there is none."""
    return events.join(depth(events, method), KEY, "left")


def topological_order(events: DataFrame, method: str = "auto") -> DataFrame:
    """history_id, id, depth, pos: parents first, ids in order at each depth, numbered from 0 in each history."""
    every = numbered(depth(events, method), HISTORY, "depth", "id", name="_at")
    first = every.groupBy(HISTORY).agg(F.min("_at").alias("_first"))
    return every.join(first, HISTORY).select(*KEY, "depth", (F.col("_at") - F.col("_first")).alias("pos"))
