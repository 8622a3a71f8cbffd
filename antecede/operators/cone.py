"""Hashes of an event's past: cone(e) = sha256hex(payload_json + sorted cones of the parents)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import Step
from ..schema import HISTORY, KEY
from .dag import edges
from .order import depth, fits_tasks


def _hash(payload, parents):
    return F.sha2(F.concat(payload, F.array_join(F.array_sort(parents), "")), 256)


def cone_hashes(events: DataFrame, distinct_parents: bool = False, known: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """history_id, id, cone_hash of every event with a complete ancestry: in one task for each history where every
    one fits (``grouped``), else one join for each level.

    ``distinct_parents`` counts equal parents once, which makes one pass enough for merging. ``known(history_id,
    id, cone_hash)`` are hashes that hold; only the other events are hashed, on top of them.
    """
    if known is None and (method == "grouped" or method == "auto" and fits_tasks(events, payloads=True)):
        return grouped_cone_hashes(events, distinct_parents)
    levels = Step(events.select(*KEY, "payload_json").join(depth(events, method), KEY), "levels").df
    links = Step(edges(events), "edges").df
    todo = levels if known is None else levels.join(known.select(*KEY), KEY, "left_anti")
    done = known.select(*KEY, "cone_hash") if known is not None else None
    collect = F.collect_set if distinct_parents else F.collect_list
    deepest = todo.agg(F.min("depth"), F.max("depth")).first()
    if deepest[0] is None:
        return done if done is not None else levels.select(*KEY, F.lit("").alias("cone_hash")).limit(0)
    for d in range(deepest[0], deepest[1] + 1):
        here = todo.where(F.col("depth") == d)
        if d == 0 or done is None:
            hashed = here.select(*KEY, F.sha2("payload_json", 256).alias("cone_hash"))
        else:
            pairs = links.join(here.select(HISTORY, F.col("id").alias("child")), [HISTORY, "child"], "left_semi").join(done.withColumnRenamed("id", "parent"), [HISTORY, "parent"])
            lists = pairs.groupBy(HISTORY, F.col("child").alias("id")).agg(collect("cone_hash").alias("h"))
            hashed = here.join(lists, KEY, "left").select(*KEY, _hash(F.col("payload_json"), F.coalesce("h", F.array().cast("array<string>"))).alias("cone_hash"))
        level = Step(hashed, "cones").df
        done = level if done is None else done.unionByName(level)
    return done


def grouped_cone_hashes(events: DataFrame, distinct_parents: bool = False) -> DataFrame:
    """The same for many histories, however deep, each hashed in one task."""

    def run(table: pa.Table) -> pa.Table:
        need, kids, own = {}, {}, {}
        for i, parents, payload in zip(*(table[c].to_pylist() for c in ("id", "parents", "payload_json")), strict=True):
            need[i], own[i] = len(parents), (payload, parents)
            for p in parents:
                kids.setdefault(p, []).append(i)
        queue, cones = [i for i, n in need.items() if n == 0], {}
        for i in queue:
            payload, parents = own[i]
            hashes = [cones[p] for p in parents]
            cones[i] = hashlib.sha256((payload + "".join(sorted(set(hashes) if distinct_parents else hashes))).encode()).hexdigest()
            for k in kids.get(i, ()):
                need[k] -= 1
                if need[k] == 0:
                    queue.append(k)
        return pa.table([pa.array(c, pa.string()) for c in ([table[HISTORY][0].as_py()] * len(cones), list(cones), list(cones.values()))], [HISTORY, "id", "cone_hash"])

    return events.select(*KEY, "parents", "payload_json").groupBy(HISTORY).applyInArrow(run, "history_id string, id string, cone_hash string")


def invalidated(events: DataFrame, cones: DataFrame, changed: DataFrame) -> DataFrame:
    """``cones`` without ``changed(history_id, id)`` and all of their descendants."""
    links = Step(edges(events), "edges").df
    new = Step(changed.select(*KEY).distinct(), "dirty")
    dirty = new.df
    while not new.df.isEmpty():
        step = links.join(new.df.withColumnRenamed("id", "parent"), [HISTORY, "parent"]).select(HISTORY, F.col("child").alias("id")).distinct()
        new = Step(step.join(dirty, KEY, "left_anti"), "dirty")
        dirty = dirty.unionByName(new.df)
    return cones.join(dirty, KEY, "left_anti")


def refreshed(events: DataFrame, cones: DataFrame, changed: DataFrame) -> DataFrame:
    """Cone hashes after ``changed`` events: only they and their descendants are hashed again."""
    clean = Step(invalidated(events, cones, changed), "clean").df
    return cone_hashes(events, known=clean)


def isomorphic_groups(cones: DataFrame) -> DataFrame:
    """Events with one hash, two or more: history_id, cone_hash, n, first_id, ids (sorted)."""
    lists = cones.groupBy(HISTORY, "cone_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.where("n > 1")
