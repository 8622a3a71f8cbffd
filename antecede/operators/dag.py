"""Set and graph operators of causal histories. A history is a DataFrame in the schema of ``schema.EVENTS``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import Step
from ..schema import COLUMNS, HISTORY, KEY


def edges(events: DataFrame) -> DataFrame:
    """history_id, child, parent; parents need not exist."""
    return events.select(HISTORY, F.col("id").alias("child"), F.explode("parents").alias("parent"))


def insert(events: DataFrame, new: DataFrame) -> DataFrame:
    """The first row of an id wins: those there already, then any of the new ones with that id."""
    once = new.select(*COLUMNS).dropDuplicates(KEY)
    return events.select(*COLUMNS).unionByName(once.join(events.select(*KEY), KEY, "left_anti"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union by id; the left side wins."""
    return insert(a, b)


def children(events: DataFrame) -> DataFrame:
    """history_id, parent, n_children, children (sorted). Parents that are missing are listed too."""
    return edges(events).groupBy(HISTORY, "parent").agg(F.countDistinct("child").alias("n_children"), F.array_sort(F.collect_set("child")).alias("children"))


def frontier(events: DataFrame) -> DataFrame:
    """Events that are no one's parent: history_id, id."""
    return events.select(*KEY).join(edges(events).select(HISTORY, F.col("parent").alias("id")), KEY, "left_anti")


def missing_ancestors(events: DataFrame) -> DataFrame:
    """Parents that are not there: history_id, id."""
    return edges(events).select(HISTORY, F.col("parent").alias("id")).distinct().join(events.select(*KEY), KEY, "left_anti")


def closure_check(events: DataFrame) -> DataFrame:
    """history_id, n_missing, is_closed for every history."""
    missing = missing_ancestors(events).groupBy(HISTORY).agg(F.count("*").alias("n"))
    counts = events.select(HISTORY).distinct().join(missing, HISTORY, "left").select(HISTORY, F.coalesce("n", F.lit(0)).alias("n_missing"))
    return counts.withColumn("is_closed", F.col("n_missing") == 0)


def is_causally_closed(events: DataFrame) -> bool:
    return missing_ancestors(events).isEmpty()


def ancestors(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Every strict ancestor of each of ``ids(history_id, id)``, missing ones included: history_id, id, ancestor.

    Semi-naive: each round follows only pairs found in the round before. Only for stated ids: of all ids, a chain
    of n events has n squared pairs.
    """
    links = Step(edges(events), "edges")
    asked = ids.select(*KEY).distinct()
    step = asked.join(links.df, (asked[HISTORY] == links.df[HISTORY]) & (asked["id"] == links.df["child"])).select(asked[HISTORY], asked["id"], F.col("parent").alias("ancestor"))
    new = Step(step.distinct(), "ancestors")
    found = new.df
    while not new.df.isEmpty():
        n = new.df.alias("n")
        step = n.join(links.df.alias("e"), F.expr("n.history_id = e.history_id AND n.ancestor = e.child")).select("n.history_id", "n.id", F.col("e.parent").alias("ancestor"))
        new = Step(step.distinct().join(found, [HISTORY, "id", "ancestor"], "left_anti"), "ancestors")
        found = found.unionByName(new.df)
    return found


def causally_precedes(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(history_id, a, b)`` with precedes: whether a is a strict ancestor of b."""
    closure = ancestors(events, pairs.select(HISTORY, F.col("b").alias("id")))
    known = closure.select(HISTORY, F.col("ancestor").alias("a"), F.col("id").alias("b"), F.lit(True).alias("_p"))
    return pairs.join(known, [HISTORY, "a", "b"], "left").withColumn("precedes", F.coalesce("_p", F.lit(False))).drop("_p")


def are_concurrent(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(history_id, a, b)`` with concurrent: neither precedes and they differ (two unknown ids do, too)."""
    both = pairs.select(HISTORY, F.explode(F.array("a", "b")).alias("id")).distinct()
    closure = ancestors(events, both)
    forward = closure.select(HISTORY, F.col("ancestor").alias("a"), F.col("id").alias("b"), F.lit(True).alias("_f"))
    back = closure.select(HISTORY, F.col("id").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("_b"))
    joined = pairs.join(forward, [HISTORY, "a", "b"], "left").join(back, [HISTORY, "a", "b"], "left")
    return joined.withColumn("concurrent", F.col("_f").isNull() & F.col("_b").isNull() & (F.col("a") != F.col("b"))).drop("_f", "_b")


def compact_tombstones(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drops ``tombstones(history_id, id)``; parents that go are replaced by the nearest ancestors that stay.

    Ids are kept; ids that are no events are ignored; a dropped root leaves no parent. The parents of tombstones
    are resolved by doubling: a round replaces every tombstone among them by what it has come to itself, so a run
    of n takes log n rounds.
    """
    gone = Step(events.select(*KEY, "parents").join(tombstones.select(*KEY).distinct(), KEY, "left_semi"), "tombstones")
    dead = gone.df.select(*KEY)
    links = gone.df.select(HISTORY, F.col("id").alias("t"), F.explode("parents").alias("p"))
    marked = _marked(links, dead)
    now = Step(marked.distinct(), "resolved")
    while not now.df.where("dead").isEmpty():
        a, b = now.df.where("dead").alias("a"), now.df.alias("b")
        jumped = a.join(b, F.expr("a.history_id = b.history_id AND a.p = b.t AND a.t <> b.p")).select("a.history_id", "a.t", "b.p", "b.dead")
        before, now = now, Step(now.df.where("NOT dead").unionByName(jumped).distinct(), "resolved")
        before.drop()
    kept = events.join(dead, KEY, "left_anti")
    own = _marked(edges(kept).select(HISTORY, F.col("child").alias("t"), F.col("parent").alias("p")), dead)
    touched = own.where("dead").select(HISTORY, F.col("t").alias("id")).distinct()
    direct = own.where("NOT dead").select(HISTORY, "t", "p").alias("o")
    o, r = own.where("dead").alias("o"), now.df.alias("r")
    through = o.join(r, F.expr("o.history_id = r.history_id AND o.p = r.t")).select("o.history_id", "o.t", "r.p")
    new = direct.unionByName(through).join(touched.withColumnRenamed("id", "t"), [HISTORY, "t"], "left_semi")
    lists = new.groupBy(HISTORY, F.col("t").alias("id")).agg(F.array_sort(F.collect_set("p")).alias("_new"))
    joined = kept.join(touched.withColumn("_touched", F.lit(True)), KEY, "left").join(lists, KEY, "left")
    parents = F.when(F.col("_touched").isNull(), F.col("parents")).otherwise(F.coalesce("_new", F.array().cast("array<string>")))
    return joined.withColumn("parents", parents).select(*events.columns)


def _marked(links: DataFrame, dead: DataFrame) -> DataFrame:
    """(history_id, t, p) with dead: whether p is a tombstone."""
    flags = dead.select(HISTORY, F.col("id").alias("p"), F.lit(True).alias("_d"))
    return links.join(flags, [HISTORY, "p"], "left").select(HISTORY, "t", "p", F.coalesce("_d", F.lit(False)).alias("dead"))


def remove(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Removes events; their children inherit their parents."""
    return compact_tombstones(events, ids)
