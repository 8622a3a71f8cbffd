"""Reduction of a history to its normal form.

Order of the rewrites in a round: no-op elimination, merging of events with equal pasts, contraction of relay chains.
Merging runs only where ids are not content hashes, or no-ops are left; contraction only with a predicate for relays.
Rounds go on until one changes nothing, or has only eliminated no-ops, of which none is left then.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import compute_id, is_noop
from ..plans.steps import Step
from ..schema import HISTORY, KEY
from .cone import cone_hashes
from .dag import compact_tombstones, edges, missing_ancestors


@dataclass(frozen=True)
class ReduceConfig:
    max_iterations: int = 1000
    enable_cone_merge: bool = True
    assume_content_addressed: bool = True
    enable_chain_contract: bool = True
    enable_noop_elim: bool = True
    enable_closure_check: bool = False
    #: which events only pass on (a Column over the event's columns); none by default
    passthrough: Column | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Stats:
    iterations: int = 0
    cones_merged: int = 0
    chains_contracted: int = 0
    noops_eliminated: int = 0
    events_before: int = 0
    events_after: int = 0

    def added(self, other: Stats) -> Stats:
        """Running totals over several reductions, as a kernel keeps them: counts of rewrites add up, the number
        of events is the last one, iterations and events before stay."""
        return Stats(
            self.iterations, self.cones_merged + other.cones_merged, self.chains_contracted + other.chains_contracted,
            self.noops_eliminated + other.noops_eliminated, self.events_before, other.events_after,
        )


@dataclass
class Reduced:
    events: DataFrame
    stats: Stats
    #: op (inserted, removed, reidentified), history_id, id, new_id
    delta: DataFrame
    #: history_id, id, cone_hash, only where all rewrites are off
    cones: DataFrame | None = None

    def is_empty(self) -> bool:
        return self.delta.isEmpty()

    def has_reductions(self) -> bool:
        return not self.delta.where("op != 'inserted'").isEmpty()


def eliminate_noops(events: DataFrame) -> DataFrame:
    """Every no-op goes; what it joined is joined directly."""
    return compact_tombstones(events, events.where(is_noop()).select(*KEY))


def eliminate_noops_in_chains(chain: DataFrame, *sequence: str) -> DataFrame:
    """The same for chains in a known sequence, in one window: the parent is the last event before that stays."""
    before = Window.partitionBy(HISTORY).orderBy(*sequence).rowsBetween(Window.unboundedPreceding, -1)
    root = F.first(F.get("parents", F.lit(0))).over(Window.partitionBy(HISTORY).orderBy(*sequence).rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(~is_noop(), F.col("id")), ignorenulls=True).over(before)
    parent = F.coalesce(last, root)
    return chain.withColumn("parents", F.when(parent.isNull(), F.array().cast("array<string>")).otherwise(F.array(parent))).where(~is_noop())


def merge_cones(events: DataFrame, at_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of events with equal pasts the least id stays. Gives the events and (history_id, id, kept).

    One round: what has the same parents only after it is left to the next. ``at_once`` counts equal parents once in
    the hashes, which is where repeated rounds end.
    """
    cones = Step(cone_hashes(events, distinct_parents=at_once), "cones").df
    kept = F.min("id").over(Window.partitionBy(HISTORY, "cone_hash"))
    merged = Step(cones.select(*KEY, kept.alias("kept")).where("id != kept"), "merged").df
    left = events.join(merged.select(*KEY), KEY, "left_anti")
    links = edges(left).join(merged.select(HISTORY, F.col("id").alias("parent"), "kept"), [HISTORY, "parent"], "left")
    touched = links.where("kept IS NOT NULL").select(HISTORY, "child").distinct()
    lists = links.join(touched, [HISTORY, "child"], "left_semi").groupBy(HISTORY, F.col("child").alias("id")).agg(F.array_sort(F.collect_set(F.coalesce("kept", "parent"))).alias("_new"))
    return left.join(lists, KEY, "left").withColumn("parents", F.coalesce("_new", "parents")).select(*events.columns), merged


def contract_chains(events: DataFrame, passthrough: Column) -> tuple[DataFrame, DataFrame]:
    """Events with one parent and one child that only pass on are taken out. Gives the events and those ids."""
    counts = edges(events).groupBy(HISTORY, F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    relays = events.where(passthrough & (F.size("parents") == 1)).join(counts.where("n = 1"), KEY, "left_semi").select(*KEY)
    relays = Step(relays, "relays").df
    return compact_tombstones(events, relays), relays


def delta(before: DataFrame, after: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """Net difference of id sets: op, history_id, id, new_id."""
    none = F.lit(None).cast("string").alias("new_id")
    came = after.select(*KEY).join(before.select(*KEY), KEY, "left_anti").select(F.lit("inserted").alias("op"), *KEY, none)
    went = before.select(*KEY).join(after.select(*KEY), KEY, "left_anti").select(F.lit("removed").alias("op"), *KEY, none)
    out = came.unionByName(went)
    return out if renamed is None else out.unionByName(renamed.select(F.lit("reidentified").alias("op"), *KEY, "new_id"))


def _renamed(old: DataFrame, now: DataFrame) -> DataFrame:
    """(history_id, id, new_id) of events whose parents a rewrite changed, and with them the hash."""
    changed = now.alias("n").join(old.alias("o"), KEY).where("n.parents != o.parents")
    return changed.select(*KEY, compute_id(F.col("n.payload_json"), F.col("n.parents")).alias("new_id")).where("id != new_id")


def reduce(events: DataFrame, config: ReduceConfig | None = None, before: DataFrame | None = None) -> Reduced:
    """The normal form, in at most ``max_iterations`` rounds. ``before``: the history before the events were added,
    for inserted ids; else as given."""
    config = config or ReduceConfig()
    if config.enable_closure_check and not missing_ancestors(events).isEmpty():
        warnings.warn("the history is not causally closed", stacklevel=2)
    counts = events.agg(F.count("*"), F.count(F.when(is_noop(), 1))).first()
    size, left_noops = counts
    now, iterations, noops, merged, contracted, renamed = events, 0, 0, 0, 0, None
    while iterations < config.max_iterations:
        iterations += 1
        gone = cones = relayed = 0
        if config.enable_noop_elim and left_noops:
            now, gone, left_noops = Step(eliminate_noops(now), "reduced").df, left_noops, 0
        if config.enable_cone_merge and (not config.assume_content_addressed or left_noops):
            out, twins = merge_cones(now)
            cones = twins.count()
            if cones:
                old, now = now, Step(out, "reduced").df
                here = _renamed(old, now)
                renamed = here if renamed is None else renamed.unionByName(here)
                left_noops = now.where(is_noop()).count() if left_noops else 0
        if config.enable_chain_contract and config.passthrough is not None:
            out, relays = contract_chains(now, config.passthrough)
            relayed = relays.count()
            if relayed:
                now = Step(out, "reduced").df
                left_noops = now.where(is_noop()).count() if left_noops else 0
        noops, merged, contracted = noops + gone, merged + cones, contracted + relayed
        # a round that only took out the no-ops has left nothing that a further one could change
        if not (gone or cones or relayed) or (not cones and not relayed and not left_noops):
            break
    idle = not (config.enable_cone_merge or config.enable_chain_contract or config.enable_noop_elim)
    after = size - noops - merged - contracted
    found = delta(before if before is not None else events, now, renamed)
    return Reduced(now, Stats(iterations, merged, contracted, noops, size, after), found, cone_hashes(now) if idle else None)


def stats_frame(spark, stats: Stats) -> DataFrame:
    return spark.createDataFrame([tuple(vars(stats).values())], ", ".join(f"{k} long" for k in vars(stats)))
