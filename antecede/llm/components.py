"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation and one join on the links; nothing but whether all are stars reaches the driver. Before
a step a task turns the links that it reads into stars, some at a time, which leaves fewer links and fewer rounds. The
links left at the end are stars around the least node of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved

MAX_ROUNDS = 60
#: Links that a task turns into stars at once.
AT_ONCE = 200_000


def _starred(links: DataFrame) -> DataFrame:
    """Links with the same components: of each ``AT_ONCE`` links of a task, those from the nodes they join to the
    least one."""
    kinds = dict(links.dtypes)

    def stars(a: list, b: list) -> pa.RecordBatch:
        up: dict = {}

        def least(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for x, y in zip(a, b, strict=True):
            x, y = least(x), least(y)
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
        found = [(x, least(x)) for x in list(up)]
        ends = [[pair[k] for pair in found if pair[0] != pair[1]] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(ends, arrow, strict=True)], ["a", "b"])

    arrow = [{"binary": pa.binary(), "bigint": pa.int64()}[kinds[x]] for x in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= AT_ONCE:
                yield stars(a, b)
                a, b = [], []
        yield stars(a, b)

    return links.select("a", "b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least among the node and its neighbours. Links may repeat."""
    both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    # the least neighbour stays where it is, so its row is the node's own
    return down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether all links are stars: no node goes to two, and none that others go to goes anywhere."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("goes"), F.lit(0).alias("met")), F.struct(F.col("b").alias("node"), F.lit(0).alias("goes"), F.lit(1).alias("met")))))
    return ends.groupBy("node").agg(F.sum("goes").alias("goes"), F.max("met").alias("met")).where("goes > 0 AND goes + met > 1").isEmpty()


def components(links: DataFrame, name: str = "links") -> Saved:
    """(node, component) for every node of ``links(a, b)``; component is its least node. Links may repeat, point
    either way or at themselves (a node with only such links is a component of its own and is not listed)."""
    now = Saved(_small_star(_starred(links.where("a != b"))), name)
    for _ in range(MAX_ROUNDS):
        if _settled(now.df):
            break
        step = Saved(_large_star(_starred(now.df)), name)
        now.drop()
        now = Saved(_small_star(_starred(step.df)), name)
        step.drop()
    else:
        raise RuntimeError("components did not settle")
    stars = now.df
    now.df = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return now
