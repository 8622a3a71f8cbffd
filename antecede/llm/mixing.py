"""Operator 2 (DataFrame functions only). Mixing sources to target weights by entropy balancing.

Each source has a target in words. The rates of its documents are those nearest to 1 in relative entropy that
meet the target and stay at most ``MAX_COPIES``: ``rate = min(MAX_COPIES, exp(lambda * size / mean size))``. The
dual of that problem is convex with one unknown for each source, and Newton iterations (kept inside a bracket)
solve it; each iteration is one distributed sum. A rate depends on source and size alone, so the sums run over
cells (source, size, documents), which hold every document. The expected copies of the cells are rounded by
running totals in order of size, a few exchanges of single copies take up what rounding left over, and each
cell's copies go to its documents in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC, NTH, ROW, Saved, documents, with_nth

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: The relative distance to the targets at which Newton's iterations end, and the iterations after which it is an
#: error that they have not; halving the bracket alone takes about 60.
TOLERANCE = 1e-6
MAX_ITERATIONS = 200
#: Rounds of exchanges after rounding.
EXCHANGES = 5
#: Parts into which the documents of one cell are dealt, so that a frequent size is no single task.
CELL_PARTS = 1024


def sized(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids, key (of the source: ``n`` for null, else ``s`` and its name, in an order with null last), size, part."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*ids, key.alias("key"), size.alias("size"), F.pmod(F.xxhash64(F.lit("part"), *ids), F.lit(CELL_PARTS)).cast("int").alias("part"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Adds weight and target to ``sources(key, source_size)``, one row for each source.

    A target is ``min(most * source_size, level * weight)`` with the level at which all targets sum to all sizes:
    what a stopped source cannot take goes to the others by weight, until none is above.
    """
    place = F.row_number().over(Window.orderBy("key")) - 1
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int")))
    cap = F.col("source_size") * most
    ordered = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    up_to = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("ratio", "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if exactly the sources before this one are stopped
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0))) / F.sum("weight").over(from_here)
    levels = ordered.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"]
    return levels.withColumn("level", first).select("key", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _rate(size: Column, tilt: Column, mean: Column, most: int) -> Column:
    return F.exp(F.least(tilt * size / mean, F.lit(math.log(most))))


def balance(cells: DataFrame, sources: DataFrame, most: int = MAX_COPIES) -> Saved:
    """The tilt of each source: key, source_size, target, mean, tilt, low, high, missed (of the tilt before).

    ``cells(key, size, n)``, ``sources(key, source_size, target, n, least)`` with the smallest size above 0.
    """
    limit = math.log(most)
    # at the upper end even the shortest document has the greatest rate
    state = sources.select(
        "key", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"),
        (limit * F.col("source_size") / F.col("n") / F.col("least")).alias("high"),
        (F.abs(F.col("source_size") - F.col("target")) / F.greatest("target", F.lit(1.0))).alias("missed"),
    )
    state = state.withColumn("tilt", F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-9), F.col("high")).otherwise(F.col("tilt")))
    now = Saved(state.where("source_size > 0"), "tilts")
    x = F.col("size") / F.col("mean")
    rate = _rate(F.col("size"), F.col("tilt"), F.col("mean"), most)
    words = F.col("n") * F.col("size") * rate
    for _ in range(MAX_ITERATIONS):
        sums = cells.where("size > 0").join(now.df, "key").groupBy("key").agg(F.sum(words).alias("words"), F.sum(F.when(F.col("tilt") * x < limit, words * x).otherwise(0.0)).alias("slope"))
        moved = now.df.join(sums, "key")
        missed = F.col("words") - F.col("target")
        low, high = F.when(missed < 0, F.col("tilt")).otherwise(F.col("low")), F.when(missed > 0, F.col("tilt")).otherwise(F.col("high"))
        done = F.abs(missed) <= TOLERANCE * F.col("target")
        newton = F.col("tilt") - missed / F.when(F.col("slope") > 0, F.col("slope"))
        # outside the bracket, the middle; while the lower end is still open, a longer step down
        middle = F.when(low <= -1e6, F.least(F.lit(-1.0), 2 * F.col("tilt"))).otherwise((low + high) / 2)
        inside = F.coalesce((newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) < 8), F.lit(False))
        new = moved.select(
            "key", "source_size", "target", "mean", F.when(done, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
            low.alias("low"), high.alias("high"), (F.abs(missed) / F.greatest("target", F.lit(1.0))).alias("missed"),
        )
        before, now = now, Saved(new, "tilts")
        before.drop()
        if (now.df.agg(F.max("missed")).first()[0] or 0.0) <= TOLERANCE:
            return now
    raise RuntimeError("the weights of the sources did not converge")


def rounded(cells: DataFrame, tilts: DataFrame, most: int = MAX_COPIES) -> Saved:
    """Whole copies of each cell: key, size, n, copies."""
    expected = F.col("n") * _rate(F.col("size"), F.col("tilt"), F.col("mean"), most)
    total = F.sum("expected").over(Window.partitionBy("key").orderBy(F.desc("size")))
    whole = cells.where("size > 0").join(tilts, "key").withColumn("expected", expected).withColumn("total", F.floor(total + 0.5))
    before = F.lag("total", 1, 0).over(Window.partitionBy("key").orderBy(F.desc("size")))
    copies = F.least(F.greatest(F.col("total") - before, F.lit(0)), most * F.col("n"))
    now = Saved(whole.select("key", "size", "n", "target", copies.cast("long").alias("copies")), "copies")
    for _ in range(EXCHANGES):
        left = now.df.groupBy("key").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("left"))
        room = F.when(F.col("left") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = F.least(room, F.floor(F.abs("left") / F.col("size")))
        gained = fits * F.col("size")
        step = now.df.join(left, "key").where(fits > 0).groupBy("key").agg(F.max(F.struct(gained.alias("gained"), F.col("size").alias("size"), (F.signum("left") * fits).cast("long").alias("more"))).alias("x")).select("key", "x.size", "x.more")
        before_, now = now, Saved(now.df.join(step, ["key", "size"], "left").select("key", "size", "n", "target", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies")), "copies")
        before_.drop()
    return now


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Copies of every row of ``docs(doc_id, text, source)``; ``ids`` are the columns that name a row.

    Result: doc_id, size, source_size, target, taken, copies. A null source is a source of its own, after the
    others. A null text or one without words has size 0 and no copies. Repeated rows count and are taken as rows
    of their own; equal rows share a cell and may get different copies. No rows: no rows. Other columns are not
    carried.
    """
    base = Saved(sized(docs, ids), "sized").df
    parts = Saved(base.groupBy("key", "size", "part").agg(F.count("*").alias("in_part")), "parts").df
    cells = Saved(parts.groupBy("key", "size").agg(F.sum("in_part").alias("n")), "cells").df
    sources = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sources = Saved(sources, "sources").df
    aimed = Saved(targets(sources.select("key", "source_size"), weights, most).join(sources.select("key", "n", "least"), "key"), "targets").df
    tilts = balance(cells, aimed, most)
    given = rounded(cells, tilts.df.select("key", "mean", "tilt", "target"), most).df
    # rank of a document in its cell: those in the parts before, then those before it in its own part
    in_cell = F.coalesce(F.sum("in_part").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part = (
        parts.withColumn("first", in_cell)
        .join(given.select("key", "size", "n", "copies"), ["key", "size"], "left")
        .join(aimed.select("key", "source_size", "target"), "key")
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64(F.lit("rank"), *ids), *ids)) - 1
    ranked = base.withColumn("rank", rank).join(per_part, ["key", "size", "part"])
    each = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("first") + F.col("rank") < F.col("copies") % F.col("n"), 1).otherwise(0)
    copies = F.coalesce(each, F.lit(0)).cast("long")
    return ranked.select(*ids, "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    named = with_nth(docs)
    counts = mix(named.select(DOC, NTH, f"{ROW}.text", f"{ROW}.source"), weights, most, (DOC, NTH)).where("copies > 0").select(DOC, NTH, "copies")
    repeated = named.join(counts, [DOC, NTH]).select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(f"{ROW}.*")


def op2_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "text", "source"))
