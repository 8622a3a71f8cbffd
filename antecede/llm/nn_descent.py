"""Operator 4. Approximate nearest neighbours with NN-descent.

Equal vectors are one node. The graph starts from buckets of random hyperplanes; then, in each round, every node
brings together its neighbours and those it is a neighbour of, and they try each other: a Spark join of neighbours
of neighbours, in which only pairs with a new link are compared and only improvements are written. A search is
greedy: from the query's own node and the best of a fixed number of pivots, it follows the links of the nearest
nodes not yet followed, for all queries at once, one Spark join for each step, until the beam of a query has none left.

Graph and search use vectors of 8 bits a component with a scale for each; the nodes in the final beam are measured
on the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chosen_path import groups
from .common import Saved

NEAREST = 10
#: Links of a node; most rounds; share of links that still change when it ends; most proposals to a node from one place.
LINKS = 40
ROUNDS = 8
SETTLED = 0.01
PROPOSALS = 8
#: Sets of hyperplanes for the first graph; nodes in a bucket, about.
PLANES = 3
BUCKET = 48
#: Nodes a search starts from (bounds what is broadcast), nodes it keeps, links it follows in one step.
PIVOTS = 1024
BEAM = 160
STEP = 16
_SEED = 7


def encoded(vectors: np.ndarray) -> list[bytes]:
    scale = (np.abs(vectors).max(axis=1) / 127).astype(np.float32)
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes, strict=True)]


def decoded(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number for each), vec_id, v (array<double>): the rows that take part. Not those with a null id or
    vector, a null or non-finite component, or all zeros."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = typed.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    return good.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: x + 0.0).alias("v"))  # one zero, not two


def nodes_of(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, v), node being the least row with that vector, and members (node, row, vec_id): the ``keep``
    least ids of each, which are all that can be among the nearest. Frequent vectors are cut down in parts first."""
    part = F.pmod(F.xxhash64("row"), F.lit(64))
    some = rows.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("v", "part").orderBy("vec_id", "row"))).where(F.col("k") <= keep)
    least = some.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))).where(F.col("k") <= keep)
    named = Saved(least.withColumn("node", F.min("row").over(Window.partitionBy("v"))).select("node", "row", "vec_id", "v"), "nodes")
    return named.df.where("row = node").select("node", "v"), named.df.select("node", "row", "vec_id")


def _coded(nodes: DataFrame, planes: int, bits: int, width: int) -> DataFrame:
    """node, code and one bucket number for each set of hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(_SEED)
        normals = rng.standard_normal((planes, bits, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
            sides = np.einsum("nd,pbd->npb", vectors, normals) > 0
            numbers = sides @ (1 << np.arange(bits)) if bits else np.zeros((batch.num_rows, planes), np.int64)
            buckets = pa.FixedSizeListArray.from_arrays(pa.array(numbers.astype(np.int64).ravel()), planes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded(vectors), pa.binary()), buckets], ["node", "code", "buckets"])

    return nodes.mapInArrow(run, "node long, code binary, buckets array<bigint>")


def _tried(rows: DataFrame, proposals: int) -> DataFrame:
    """Nodes that came together at one place try each other: from rows (place, node, new, limit, code) sorted by
    place to (node, nbr, dist), the best pairs under the limit of ``node`` with at least one new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for table in groups(batches, 1):
            if table.num_rows < 2:
                continue
            nodes = table.column(1).to_numpy()
            new = table.column(2).to_numpy()
            squares = _squares(own := decoded(table.column(4).to_pylist()), own)
            squares[~(new[:, None] | new[None, :])] = np.inf
            squares[squares >= table.column(3).to_numpy()[:, None]] = np.inf
            np.fill_diagonal(squares, np.inf)
            if len(nodes) > proposals:
                best = np.argpartition(squares, proposals - 1, axis=1)[:, :proposals]
            else:
                best = np.tile(np.arange(len(nodes)), (len(nodes), 1))
            dist = np.take_along_axis(squares, best, axis=1)
            i, k = np.nonzero(np.isfinite(dist))
            out.append((nodes[i], nodes[best[i, k]], dist[i, k]))
            held += len(i)
            if held >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["node", "nbr", "dist"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["node", "nbr", "dist"])

    return rows.mapInArrow(run, "node long, nbr long, dist float")


def _nearest(pairs: DataFrame, links: int) -> DataFrame:
    """The ``links`` nearest of each node, from (node, nbr, dist, new) in which a pair may repeat."""
    once = pairs.groupBy("node", "nbr").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("dist", "nbr"))).where(F.col("k") <= links).drop("k")


def neighbour_graph(coded: DataFrame, count: int, links: int = LINKS, rounds: int = ROUNDS) -> Saved:
    """(node, nbr, dist, new) with the nearest ``links`` found for each node of ``coded(node, code, buckets)``."""
    codes = coded.select("node", "code")
    bucketed = coded.select("node", "code", F.posexplode("buckets").alias("plane", "bucket"))
    sizes = bucketed.groupBy("plane", "bucket").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    placed = bucketed.join(sizes, ["plane", "bucket"]).select(
        F.xxhash64("plane", "bucket", F.pmod(F.xxhash64("plane", "node"), F.col("parts"))).alias("place"), "node", F.lit(True).alias("new"), F.lit(float("inf")).cast("float").alias("limit"), "code"
    )
    first = _tried(placed.repartition("place").sortWithinPartitions("place"), links)
    graph = Saved(_nearest(first.withColumn("new", F.lit(1)), links), "graph")
    for _ in range(rounds):
        limits = graph.df.groupBy("node").agg(F.when(F.count("*") >= links, F.max("dist")).otherwise(float("inf")).cast("float").alias("limit"))
        known = codes.join(limits, "node", "left").select("node", "code", F.coalesce("limit", F.lit(float("inf")).cast("float")).alias("limit"))
        back = graph.df.withColumn("k", F.row_number().over(Window.partitionBy("nbr").orderBy("dist", "node"))).where(F.col("k") <= links)
        met = graph.df.select(F.col("node").alias("place"), F.col("nbr").alias("node"), "new").unionByName(back.select(F.col("nbr").alias("place"), "node", "new"))
        met = met.unionByName(codes.select(F.col("node").alias("place"), "node", F.lit(0).alias("new"))).groupBy("place", "node").agg(F.max("new").alias("new"))
        rows = met.join(known, "node").select("place", "node", (F.col("new") == 1).alias("new"), "limit", "code")
        tried = _tried(rows.repartition("place").sortWithinPartitions("place"), PROPOSALS).withColumn("new", F.lit(1))
        before, graph = graph, Saved(_nearest(before_marked(graph.df).unionByName(tried), links), "graph")
        before.drop()
        if (graph.df.agg(F.sum("new")).first()[0] or 0) <= SETTLED * links * count:
            break
    return graph


def before_marked(graph: DataFrame) -> DataFrame:
    """The links of a graph as old ones."""
    return graph.select("node", "nbr", "dist", F.lit(0).alias("new"))


def _beam_update(queries_and_found: DataFrame, beam: int, step: int) -> DataFrame:
    """One step of all searches. Rows sorted by (query_id, kind): a query's state (kind 0: its code, and ids,
    dists, done of the beam), then what it reached (kind 1: nbrs, codes). Gives the new states with ``ask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for table in groups(batches, 1):
            own = decoded([table.column(2)[0].as_py()])
            ids = np.array(table.column(3)[0].as_py(), np.int64)
            dists = np.array(table.column(4)[0].as_py(), np.float32)
            done = np.array(table.column(5)[0].as_py(), bool)
            reached = [x for x in table.column(6).to_pylist() if x]
            if reached:
                new = np.concatenate([np.array(x, np.int64) for x in reached])
                codes = [c for x in table.column(7).to_pylist() if x for c in x]
                new, at = np.unique(new, return_index=True)
                fresh = ~np.isin(new, ids)
                new, at = new[fresh], at[fresh]
                if len(new):
                    far = _squares(own, decoded([codes[k] for k in at]))[0]
                    ids, dists, done = np.r_[ids, new], np.r_[dists, far], np.r_[done, np.zeros(len(new), bool)]
                    order = np.lexsort((ids, dists))[:beam]
                    ids, dists, done = ids[order], dists[order], done[order]
            ask = np.flatnonzero(~done)[:step]
            done[ask] = True
            rows.append((table.column(0)[0].as_py(), table.column(2)[0].as_py(), ids.tolist(), dists.tolist(), done.tolist(), ids[ask].tolist()))
            if len(rows) >= 1000:
                yield _states(rows)
                rows = []
        yield _states(rows)

    return queries_and_found.mapInArrow(run, "query_id long, code binary, ids array<bigint>, dists array<float>, done array<boolean>, ask array<bigint>")


def _states(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "code", "ids", "dists", "done", "ask"])


def greedy_search(queries: DataFrame, graph: DataFrame, codes: DataFrame, beam: int = BEAM, step: int = STEP, links: int = LINKS) -> Saved:
    """(query_id, node): the beam in which the search of each of ``queries(query_id, node, code)`` ends. The own node
    is where a search starts, so its links are followed first, wherever the pivots lie."""
    spark = queries.sparkSession
    back = graph.withColumn("k", F.row_number().over(Window.partitionBy("nbr").orderBy("dist", "node"))).where(F.col("k") <= links)
    both = graph.select("node", "nbr").unionByName(back.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
    lists = both.join(codes.select(F.col("node").alias("nbr"), "code"), "nbr").groupBy("node").agg(F.collect_list("nbr").alias("nbrs"), F.collect_list("code").alias("codes"))
    near = Saved(lists, "adjacency")
    # a fixed number of pivots, the same share of every part of the table
    chosen = codes.orderBy(F.xxhash64(F.lit("pivot"), "node")).limit(PIVOTS).collect()
    pivot_ids, pivot_codes = [r["node"] for r in chosen], [bytes(r["code"]) for r in chosen]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, ids = decoded(pivot_codes), np.array(pivot_ids, np.int64)
        for batch in batches:
            rows = []
            for query, node, code in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                far = _squares(decoded([code]), pivots)[0]
                order = np.lexsort((ids, far))
                order = order[ids[order] != node][: beam - 1]
                starts, dists = np.r_[node, ids[order]], np.r_[np.float32(0), far[order]]
                done = np.zeros(len(starts), bool)
                done[:step] = True
                rows.append((query, code, starts.tolist(), dists.tolist(), done.tolist(), starts[:step].tolist()))
            yield _states(rows)

    state = Saved(queries.select("query_id", "node", "code").mapInArrow(begin, "query_id long, code binary, ids array<bigint>, dists array<float>, done array<boolean>, ask array<bigint>"), "search")
    nothing = [F.lit(None).cast("array<bigint>").alias("nbrs"), F.lit(None).cast("array<binary>").alias("codes")]
    while not (asked := state.df.where(F.size("ask") > 0)).isEmpty():
        found = asked.select("query_id", F.explode("ask").alias("node")).join(near.df, "node")
        rows = state.df.select("query_id", F.lit(0).alias("kind"), "code", "ids", "dists", "done", *nothing).unionByName(
            found.select("query_id", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("code"), *(F.lit(None).cast(t).alias(n) for n, t in (("ids", "array<bigint>"), ("dists", "array<float>"), ("done", "array<boolean>"))), "nbrs", "codes")
        )
        before, state = state, Saved(_beam_update(rows.repartition("query_id").sortWithinPartitions("query_id", "kind"), beam, step), "search")
        before.drop()
    out = Saved(state.df.select("query_id", F.explode("ids").alias("node")), "beams")
    state.drop()
    near.drop()
    return out


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, links: int = LINKS, beam: int = BEAM) -> DataFrame:
    """The nearest rows of ``vectors(vec_id, embedding)`` to those of its rows that ``is_query`` names.

    Result: query_id, rank (from 1), vec_id, score (Euclidean distance, double). Ties go to the smaller vec_id;
    fewer candidates than ``nearest`` are all returned. Null, zero and non-finite vectors take no part, neither do
    rows without an id. Rows that share a vec_id are rows of their own, as queries and as candidates; equal vectors
    are all candidates. A distance needs vectors of one length, so each length is searched apart. Other columns are
    not carried; no rows give no rows.
    """
    rows = Saved(usable(vectors), "vectors")
    widths = sorted(r[0] for r in rows.df.select(F.size("v")).distinct().collect())
    found = [_nearest_of_width(rows.df.where(F.size("v") == w), w, is_query, nearest, links, beam) for w in widths]
    if not found:
        return rows.df.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _nearest_of_width(rows: DataFrame, width: int, is_query: Column, nearest: int, links: int, beam: int) -> DataFrame:
    nodes, members = nodes_of(rows, nearest + 1)
    nodes = Saved(nodes, "distinct")
    count = nodes.df.count()
    bits = max(0, round(math.log2(max(1, count) / BUCKET)))
    coded = Saved(_coded(nodes.df, PLANES, bits, width), "codes")
    graph = neighbour_graph(coded.df, count, links)
    asked = Saved(rows.where(is_query).select("row", F.col("vec_id").alias("query_id"), "v").join(nodes.df, "v").select("row", "query_id", "node"), "queries")
    # equal queries are searched once
    wanted = asked.df.select("node").distinct()
    queries = wanted.join(coded.df.select("node", "code"), "node").select(F.col("node").alias("query_id"), "node", "code")
    beams = greedy_search(queries, graph.df, coded.df.select("node", "code"), max(beam, nearest + 1), links=links)
    graph.drop()
    coded.drop()
    near = nodes.df.select("node", "v")
    measured = (
        beams.df.withColumnRenamed("query_id", "own")
        .join(near, "node")
        .join(wanted.withColumnRenamed("node", "own").join(near.select(F.col("node").alias("own"), F.col("v").alias("q")), "own"), "own")
        .select("own", "node", F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).alias("score"))
    )
    order = ["score", "vec_id", "row"]
    # one more than asked for, as a query's own row is among them
    best = measured.join(members, "node").withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy(*order))).where(F.col("k") <= nearest + 1)
    pairs = asked.df.select(F.col("row").alias("query_row"), "query_id", F.col("node").alias("own")).join(best, "own").where("row != query_row")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= nearest)


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
