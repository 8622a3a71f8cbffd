"""Operator 9. N-gram Jaccard join by chosen paths.

Texts with equal sets of five-word shingles are one class member from the start. Each distinct set gets a MinHash
sketch, whose coordinates are its sampled tokens. A run starts with all sets in one bucket. A bucket of more than
``SMALL`` sets is split: two coordinates, chosen by the bucket's path, and the values there name the buckets of
the next level; a set goes to both. A small bucket is searched by brute force on the sketches. In a large one each
set is compared with the bucket's centre first, and linked to it if they have half in common. A bucket of linked sets
alone is done; of others those go on that are not linked or may be similar to one that is not. So a large group of near
copies does not multiply from level to level. What is still large at the last level is compared in blocks. Two similar sets fail to meet in a run with a known chance, and runs are repeated until the chance that
they meet in one reaches the target recall.

Sets that met and whose sketches may be as similar as asked make candidate components. Inside those every pair whose
sizes allow it is compared exactly, block by block on the full sets, so a pair that no bucket had is still found
there, and no pair is written out: a block gives each set's number of links and only those links that join its sets
to trees. Blocks hold sets of like size, and only those of neighbouring sizes meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as S
from .common import DOC, NTH, ROW, Saved, documents, slices, with_nth
from .components import components

SIMILARITY = 0.8
TARGET_RECALL = 0.999
#: Sketch coordinates; coordinates chosen at each bucket; least levels (tables of ten times the sets get one more);
#: sets in a bucket that is searched directly.
COORDINATES = 128
CHOSEN = 2
LEVELS = 2
SMALL = 128
#: Agreement with the centre of a large bucket at which a set is linked to it. A set similar to one that is not linked
#: agrees with the centre by at most (1 - similarity) more than that one, and by ``NOISE``, five standard deviations
#: of a sketch; one that agrees by more has no business in the bucket.
LINKED = 0.5
NOISE = 0.2
#: Sets in a block of the exact comparison, and bytes; sketches in a block of a large last bucket.
BLOCK = 400
BLOCK_BYTES = 4 << 20
SKETCH_BLOCK = 512
_SEED = 20240229


def levels_for(sets: int) -> int:
    """Levels of buckets: two for 100,000 sets, and one more for ten times as many."""
    return max(LEVELS, round(math.log10(max(1, sets))) - 3)


def runs_for(similarity: float, target: float, levels: int = LEVELS, chosen: int = CHOSEN) -> int:
    """Runs after which two sets of that similarity have met with the chance ``target``, at the deepest level."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - (1 - similarity * meet) ** chosen
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - meet)))


def least_agreement(similarity: float, coordinates: int = COORDINATES) -> float:
    """Sketches that agree less belong to less similar sets, but for four standard deviations."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / coordinates)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are alike in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        begin = 0
        for i in range(len(names)):
            if names[i] != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, begin = [], names[i], i
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _child_paths(paths: np.ndarray, sketches: np.ndarray, chosen: int) -> np.ndarray:
    """The next paths of sets that stand at ``paths``: one column for each chosen coordinate."""
    out = np.empty((len(paths), chosen), np.uint64)
    width = sketches.shape[1]
    pick = S.mixed(paths + np.uint64(0x632BE59BD9B4E019))
    for k in range(chosen):
        # steps of width / chosen keep the coordinates of one bucket distinct
        at = ((pick + np.uint64(k * (width // chosen))) % np.uint64(width)).astype(np.int64)
        value = sketches[np.arange(len(paths)), at].astype(np.uint64)
        out[:, k] = S.mixed(S.mixed(pick + np.uint64(k)) ^ (value * np.uint64(0xD6E8FEB86659FD93) + paths))
    return out


def sketched(texts: DataFrame, words: int = S.WORDS) -> DataFrame:
    """_doc, _nth, node (128 bits of the shingle set; null without words), size of the set, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = S.seeds(COORDINATES, _SEED)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            nodes, sizes, sketches = [], [], []
            for text in batch.column(2):
                own = S.shingles(text.as_py(), words)
                nodes.append(S.set_key(own) if len(own) else None)
                sizes.append(len(own))
                sketches.append(S.sketch(own, seeds).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], [DOC, NTH, "node", "size", "sketch"])

    return texts.mapInArrow(run, f"{DOC} long, {NTH} int, node binary, size long, sketch binary")


def _split(rows: DataFrame, level: int, runs: int) -> DataFrame:
    """(path, node) of the next level, from (path, node, sketch), or from (node, sketch) at the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = _matrix(pa.chunked_array([batch.column(batch.num_columns - 1)]), "<u4")
            nodes = batch.column(batch.num_columns - 2)
            starts = [S.mixed(np.full(batch.num_rows, r + 1, np.uint64)) for r in range(runs)] if level == 0 else [batch.column(0).to_numpy().astype(np.int64).view(np.uint64)]
            for paths in starts:
                for column in _child_paths(paths, sketches, CHOSEN).T:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(column).view(np.int64)), nodes], ["path", "node"])

    return rows.mapInArrow(run, "path long, node binary")


def _glued(leaves: DataFrame, least: float, keys: int = 1) -> DataFrame:
    """Links inside buckets, or pairs of blocks of one: pairs whose sketches agree enough, as trees, from rows sorted
    by their ``keys`` columns, then node and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in groups(batches, keys):
            nodes, sketches = table.column(keys).to_pylist(), _matrix(table.column(keys + 1), "<u4")
            near = np.empty((len(nodes), len(nodes)), bool)
            for i in range(len(nodes)):
                near[i] = (sketches[i] == sketches).mean(axis=1) >= least
            for i, j in _trees(near):
                a.append(nodes[i])
                b.append(nodes[j])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return leaves.mapInArrow(run, "a binary, b binary")


def _centred(rows: DataFrame) -> DataFrame:
    """From (path, node, sketch, centre, middle): the same with ``agreed``, the share of the sketch of ``middle`` that
    is the same, instead of ``middle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, middle = (_matrix(pa.chunked_array([batch.column(k)]), "<u4") for k in (2, 4))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((own == middle).mean(axis=1))], ["path", "node", "sketch", "centre", "agreed"])

    return rows.mapInArrow(run, "path long, node binary, sketch binary, centre binary, agreed double")


def block_pairs(rows: DataFrame, group: str, blocks: DataFrame, *carried: str) -> DataFrame:
    """Rows of ``rows(group, class, node, ...)`` dealt into blocks, once for each pair of blocks that they are in:
    group, i, j, node, block, and the carried columns. ``blocks(group, class, blocks)`` has the number of blocks of
    each class; a class meets itself and the next ones on both sides."""
    near = blocks.select(group, F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("with"), F.col("blocks").alias("others"))
    met = blocks.join(near, [group, "class"])
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    own, other = F.col("class") * F.lit(1 << 32) + part, F.col("with") * F.lit(1 << 32) + F.col("other")
    dealt = rows.join(met, [group, "class"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    return dealt.select(group, F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "node", own.alias("block"), *carried)


def _trees(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, breadth first."""
    left = np.ones(len(near), bool)
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        for i in queue:
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            for j in found.tolist():
                yield i, j
                queue.append(j)


def candidate_components(sets: DataFrame, similarity: float, target: float) -> Saved:
    """(node, component) of the sets that may have a similar one, from ``sets(node, sketch)``."""
    levels = levels_for(sets.count())
    runs, least = runs_for(similarity, target, levels), least_agreement(similarity)
    made: list[Saved] = []
    links: list[DataFrame] = []
    rows = _split(sets.select("node", "sketch"), 0, runs)
    for level in range(1, levels + 1):
        now = Saved(rows, "paths")
        sizes = now.df.groupBy("path").agg(F.count("*").alias("sets"), F.min("node").alias("centre")).where("sets > 1")
        shared = Saved(now.df.join(sizes, "path"), "shared")
        now.drop()
        made.append(shared)
        small = shared.df.where(F.col("sets") <= SMALL).select("path", "node").join(sets, "node").select("path", "node", "sketch")
        found = Saved(_glued(small.repartition("path").sortWithinPartitions("path"), least), "met")
        made.append(found)
        links.append(found.df)
        large = shared.df.where(F.col("sets") > SMALL)
        if large.isEmpty():
            break
        # sketches of the centres come by their paths, of which there are at most one for SMALL rows; the rows of a
        # path are narrow then, and get their own sketches by node, which no large bucket makes uneven
        centres = large.select("path", "centre").distinct().join(sets.select(F.col("node").alias("centre"), F.col("sketch").alias("middle")), "centre")
        rows = large.select("path", "node").join(centres, "path").join(sets, "node").select("path", "node", "sketch", "centre", "middle")
        judged = Saved(_centred(rows), "centred")
        made.append(judged)
        linked = F.col("agreed") >= LINKED
        links.append(judged.df.where(linked).select(F.col("node").alias("a"), F.col("centre").alias("b")))
        apart = judged.df.where(~linked).groupBy("path").agg(F.max("agreed").alias("most"))
        left = judged.df.join(apart, "path").where(~linked | (F.col("agreed") <= F.col("most") + (1 - similarity + NOISE))).select("path", "node", "sketch")
        if level < levels:
            rows = _split(left, level, runs)
            continue
        left = left.withColumn("class", F.lit(0).cast("long"))
        blocks = left.groupBy("path", "class").agg(F.ceil(F.count("*") / SKETCH_BLOCK).alias("blocks"))
        last = Saved(_glued(block_pairs(left, "path", blocks, "sketch").select("path", "i", "j", "node", "sketch").repartition("path", "i", "j").sortWithinPartitions("path", "i", "j"), least, 3), "met")
        made.append(last)
        links.append(last.df)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    out = components(every, "candidates")
    for x in made:
        x.drop()
    return out


def _exact(blocks: DataFrame, similarity: float) -> DataFrame:
    """Compares the sets of each block pair, from rows sorted by (component, i, j): component, i, j, node, block,
    copies, shingles. Gives (a, links, b): the links of set a found here (b null), or a link a-b of a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            nodes = table.column(3).to_pylist()
            block = np.array(table.column(4).to_pylist())
            copies = np.array(table.column(5).to_pylist(), np.int64)
            near = similar(table.column(6).to_pylist(), similarity)
            if i != j:
                near &= block[:, None] != block[None, :]
            links = near @ copies
            edges = list(_trees(near))
            full = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([nodes[k] for k in full] + [nodes[a] for a, _ in edges], pa.binary()),
                    pa.array([*links[full].tolist(), *[0] * len(edges)], pa.int64()),
                    pa.array([None] * len(full) + [nodes[b] for _, b in edges], pa.binary()),
                ],
                ["a", "links", "b"],
            )

    return blocks.mapInArrow(run, "a binary, links long, b binary")


def similar(sets: list[bytes], similarity: float) -> np.ndarray:
    """Which pairs of sorted 64-bit sets have that Jaccard similarity or more; never one with itself."""
    sizes = np.array([len(x) // 8 for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True, return_counts=True)
    number = number.ravel()
    shared = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    number, owner = shared[number[keep]], owner[keep]
    common = np.zeros((len(sets), len(sets)), np.float64)
    width = 1 << 12
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], number[lo:hi] - at] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - common
    # as whole numbers where the similarity is one of thousandths, so that the limit itself counts
    near = common * 1000 >= int(round(similarity * 1000)) * either
    np.fill_diagonal(near, False)
    return near


def similar_classes(named: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL, words: int = S.WORDS) -> DataFrame:
    """Links of the rows of ``named`` (as ``with_nth`` names them; row has a text) whose shingle sets have that
    Jaccard similarity or more: _doc, _nth, first (is_null, doc, nth: the row of its connected component with the
    least doc_id, null last), n_links, n_copies."""
    texts = named.select(DOC, NTH, F.col(f"{ROW}.text").cast("string").alias("text"))
    base = Saved(sketched(texts, words), "sketched")
    own = F.struct((F.col(DOC) == -(1 << 63)).alias("is_null"), F.col(DOC).alias("doc"), F.col(NTH).alias("nth"))
    sets = Saved(
        base.df.where("node is not null")
        .groupBy("node")
        .agg(F.first("sketch").alias("sketch"), F.min(own).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size")),
        "sets",
    )
    candidates = candidate_components(sets.df.select("node", "sketch"), similarity, target)
    # a set is similar only to sets of its own or a neighbouring class of sizes
    step = -math.log(similarity) * (1 + 1e-9) if similarity < 1 else None
    size_class = F.floor(F.log(F.col("size").cast("double")) / step).cast("long") if step else F.col("size")
    members = Saved(candidates.df.join(sets.df.select("node", "rep", "copies", "size"), "node").withColumn("class", size_class), "members")

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets_ = [S.shingles(x.as_py(), words).astype("<u8").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets_, pa.binary())], ["node", "shingles"])

    wanted = members.df.select(F.col("rep.doc").alias(DOC), F.col("rep.nth").alias(NTH), "node")
    # merged at every size: a plan that held for small tables alone would tell nothing about large ones
    full = Saved(texts.join(wanted.hint("merge"), [DOC, NTH]).select("node", "text").mapInArrow(reshingle, "node binary, shingles binary"), "shingles")
    blocks = members.df.groupBy("component", "class").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") * 8 / BLOCK_BYTES)).alias("blocks"))
    paired = block_pairs(members.df, "component", blocks, "copies")
    rows = paired.join(full.df, "node").select("component", "i", "j", "node", "block", "copies", "shingles")
    found = Saved(_exact(rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"), similarity), "exact")
    full.drop()
    candidates.drop()
    links = found.df.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.df.where("b is not null").select("a", "b"), "classes")
    least = classes.df.join(sets.df.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    known = sets.df.select("node", "rep", "copies").join(classes.df.join(least, "component").select("node", "first"), "node", "left").join(links, "node", "left")
    known = known.select("node", F.coalesce("first", "rep").alias("first"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    joined = base.df.where("node is not null").select(DOC, NTH, "node").join(known, "node")
    linked = joined.select(DOC, NTH, "first", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"))
    alone = base.df.where("node is null").select(DOC, NTH, own.alias("first"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return linked.unionByName(alone)


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL, words: int = S.WORDS) -> DataFrame:
    """Links of ``docs(doc_id, text)`` whose shingle sets have that Jaccard similarity or more.

    Result, one row for each row of ``docs``: doc_id, class_id (the least doc_id of its connected component; null
    if none has one), n_links (other rows linked to it, copies included), n_copies (rows with an equal set, itself
    included). A text without words has an empty set and no links: a class of its own, n_copies 1. Fewer than
    five words: all of them are one shingle. Repeated rows are copies of each other; rows that share or lack a
    doc_id are told apart. Other columns are not carried; no rows give no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = similar_classes(with_nth(docs.select("doc_id", "text")), similarity, target, words)
    doc_id = F.when(F.col(DOC) != -(1 << 63), F.col(DOC)).cast(kind)
    return found.select(doc_id.alias("doc_id"), F.when(~F.col("first.is_null"), F.col("first.doc")).cast(kind).alias("class_id"), "n_links", "n_copies")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL, words: int = S.WORDS) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each connected component the row with the least doc_id (null
    last) stays, with all its columns. Rows without words are nobody's copies and stay; so does every row that is
    unlike the others, whatever its doc_id. No rows give no rows."""
    named = with_nth(docs)
    found = similar_classes(named, similarity, target, words)
    kept = found.where((F.col("first.doc") == F.col(DOC)) & (F.col("first.nth") == F.col(NTH))).select(DOC, NTH)
    return named.join(kept, [DOC, NTH], "left_semi").select(f"{ROW}.*")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir, "doc_id", "text"))
