"""Operator 10. Removal of repeated byte strings by distributed prefix doubling.

A string of ``threshold`` bytes that starts earlier too (in an earlier document, or earlier in its own) is removed
wherever it starts again. Ranks of longer strings come from sorting pairs (rank of a shorter one, rank of the bytes
at the growing offset); what is unique drops out, until the threshold is reached.

A row for each byte in every round would be too many, so positions that cannot repeat are left out first, and runs
that repeat as a whole are decided as a whole:

1. *Anchors.* Of the ``ANCHOR``-byte strings inside a window of ``threshold`` bytes, the one with the least hash
   (ties: leftmost) is the window's anchor. Equal windows have equal anchors at equal places. Consecutive windows
   with one anchor make a segment, about thirty of them.
2. *Segments.* Spark sorts the segments by anchor and content. An anchor found once: no window of the segment
   repeats. A segment whose bytes were found earlier: all of its windows repeat. Only the first segments of each
   content, where an anchor has several contents, stay open. Anchors that a sample shows to be frequent are sorted
   by anchor and content together and their first contents always stay open, so a phrase that every document has
   is not one task.
3. *Doubling.* The rank of an open segment's anchor is the first of its ranks. Each round halves what its strings
   lack to the threshold and doubles how many there are: a string grows by half of that at its end or at its start,
   Spark sorts the pairs (rank, rank of the bytes at that offset), pairs found once drop out, and the pair's name is
   the rank for the next round. A window holds exactly one string of each round whole, so it drops out with it.
   The last round sorts the windows that are left, by all their bytes, and the first of each in order stays.

What is decided is decided by names of 128 bits (segments, windows). Names of 64 bits (anchors, pairs) only choose
what is compared: equal names of different strings would cost work, never bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOC, NTH, ROW, Saved, documents, slices, with_nth
from .shingles import _powers_to, mixed

THRESHOLD = 100
ANCHOR = 36
#: Rounds before the windows themselves are sorted; the last one has 2 ** ROUNDS strings for each segment.
ROUNDS = 3
#: Documents (about) in the sample that shows frequent anchors, contents there that make one frequent, and the most
#: that are treated so. They only choose where rows are sorted, not what is found.
SAMPLE_DOCUMENTS = 2_000
FREQUENT = 10
MOST_FREQUENT = 4_096
#: Windows of a text looked at together; places fit in the low bits of a key.
_PART = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_INT = np.int64
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Rows of an Arrow batch that one document may add.
_ROWS = 20_000


class Fingerprints:
    """Polynomial fingerprints of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers_to(len(data) + 1)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def segments(data: np.ndarray, threshold: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """First window, number of windows, offset of the anchor from there and name of the anchor of each segment."""
    width = threshold - anchor + 1
    for at in range(0, len(data) - threshold + 1, _PART):
        part = data[at : at + _PART + threshold - 1]
        starts = np.arange(len(part) - anchor + 1)
        hashes = Fingerprints(part).of(starts, starts + anchor)
        least, span = (hashes & ~_PLACE) | starts.astype(np.uint64), 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & _PLACE).astype(_INT)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        yield first + at, np.diff(np.r_[first, len(place)]), place[first] - first, hashes[place[first]]


def _names(pieces: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of byte strings, as two columns of longs."""
    import xxhash

    name = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([name(x) for x in pieces]), "<i8").reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _dealt(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that spread rows evenly; where a row that is decided already goes does not matter."""
    return mixed((doc * 1_000_003 + at).astype(np.uint64)).view(_INT)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _bytes_of(text: pa.StringScalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.empty(0, np.uint8)


#: a: name of the anchor. c1, c2: name of the content. shape: windows << 16 | offset of the anchor << 2 | frequent
#: anchor << 1 | sure to repeat. at: _nth << 32 | first window.
_SEGMENT = "a long, c1 long, c2 long, shape int, _doc long, at long"


def _segment_rows(docs: DataFrame, threshold: int, anchor: int, frequent: np.ndarray) -> DataFrame:
    """All segments. Of those with one content in a batch only the first needs sorting; the others are sure to
    repeat, which keeps frequent passages from meeting in one task."""

    def rows(doc: int, nth: int, text: pa.StringScalar) -> Iterator[tuple[np.ndarray, ...]]:
        data = _bytes_of(text)
        view = memoryview(data)
        for lo, n, offset, a in segments(data, threshold, anchor):
            c1, c2 = _names(view[x:y] for x, y in zip(lo.tolist(), (lo + n + threshold - 1).tolist(), strict=True))
            yield a.view(_INT), c1, c2, (n << 16 | offset << 2).astype(np.int32), np.full(len(lo), doc, _INT), (nth << 32) | lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            parts = [x for doc, nth, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) for x in rows(doc, nth, text)]
            if not parts:
                continue
            a, c1, c2, shape, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, doc, c2, c1))
            a, c1, c2, shape, doc, at = (x[order] for x in (a, c1, c2, shape, doc, at))
            sure = np.r_[False, (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])]
            often = np.isin(a, frequent)
            a = np.where(often, mixed(a.view(np.uint64) ^ c1.view(np.uint64)).view(_INT), a)
            a = np.where(sure, _dealt(doc, at), a)
            yield _batch(_SEGMENT, a, c1, c2, shape | (often << 1 | sure).astype(np.int32), doc, at)

    return docs.mapInArrow(run, _SEGMENT)


def frequent_anchors(docs: DataFrame, threshold: int, anchor: int) -> np.ndarray:
    """Names of anchors with many contents in a sample of the documents."""
    share = max(1, docs.count() // SAMPLE_DOCUMENTS)
    some = docs.where(F.pmod(F.xxhash64(F.lit("frequent"), DOC, NTH), F.lit(share)) == 0)
    found = _segment_rows(some, threshold, anchor, np.empty(0, _INT)).where("shape & 1 = 0").select("a", "c1", "c2").distinct()
    top = found.groupBy("a").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "a").limit(MOST_FREQUENT)
    return np.array(sorted(r["a"] for r in top.collect()), _INT)


_DECIDED = "_doc long, at long, shape int, open boolean"


def _decide(rows: DataFrame) -> DataFrame:
    """Segments sorted by (a, c1, c2, _doc, at) to those that repeat as a whole and those that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        contents = 0  # of the last anchor so far, 2 for more
        waiting = None  # the first segment of the last anchor, while it has one content
        for batch in batches:
            if not batch.num_rows:
                continue
            a, c1, c2, shape, doc, at = (batch.column(k).to_numpy() for k in range(6))
            sure = (shape & 1) == 1
            out = [(doc[sure], at[sure], shape[sure], np.zeros(int(sure.sum()), bool))]
            a, c1, c2, shape, doc, at = (x[~sure] for x in (a, c1, c2, shape, doc, at))
            if len(a):
                new_a = np.r_[a[0] != last[0], a[1:] != a[:-1]]
                new_c = new_a | np.r_[(c1[0], c2[0]) != last[1:], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]
                group = np.cumsum(new_a) - new_a[0]
                total = np.bincount(group, new_c)
                total[group[(shape & 2) == 2]] += 2  # those of frequent anchors stay open
                if new_a[0]:
                    waiting = None
                else:
                    total[0] += contents
                    if waiting is not None and total[0] >= 2:
                        out.append((*waiting, np.ones(1, bool)))
                        waiting = None
                open_ = new_c & (total[group] >= 2)
                chosen = open_ | ~new_c
                out.append((doc[chosen], at[chosen], shape[chosen], open_[chosen]))
                firsts = np.flatnonzero(new_a)
                if total[-1] >= 2:
                    waiting = None
                elif len(firsts):
                    k = slice(firsts[-1], firsts[-1] + 1)
                    waiting = (doc[k], at[k], shape[k])
                last, contents = (a[-1], c1[-1], c2[-1]), min(int(total[-1]), 2)
            doc, at, shape, open_ = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(doc):
                yield _batch(_DECIDED, doc, at, shape, open_)

    return rows.mapInArrow(run, _DECIDED)


_OPENED = "_doc long, at long, n int, offset int, content binary"


def _opened(joined: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the open segments of (_doc, _nth, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            for doc, nth, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                view = memoryview(_bytes_of(text))
                for at in range(0, len(spans.values), _ROWS):
                    lo, n, offset = (spans.values.field(k).to_numpy()[at : at + _ROWS].astype(_INT) for k in range(3))
                    contents = [bytes(view[x:y]) for x, y in zip(lo.tolist(), (lo + n + threshold - 1).tolist(), strict=True)]
                    columns = [pa.array(np.full(len(lo), doc, _INT)), pa.array((nth << 32) | lo), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OPENED.split(", ")])

    return joined.mapInArrow(run, _OPENED)


def edges(width: int, strings: int) -> list[int]:
    """Bounds of the bytes before its anchor that the windows of each string of a round have."""
    return [i * width // strings for i in range(strings + 1)]


_PAIR = "rank long, sure boolean, _doc long, at long, piece int"


def _pairs(state: DataFrame, threshold: int, anchor: int, level: int) -> DataFrame:
    """Names of the pairs of round ``level`` from (_doc, at, n, offset, content, ranks), ranks being those of the
    round before that repeat, each (piece, rank). Equal pairs in a batch are sure to repeat; one of them is sorted."""
    width = threshold - anchor
    wide, fine = edges(width, 1 << (level - 1)), edges(width, 1 << level)
    inner = np.array(fine[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        name = xxhash.xxh3_64_intdigest
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, n, offset = (batch.column(k).to_numpy() for k in range(4))
            low, high = np.searchsorted(inner, np.maximum(offset - n + 1, 0), "right").tolist(), np.searchsorted(inner, offset, "right").tolist()
            row, piece, before, added = [], [], [], []
            for i, (o, content, ranks) in enumerate(zip(offset.tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                end = o + threshold  # of a window that begins with the anchor's offset at 0
                if ranks is None:
                    ranks = [{"piece": 0, "rank": name(content[o : o + anchor])}]
                for r in ranks:
                    p = r["piece"]
                    if low[i] <= 2 * p <= high[i]:  # grows at its end
                        row.append(i)
                        piece.append(2 * p)
                        before.append(r["rank"] & 0xFFFFFFFFFFFFFFFF)
                        added.append(name(content[end - wide[p + 1] : end - fine[2 * p + 1]]))
                    if low[i] <= 2 * p + 1 <= high[i]:  # grows at its start
                        row.append(i)
                        piece.append(2 * p + 1)
                        before.append(r["rank"] & 0xFFFFFFFFFFFFFFFF)
                        added.append(name(content[o - fine[2 * p + 1] : o - wide[p]]))
            if not row:
                continue
            row, piece = np.array(row), np.array(piece, np.int32)
            rank = mixed(np.array(before, np.uint64) * _MIX + mixed(np.array(added, np.uint64) + piece.astype(np.uint64))).view(_INT)
            _, back, count = np.unique(rank, return_inverse=True, return_counts=True)
            yield _batch(_PAIR, rank, count[back.ravel()] > 1, doc[row], at[row], piece)

    return state.mapInArrow(run, _PAIR)


def _repeated(pairs: DataFrame) -> DataFrame:
    """(_doc, at, ranks) of the segments that hold a pair found twice or more."""
    # of pairs that are sure to repeat, one in each batch needs to meet the others; the rest is dealt out evenly
    own = Window.partitionBy("rank").orderBy("_doc", "at")
    again = F.col("sure") | F.lag("at").over(own).isNotNull() | F.lead("at").over(own).isNotNull()
    found = pairs.withColumn("again", again).where("again")
    return found.groupBy(DOC, "at").agg(F.collect_list(F.struct("piece", "rank")).alias("ranks"))


_WINDOW = "w1 long, w2 long, sure boolean, _doc long, at long"


def _windows(state: DataFrame, threshold: int, anchor: int, level: int) -> DataFrame:
    """The undecided windows of (_doc, at, n, offset, content, ranks). Of equal ones in a batch the first needs
    sorting; the others are sure to repeat."""
    inner = np.array(edges(threshold - anchor, 1 << level)[1:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, n, offset = (batch.column(k).to_numpy() for k in range(4))
            row = np.repeat(np.arange(len(n)), n)
            begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            piece = np.searchsorted(inner, offset[row] - begin, "right")
            ranks = batch.column(5)
            left = np.zeros((len(n), 1 << level), bool)
            if ranks.null_count == len(n):
                left[:] = True
            else:
                owner = np.repeat(np.arange(len(n)), np.diff(ranks.offsets.to_numpy()))
                left[owner, ranks.flatten().field(0).to_numpy()] = True
            keep = left[row, piece]
            row, begin = row[keep], begin[keep]
            if not len(row):
                continue
            contents = batch.column(4).to_pylist()
            w1, w2 = _names(contents[r][b : b + threshold] for r, b in zip(row.tolist(), begin.tolist(), strict=True))
            doc, at = doc[row], at[row] + begin
            order = np.lexsort((at, doc, w2, w1))
            w1, w2, doc, at = (x[order] for x in (w1, w2, doc, at))
            sure = np.r_[False, (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]
            yield _batch(_WINDOW, np.where(sure, _dealt(doc, at), w1), w2, sure, doc, at)

    return state.mapInArrow(run, _WINDOW)


def _later(windows: DataFrame) -> DataFrame:
    """The windows that start earlier too."""
    own = Window.partitionBy("w1", "w2").orderBy(DOC, "at")
    return windows.withColumn("place", F.row_number().over(own)).where("sure or place > 1").select(DOC, "at")


def _runs(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of some stretches as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.r_[True, lo[1:] > end[:-1]]
    return lo[new], end[np.r_[new[1:], True]]


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (long) and kept (binary: the UTF-8 bytes left, in order; a string
    if ``as_text``, without the halves of characters that a cut went through).

    Strings are judged on the input, in order of doc_id (null first, as the least number; rows with one doc_id as
    ``with_nth`` numbers them) and place; overlaps count; matches never cross documents. A null text is empty. All
    rows and columns stay (columns named n_bytes, n_removed, n_spans or kept are replaced), repeated rows too: the
    first keeps its bytes. No rows give no rows.
    """
    if not 0 < anchor < threshold < 1 << 14:
        raise ValueError("an anchor is shorter than the threshold, which is below 16,384")
    named = with_nth(docs.drop("n_bytes", "n_removed", "n_spans", "kept"))
    texts = named.select(DOC, NTH, F.col(f"{ROW}.text").cast("string").alias("text"))
    frequent = frequent_anchors(texts, threshold, anchor)
    decided = Saved(_decide(_segment_rows(texts, threshold, anchor, frequent).repartition("a").sortWithinPartitions("a", "c1", "c2", DOC, "at")), "segments")
    shape = [F.shiftright("at", 32).cast("int").alias(NTH), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("lo"), F.shiftright("shape", 16).alias("n")]
    offset = F.shiftright("shape", 2).bitwiseAND(0x3FFF).alias("offset")
    spans = decided.df.where("open").select(DOC, *shape, offset).groupBy(DOC, NTH).agg(F.collect_list(F.struct("lo", "n", "offset")).alias("spans"))
    opened = Saved(_opened(texts.join(spans, [DOC, NTH]).select(DOC, NTH, "text", "spans"), threshold), "opened")
    state, level = opened.df.withColumn("ranks", F.lit(None).cast("array<struct<piece:int,rank:bigint>>")), 0
    held = opened
    while level < ROUNDS and 2 << level <= threshold - anchor:
        level += 1
        pairs = _repeated(_pairs(state, threshold, anchor, level))
        step = Saved(held.df.select(DOC, "at", "n", "offset", "content").join(pairs, [DOC, "at"]), "ranks")
        held.drop()
        held, state = step, step.df
    windows = Saved(_later(_windows(state, threshold, anchor, level)), "windows")
    held.drop()
    repeats = decided.df.where("not open").select(DOC, *shape).unionByName(windows.df.select(DOC, *shape[:2], F.lit(1).alias("n")))
    repeats = repeats.groupBy(DOC, NTH).agg(F.collect_list(F.struct("lo", "n")).alias("repeats"))
    full = named.join(repeats, [DOC, NTH], "left").select(ROW, "repeats")
    text_at = next(i for i, f in enumerate(full.schema[ROW].dataType.fields) if f.name.lower() == "text")
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([full.schema[ROW], *counts, T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, text_at)):
            sizes, removed, runs, kept = [], [], [], []
            for text, repeats in zip(batch.column(0).field(text_at), batch.column(1), strict=True):
                view = memoryview(_bytes_of(text))
                sizes.append(len(view))
                if not repeats.is_valid:
                    removed.append(0)
                    runs.append(0)
                    kept.append(bytes(view))
                    continue
                lo, n = (repeats.values.field(k).to_numpy().astype(_INT) for k in range(2))
                begin, end = _runs(lo, lo + n + threshold - 1)
                removed.append(int((end - begin).sum()))
                runs.append(len(begin))
                kept.append(b"".join(view[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(view)], strict=True)))
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.string() if as_text else pa.binary())], [ROW, "n_bytes", "n_removed", "n_spans", "kept"])

    return full.mapInArrow(cut, schema).select(f"{ROW}.*", "n_bytes", "n_removed", "n_spans", "kept")


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
