"""Operator 3. Packing documents into sequences: best fit first, then a swap-based local search.

Lengths are at most ``capacity``, so the pieces alone (a few numbers each) are packed. They are dealt by hash
into groups of bounded size, and each group is packed in one task: best fit decreasing, then a local search over
the bins with free space. It takes bins from the emptiest on and gives one or two of a bin's pieces to another bin,
for nothing (a move) or for one or two shorter ones, if that raises the sum of squared fills, until the bin is empty
or nothing of it can be given. Passes over the bins go on until one of them finds no exchange; as the sum rises
with each exchange, they end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import documents, save, slices

CAPACITY = 1024
#: Pieces in a group that one task packs. More pieces make more groups, never larger ones.
GROUP_PIECES = 40_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Ties: the longer piece first, then the earlier one."""
    where, fills, by_room = np.empty(len(lengths), np.int64), 0, [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, fills = capacity, fills, fills + 1
        where[i] = b
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return where


class _Bins:
    """Bins with room and, for each length that one or two of a bin's pieces have together (or 0, for none), the
    bins that can return it, by room."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.members: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.values: dict[int, set[int]] = {}
        #: of each value: the bins by room, the rooms as bits, and the greatest room (-1: none)
        self.by_room: list[dict[int, set[int]]] = [{} for _ in range(capacity + 1)]
        self.rooms = [0] * (capacity + 1)
        self.most = np.full(capacity + 1, -1, np.int64)

    def insert(self, b: int, members: list[int]) -> None:
        """Full and empty bins are held, but no longer looked at."""
        self.members[b], self.fill[b] = members, sum(self.lengths[p] for p in members)
        room = self.capacity - self.fill[b]
        own = sums(self.lengths[p] for p in members) if room and members else set()
        self.values[b] = own
        for v in own:
            at = self.by_room[v].setdefault(room, set())
            if not at:
                self.rooms[v] |= 1 << room
                self.most[v] = max(self.most[v], room)
            at.add(b)

    def remove(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        for v in self.values.pop(b):
            at = self.by_room[v][room]
            at.discard(b)
            if not at:
                self.rooms[v] &= ~(1 << room)
                self.most[v] = self.rooms[v].bit_length() - 1

    def taker(self, n: int, fill: int) -> tuple[int, int] | None:
        """The bin that takes pieces of length ``n`` from a bin with that fill, and what it returns, as little as
        can be; of several the fullest."""
        for v in np.flatnonzero(self.most[:n] >= np.arange(n, 0, -1)).tolist():
            fitting = self.rooms[v] >> (n - v)
            room = n - v + (fitting & -fitting).bit_length() - 1
            if self.capacity - room + n - v > fill:  # the sum of squares rises
                return min(self.by_room[v][room]), v
        return None

    def chosen(self, b: int, value: int) -> list[int]:
        """One or two of a bin's pieces that have that length together; none for 0."""
        if not value:
            return []
        at: dict[int, int] = {}
        for p in self.members[b]:
            n = self.lengths[p]
            if n == value:
                return [p]
            at.setdefault(n, p)
        seen: dict[int, int] = {}
        for p in self.members[b]:
            n = self.lengths[p]
            if value - n in seen:
                return [seen[value - n], p]
            seen.setdefault(n, p)
        raise AssertionError("a bin lacks what its index says")


def sums(lengths) -> set[int]:
    """0, the lengths, and the lengths of pairs."""
    once, twice = set(), set()
    for n in lengths:
        (twice if n in once else once).add(n)
    every = sorted(once)
    return {0, *every, *(n + n for n in twice), *(a + b for i, a in enumerate(every) for b in every[:i])}


def local_search(lengths: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Raises the sum of squared fills by exchanges between bins with room, draining the emptiest bins first."""
    where = where.copy()
    sizes = lengths.tolist()
    members: dict[int, list[int]] = {}
    for p, b in enumerate(where.tolist()):
        members.setdefault(b, []).append(p)
    bins = _Bins(sizes, capacity)
    for b, own in members.items():
        if sum(sizes[p] for p in own) < capacity:
            bins.insert(b, own)
    changed = True
    while changed:
        changed = False
        for low in sorted(bins.values, key=lambda b: (bins.fill[b], b)):
            while 0 < bins.fill[low] < capacity:
                bins.remove(low)
                found = None
                for n in sorted(sums(sizes[p] for p in bins.members[low]) - {0}, reverse=True):
                    if n <= capacity and (found := bins.taker(n, bins.fill[low])):
                        break
                if found is None:
                    bins.insert(low, bins.members[low])
                    break
                other, value = found
                given, returned = bins.chosen(low, n), bins.chosen(other, value)
                bins.remove(other)
                bins.insert(other, [p for p in bins.members[other] if p not in returned] + given)
                bins.insert(low, [p for p in bins.members[low] if p not in given] + returned)
                changed = True
    for b, own in bins.members.items():
        where[own] = b
    return where


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece, numbered from 0 without gaps."""
    if not len(lengths):
        return np.empty(0, np.int64)
    if int(lengths.max()) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    return np.unique(local_search(lengths, best_fit_decreasing(lengths, capacity), capacity), return_inverse=True)[1].astype(np.int64)


def encoded_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32. The remainder comes first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.frombuffer(encoder.encode(text.as_py()), encoder.dtype), encoder.dtype.type(end_id)).astype("<u4")
                start, length = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, length, piece = start + length, capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, start, length and ids_crc32.

    Groups are dealt by hash over every column and the row's place in the table, so rows alike in all columns are
    spread too.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.select(*columns, F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(groups)).alias("group"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(columns, kind="stable", ignore_index=True)
        bins = pack(group["length"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(group["length"].to_numpy()[order])
        begins = ends - group["length"].to_numpy()[order]
        new = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(new, begins, 0))
        out = group.iloc[order][columns].copy()
        out["sequence_id"] = (group["group"].to_numpy()[order].astype(np.int64) << 32) + bins[order]
        out["offset"] = begins - base
        return out

    return dealt.groupBy("group").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents. Null or empty text: one piece with only the end id. No documents: no rows.

    Repeated rows are packed as often as they come; a null doc_id stays null; other columns are not carried.
    """
    return pack_pieces(save(encoded_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 2)
