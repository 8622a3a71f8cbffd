"""Operator 1. Token ids in sorted-string-table shards.

File format, all integers little-endian: data blocks, the block index, the Bloom filter and the footer, each
followed by one byte 0x0A. Spark's text writer puts one row of raw bytes and that byte at a time, so shards can
go to any file system Spark can write, under its commit protocol: a lost executor's half-written shard never
becomes visible.

* Key: 8 bytes, the identifier big-endian with its sign bit flipped, so bytes sort as the numbers do. A null
  identifier is the empty key and sorts first. Equal identifiers are kept, ordered by text.
* Block: zstd of ``entries, restart offsets (u32 each), number of restarts (u32)`` and a crc32 (u32) of the
  compressed bytes. Entry: u8 bytes shared with the key before, u8 further key bytes, u32 value bytes, the
  further key bytes, the value. Every ``RESTART``-th entry shares nothing, for binary search inside the block.
  A value is the document's ids of ``width`` bytes each, its end id included.
* Index: for each block u8 key length, first key, u64 offset, u32 length, u32 entries.
* Bloom filter: u32 number of hash functions, then the bits, in lines of ``BLOOM_LINE`` of which a key uses one.
* Footer: u64 index offset, u32 index length, u64 filter offset, u32 filter length, u64 documents, u64 tokens,
  u8 width, the first and the last key (each u8 length and 8 bytes), 8 bytes ``SSTTOK02``.

A range partition of the documents becomes one or more shards, so shards are ordered by key and disjoint but for
rows that share an identifier. A shard is closed at ``SHARD_BYTES`` of entries or ``SHARD_KEYS`` keys or when its
blocks, with the three rows at its end, make ``SHARD_ROWS`` rows; empty rows fill it up to that number, at which
Spark's writer begins the next file. So no shard outgrows what one task can hold, however uneven the ranges are.

A lookup reads footers by halving the list of shards, then the filter and the index of the shards that may hold the
key, then one block: ranged reads through Hadoop's file systems, on the driver, of a few kilobytes each.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import delete, documents, new_path, save, slices

MAGIC = b"SSTTOK02"
FOOTER = struct.Struct("<QIQIQQB9s9s8s")
ENTRY = struct.Struct("<BBI")
INDEX_TAIL = struct.Struct("<QII")
#: Bytes of entries, before compression, after which a block is closed.
BLOCK_BYTES = 1 << 16
#: Bytes of entries and keys in a shard, about, and the rows of its file.
SHARD_BYTES = 64 << 20
SHARD_KEYS = 1 << 19
SHARD_ROWS = 2048
RESTART = 16
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
BLOOM_LINE = 512


def to_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def from_key(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _bloom_positions(keys: list[bytes], bits: int) -> np.ndarray:
    """One row of bit positions for each key, all in one line of ``BLOOM_LINE`` bits, so one short read has them."""
    one = np.array([zlib.crc32(k) for k in keys], np.uint64)
    two = np.array([zlib.crc32(k, 0x9E3779B9) for k in keys], np.uint64)
    inside = (two[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * (two >> np.uint64(12) | np.uint64(1))[:, None]) % np.uint64(BLOOM_LINE)
    return (one % np.uint64(bits // BLOOM_LINE) * np.uint64(BLOOM_LINE))[:, None] + inside


class Writer:
    """Gives the rows of shards in file order; entries must come in key order."""

    def __init__(self, width: int, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES):
        self.width, self.shard_rows, self.shard_bytes = width, shard_rows, shard_bytes
        self._open()

    def _open(self) -> None:
        self.at = self.rows = self.docs = self.tokens = self.bytes = self.entries = 0
        self.block, self.restarts, self.first, self.last = bytearray(), [], b"", b""
        self.index, self.keys = bytearray(), []

    def add(self, key: bytes, value: bytes) -> list[bytes]:
        """The rows that this entry finished."""
        if self.entries == 0:
            self.first = key
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        entry = ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.block += entry
        self.bytes += len(entry)
        self.last = key
        self.entries += 1
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        if self.bytes >= self.shard_bytes or len(self.keys) >= SHARD_KEYS or (len(self.block) >= BLOCK_BYTES and self.rows + 4 >= self.shard_rows):
            return self.finish(self.shard_rows)
        return [self.flush()] if len(self.block) >= BLOCK_BYTES else []

    def flush(self) -> bytes:
        import zstandard

        raw = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
        body = zstandard.ZstdCompressor(level=1).compress(raw)
        body += struct.pack("<I", zlib.crc32(body))
        self.index += bytes([len(self.first)]) + self.first + INDEX_TAIL.pack(self.at, len(body), self.entries)
        self.at += len(body) + 1
        self.rows += 1
        self.block, self.restarts, self.entries = bytearray(), [], 0
        return body

    def finish(self, rows: int = 0) -> list[bytes]:
        """The last block, empty rows up to ``rows`` in all, index, filter and footer; nothing without documents."""
        if not self.docs:
            return []
        out = [self.flush()] if self.entries else []
        fill = max(0, rows - self.rows - 3)
        bits = max(1, -(-len(self.keys) * BLOOM_BITS_PER_KEY // BLOOM_LINE)) * BLOOM_LINE
        flags = np.zeros(bits, np.uint8)
        for i in range(0, len(self.keys), 1 << 16):
            flags[_bloom_positions(self.keys[i : i + (1 << 16)], bits).ravel().astype(np.int64)] = 1
        index, bloom = bytes(self.index), struct.pack("<I", BLOOM_HASHES) + np.packbits(flags, bitorder="little").tobytes()
        index_at = self.at + fill
        bloom_at = index_at + len(index) + 1
        ends = [bytes([len(k)]) + k.ljust(8, b"\0") for k in (self.keys[0], self.last)]
        footer = FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.docs, self.tokens, self.width, *ends, MAGIC)
        self._open()
        return [*out, *[b""] * fill, index, bloom, footer]


class Table:
    """Reads one shard of ``size`` bytes with ``read(at, n)``, as little of it as is asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        at = size - 1 - FOOTER.size
        data = read(at, FOOTER.size + 1) if at >= 0 else b""
        if at < 0 or data[-1] != 0x0A:
            raise ValueError("not a token shard: no footer")
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.docs, self.tokens, self.width, *ends, magic = FOOTER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard: wrong magic")
        self.first_key, self.last_key = (x[1 : 1 + x[0]] for x in ends)

    @classmethod
    def of(cls, data: bytes) -> Table:
        view = memoryview(data)
        return cls(lambda at, n: bytes(view[at : at + n]), len(data))

    @functools.cached_property
    def index(self) -> tuple[list[bytes], list[tuple[int, int, int]]]:
        """First key, and offset, length and entries of each block."""
        data, at, first, blocks = self.read(self.index_at, self.index_n), 0, [], []
        while at < len(data):
            n = data[at]
            first.append(data[at + 1 : at + 1 + n])
            blocks.append(INDEX_TAIL.unpack_from(data, at + 1 + n))
            at += 1 + n + INDEX_TAIL.size
        return first, blocks

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        import zstandard

        at, n, _ = self.index[1][i]
        body = self.read(at, n)
        if zlib.crc32(body[:-4]) != struct.unpack_from("<I", body, n - 4)[0]:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(body[:-4])
        count = int.from_bytes(raw[-4:], "little")
        end = len(raw) - 4 - 4 * count
        return raw[:end], np.frombuffer(raw, "<u4", count, end)

    @staticmethod
    def _entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, more, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index[1])):
            yield from self._entries(self._block(i)[0])

    def may_hold(self, key: bytes) -> bool:
        """By the filter, of which only the key's line is read."""
        at = _bloom_positions([key], (self.bloom_n - 4) * 8)[0].astype(np.int64)
        line = int(at[0]) // BLOOM_LINE
        bits = np.frombuffer(self.read(self.bloom_at + 4 + line * BLOOM_LINE // 8, BLOOM_LINE // 8), np.uint8)
        at -= line * BLOOM_LINE
        return bool(np.all((bits[at >> 3] >> (at & 7)) & 1))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that identifier; an empty list if there is none."""
        key, found = to_key(doc_id), []
        if not self.first_key <= key <= self.last_key or not self.may_hold(key):
            return found
        first, blocks = self.index
        i = max(0, bisect.bisect_left(first, key) - 1)  # equal keys may begin in the block before
        while i < len(blocks) and first[i] <= key:
            raw, restarts = self._block(i)
            lo, hi = 0, len(restarts)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                _, more, _ = ENTRY.unpack_from(raw, restarts[mid])
                at = int(restarts[mid]) + ENTRY.size
                lo, hi = (mid, hi) if raw[at : at + more] < key else (lo, mid)
            for k, v in self._entries(raw, int(restarts[lo])):
                if k > key:
                    return found
                if k == key:
                    found.append(np.frombuffer(v, f"<u{self.width}"))
            i += 1
        return found


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the shards to ``path``. Null text: only the end id.

    Rows go by range of doc_id and, so that a frequent or missing one is not a single task, of a hash of the text
    and of the part of the input it comes from.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        out, end = Writer(encoder.width, shard_rows, shard_bytes), np.array([end_id], encoder.dtype).tobytes()
        row = lambda pieces: pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["piece"])
        for batch in (part for whole in batches for part in slices(whole, 1)):
            done = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                done += out.add(to_key(doc_id), encoder.encode(text.as_py()) + end)
            if done:
                yield row(done)
        if rest := out.finish():
            yield row(rest)

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text", F.spark_partition_id()).alias("spread"))
        .repartitionByRange(F.asc_nulls_first("doc_id"), "spread")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "spread")
        .select("doc_id", "text")
        .mapInArrow(shard, "piece binary")
        .select(F.col("piece").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", shard_rows)
        .text(path)
    )


def _place_in_path(name: str) -> tuple[int, int]:
    """Task and number of a file that Spark wrote, which are the order of the shards."""
    task, number = re.search(r"part-([0-9]+)-.*-c([0-9]+)", name).groups()
    return int(task), int(number)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: task and number of its shard, place in it, doc_id, n_tokens, ids_crc32 and
    n_before (tokens of the documents before it in the shard)."""
    names, kinds = ["task", "number", "place", "doc_id", "n_tokens", "ids_crc32", "n_before"], (pa.int32(), pa.int32(), *[pa.int64()] * 5)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, rows, before = Table.of(data.as_py()), [], 0
                for place, (key, value) in enumerate(table.scan()):
                    ids = np.frombuffer(value, f"<u{table.width}").astype("<u4")
                    rows.append((*_place_in_path(where), place, from_key(key), len(ids), zlib.crc32(ids.tobytes()), before))
                    before += len(ids)
                    if len(rows) == 1 << 14:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(scan, "task int, number int, place long, doc_id long, n_tokens long, ids_crc32 long, n_before long")


class Shards:
    """Ranged lookups in the shards below ``path``, on the driver. ``bytes_read`` counts what they took."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs, self.bytes_read = folder.getFileSystem(spark._jsc.hadoopConfiguration()), 0
        found = [(f.getPath(), f.getLen()) for f in self._fs.listStatus(folder) if f.getLen() and f.getPath().getName().startswith("part-")]
        self.files = sorted(found, key=lambda f: _place_in_path(f[0].getName()))
        self._tables: dict[int, Table] = {}

    def _read(self, file, at: int, n: int) -> bytes:
        stream = self._fs.open(file)
        try:
            stream.seek(at)
            self.bytes_read += n
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def table(self, i: int) -> Table:
        if i not in self._tables:
            file, size = self.files[i]
            self._tables[i] = Table(lambda at, n: self._read(file, at, n), size)
        return self._tables[i]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that identifier, found by binary search."""
        key, found = to_key(doc_id), []
        i = bisect.bisect_left(range(len(self.files)), key, key=lambda k: self.table(k).last_key)
        while i < len(self.files) and self.table(i).first_key <= key:
            found += self.table(i).get(doc_id)
            i += 1
        return found


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """The ids of the named documents, found by binary search, filter and index: doc_id, ids array<int>."""
    shards = Shards(spark, path)
    rows = [(d, ids.astype("<i4").tolist()) for d in doc_ids for ids in shards.get(d)]
    return spark.createDataFrame(rows, "doc_id long, ids array<int>")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the shards, reads them back and adds ``start``, the tokens of all documents before one.

    Result: doc_id, start, n_tokens, ids_crc32 (long). No documents: no shards, no rows. A null doc_id comes
    first; repeated doc_ids keep all their rows. Further columns of ``docs`` are not carried. Without a ``path`` the
    shards go when they have been read.
    """
    spark = docs.sparkSession
    to = path or new_path(spark, "token-shards")
    write(docs, to, tokenizer, end_id)
    found = save(read(spark, to), "token-rows")
    if path is None:
        delete(spark, to)
    totals = found.groupBy("task", "number").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    totals = totals.select("task", "number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return found.join(totals, ["task", "number"]).select("doc_id", (F.col("base") + F.col("n_before")).alias("start"), "n_tokens", "ids_crc32")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2)
