"""Helpers shared by the training-data operators: shared storage, tables written between steps, row identity."""

from __future__ import annotations

import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.steps import Step, delete, new_path, shared_dir, sweep

__all__ = ["DOC", "NTH", "ROW", "Saved", "delete", "documents", "new_path", "save", "shared_dir", "ship", "slices", "sweep", "unsigned_crc32", "with_nth"]


class Saved(Step):
    """A table written to the shared folder and read back, so that its lineage ends there."""


def save(df: DataFrame, name: str) -> DataFrame:
    return Saved(df, name).df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def unsigned_crc32(column) -> F.Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; a null string counts as no bytes."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


_shipped: set[str] = set()


#: Bytes of an Arrow batch, of which a task holds a few on both sides.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, wherever the driver found it, and has
    batches that go there bounded by bytes, as texts may be long."""
    import os
    import zipfile

    spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="antecede-"), "antecede_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(at, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


ROW, DOC, NTH = "row", "_doc", "_nth"
#: Parts, by hash of all columns, in which rows of one doc_id are numbered, and shares of equal rows in each.
_PARTS, _SHARES = 1024, 32


def with_nth(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so that no name clashes), ``_doc`` (doc_id as long, the least
    long for null) and ``_nth``; the last two together name a row.

    Where doc_ids are unique, as they should be, _nth is 0. Rows that share one are numbered in an order that hangs
    on all their columns (equal rows: on the part of the input too), in two steps, so that a frequent or missing
    doc_id is no single task; the numbered table is written once, so every use sees the same numbers.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(whole.alias(ROW), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(DOC))
    if named.groupBy(DOC).count().where("count > 1").isEmpty():
        return named.withColumn(NTH, F.lit(0))
    sortable = [f"row.`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = named.withColumn("_hash", F.xxhash64(*sortable))
    dealt = dealt.withColumn("_part", F.pmod("_hash", F.lit(_PARTS)) * _SHARES + F.pmod(F.spark_partition_id(), F.lit(_SHARES)))
    dealt = save(dealt, "rows")
    sizes = dealt.groupBy(DOC, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(DOC).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(DOC, "_part").orderBy("_hash", *sortable))
    ranked = dealt.withColumn("_own", own).join(sizes.select(DOC, "_part", before.alias("_before")), [DOC, "_part"])
    return save(ranked.select(ROW, DOC, (F.col("_before") + F.col("_own") - 1).cast("int").alias(NTH)), "numbered")


def slices(batch: pa.RecordBatch, column: int, field: int | None = None, most: int = 4 << 20):
    """A batch in parts whose texts in ``column`` (or a field of that struct) have about ``most`` bytes (one longer
    text is a part alone), so that what is derived from a part stays small."""
    texts = batch.column(column) if field is None else batch.column(column).field(field)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)
