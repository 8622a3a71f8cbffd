"""Write-ahead logs (JSON lines) and the stores over them.

A line is ``{"id": ..., "parents": [...], "payload": "Noop" | "Genesis" | {"Data": {"kind": ..., "value": ...}}}``.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical
from ..plans.steps import Step, new_path, numbered
from ..schema import COLUMNS, EVENTS, HISTORY, KEY


class Store(Protocol):
    def append(self, events: DataFrame) -> None: ...

    def load_all(self) -> DataFrame: ...

    def known_ids(self) -> DataFrame: ...

    def __len__(self) -> int: ...

    def is_empty(self) -> bool: ...


def to_lines(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A column ``value``, after those to ``keep``; the payload is written as it was hashed."""
    head = F.to_json(F.struct("id", "parents"))
    return events.select(*keep, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.col("payload_json"), F.lit("}")).alias("value"))


def parse_lines(lines: DataFrame, strict: bool = True, history: Column | str = "main", hash_safe: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events from a column ``value``. Blank lines are skipped; a bad line fails the whole read, or (not strict)
    goes to rows with ``_corrupt``. ``hash_safe``: payloads of other writers are put into canonical form. ``keep``:
    further columns that stay."""
    name = F.lit(history) if isinstance(history, str) else history
    parsed = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    payload = F.try_variant_get("v", "$.payload", "variant")
    kind = F.try_variant_get("v", "$.payload.Data.kind", "string")
    # where the payload is the last of three fields its own bytes are kept; else it is what the parser makes of it
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    head = rf'\s*\{{\s*"id"\s*:\s*{string}\s*,\s*"parents"\s*:\s*\[[^\]"]*+(?:{string}[^\]"]*+)*+\]\s*,\s*"payload"\s*:\s*'
    text = F.rtrim(F.regexp_extract("value", rf"(?s)^{head}(.*)\}}\s*$", 1))
    raw = F.when((text != "") & (F.size(F.json_object_keys("value")) == 3), text).otherwise(F.to_json(payload))
    tag = F.when(kind.isNotNull(), F.lit("Data")).otherwise(F.try_variant_get(payload, "$", "string"))
    rows = parsed.select(
        name.alias(HISTORY), F.try_variant_get("v", "$.id", "string").alias("id"), tag.alias("tag"), kind.alias("kind"),
        (canonical(raw) if hash_safe else raw).alias("payload_json"), F.array_sort(F.array_distinct(F.try_variant_get("v", "$.parents", "array<string>"))).alias("parents"), "value", *keep,
    )
    good = F.col("id").isNotNull() & F.col("tag").isin("Data", "Noop", "Genesis") & F.col("parents").isNotNull()
    if not strict:
        return rows.select(*COLUMNS, F.when(~F.coalesce(good, F.lit(False)), F.col("value")).alias("_corrupt"), *keep)
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))))
    return rows.withColumn("id", checked).select(*COLUMNS, *keep)


class MemoryStore:
    """Events in order of arrival, each id once: one folder for each append, gone with the session's other tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.appends = spark, new_path(spark, "store"), 0

    def _rows(self) -> DataFrame:
        if not self.appends:
            return self.spark.createDataFrame([], EVENTS).withColumns({"_line": F.lit(0).cast("long"), "append": F.lit(0)})
        return self.spark.read.parquet(self.path)

    def append(self, events: DataFrame) -> None:
        """Adds what is new, in the order of the rows; of equal new ids the first counts."""
        placed = Step(events.select(*COLUMNS).withColumn("_line", F.monotonically_increasing_id()), "arrived")
        first = placed.df.groupBy(*KEY).agg(F.min_by(F.struct(*placed.df.columns), "_line").alias("x")).select("x.*")
        first.join(self.known_ids(), KEY, "left_anti").write.parquet(f"{self.path}/append={self.appends}")
        placed.drop()
        self.appends += 1

    def load_all(self) -> DataFrame:
        return self._rows().select(*COLUMNS)

    def in_order(self) -> DataFrame:
        """Events with ``ingest_seq``, their place in order of arrival, from 0."""
        return numbered(self._rows(), "append", "_line", name="ingest_seq").select(*COLUMNS, "ingest_seq")

    def known_ids(self) -> DataFrame:
        return self._rows().select(*KEY)

    def __len__(self) -> int:
        return self._rows().count()

    def is_empty(self) -> bool:
        return self._rows().isEmpty()


class FileStore:
    """A log in a directory of JSON lines. Appending does not look for duplicates; reading takes each id once.
    A missing directory is an empty log."""

    def __init__(self, spark: SparkSession, path: str, history: str = "main"):
        self.spark, self.path, self.history = spark, path, history

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def append(self, events: DataFrame) -> None:
        to_lines(events).write.mode("append").text(self.path)

    def lines(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], "value string")
        return self.spark.read.text(self.path)

    def load_all(self, strict: bool = True) -> DataFrame:
        found = parse_lines(self.lines(), strict, self.history)
        return found.dropDuplicates(KEY)

    def _placed(self) -> DataFrame:
        """Lines with what gives their order; without a log, none."""
        lines = self.lines()
        if not self._exists():
            return lines.select("value", F.lit(None).cast("timestamp").alias("_time"), F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("_line"))
        place = {"_time": "file_modification_time", "_file": "file_path", "_block": "file_block_start"}
        return lines.select("value", *(F.col(f"_metadata.{v}").alias(k) for k, v in place.items())).withColumn("_line", F.monotonically_increasing_id())

    def bad_lines(self) -> DataFrame:
        """Lines that a strict load fails at: file, line_number (from 1, blank lines counted), value. Only files that
        hold one are counted through."""
        placed = Step(self._placed(), "placed").df
        wrong = parse_lines(placed, False, self.history, keep=("_file", "_block", "_line")).where("_corrupt IS NOT NULL")
        wrong = Step(wrong.select("_file", "_block", "_line", F.col("_corrupt").alias("value")), "bad").df
        blocks = placed.join(wrong.select("_file").distinct(), "_file", "left_semi").groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_line").alias("first"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = blocks.select("_file", "_block", "first", before.alias("before"))  # a row for each block of a file
        number = F.col("before") + F.col("_line") - F.col("first") + 1
        return wrong.join(starts, ["_file", "_block"]).select(F.col("_file").alias("file"), number.alias("line_number"), "value")

    def in_order(self) -> DataFrame:
        """Events with ``ingest_seq``, their place in the log from 0: files by the time they were written, then by
        name, and lines as they stand in them; of equal ids the first."""
        order = ("_time", "_file", "_block", "_line")
        rows = parse_lines(self._placed(), True, self.history, keep=order)
        first = rows.groupBy(*KEY).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("x")).select("x.*")
        return numbered(first, *order, name="ingest_seq").select(*COLUMNS, "ingest_seq")

    def known_ids(self) -> DataFrame:
        """Ids as stored."""
        return parse_lines(self.lines(), True, self.history).select(*KEY).distinct()

    def __len__(self) -> int:
        """Lines, duplicates included."""
        return self.lines().where(F.trim("value") != "").count()

    def is_empty(self) -> bool:
        return len(self) == 0
