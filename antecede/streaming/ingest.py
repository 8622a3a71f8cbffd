"""Online ingestion with Structured Streaming: a directory of log lines to a history and its state.

Events may come out of order and more than once. Each micro-batch is inserted into the events table (an anti-join
on ids is the exact deduplication, without unbounded state), histories that it touched are reduced and projected
again, and their new state replaces the old one, so the output is in update mode. The offsets in the checkpoint
and the batch number in the paths make a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dag import insert
from ..operators.project import project
from ..operators.reduce import ReduceConfig, reduce
from ..plans.steps import new_path
from ..schema import EVENTS, HISTORY, KEY
from ..sources.wal import parse_lines


def read_log(spark: SparkSession, path: str, history: str = "main", files_per_batch: int | None = None) -> DataFrame:
    """A stream of events from a directory of JSON lines."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_lines(reader.load(path), True, history)


def deduplicated(stream: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each id once. Exact and with state that grows with the ids; with a watermark (column, delay), bounded
    state that forgets."""
    if watermark is None:
        return stream.dropDuplicates(KEY)
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(KEY)


class HistoryTable:
    """The events table that a stream writes, one folder for each batch, and the state of the projections.

    A table opened on the path of an earlier one goes on where that one ended. A batch counts when the marker
    written after all of its folders is there; one that was cut short is taken anew by the stream, in place.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, projections: tuple[str, ...] = ("key_value",), config: ReduceConfig | None = None):
        self.spark, self.path, self.projections, self.config = spark, path or new_path(spark, "stream"), projections, config
        self.subscribers: list[Callable[[int, DataFrame], None]] = []
        self.batches = self._finished()

    def _fs(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _finished(self) -> int:
        """One more than the number of the last batch with a marker."""
        folder, fs = self._fs("finished")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) + 1 for n in names), default=0)

    def subscribe(self, callback: Callable[[int, DataFrame], None]) -> None:
        """``callback(batch, delta)`` after every batch."""
        self.subscribers.append(callback)

    def _read(self, name: str, batches: int) -> DataFrame:
        """One of the tables, up to that batch; the folder of a batch is a partition."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch") < batches)

    def _events(self, batches: int) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], EVENTS)
        return self._read("events", batches).select(*EVENTS.fieldNames())

    def events(self) -> DataFrame:
        """All events taken in, each id once."""
        return self._events(self.batches)

    def state(self, projection: str) -> DataFrame:
        """The newest state of every history."""
        if not self.batches:
            return project(self.events(), projection)
        newest = self._read("touched", self.batches).groupBy(HISTORY).agg(F.max("batch").alias("batch"))
        return self._read(projection, self.batches).join(newest, [HISTORY, "batch"], "left_semi").drop("batch")

    def take(self, batch: DataFrame, number: int) -> None:
        known = self._events(number)
        fresh = batch.dropDuplicates(KEY).join(known.select(*KEY), KEY, "left_anti")
        fresh.select(*EVENTS.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/events/batch={number}")
        new = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events/batch={number}")
        new.select(HISTORY).distinct().write.mode("overwrite").parquet(f"{self.path}/touched/batch={number}")
        touched = self.spark.read.parquet(f"{self.path}/touched/batch={number}")
        before = known.join(touched, HISTORY, "left_semi")
        out = reduce(insert(before, new), self.config, before=before)
        for name in self.projections:
            project(out.events, name).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        marker, fs = self._fs(f"finished/{number}")
        fs.create(marker, True).close()
        self.batches = max(self.batches, number + 1)
        for callback in self.subscribers:
            callback(number, out.delta)

    def follow(self, stream: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(lambda df, n: self.take(df, n)).option("checkpointLocation", f"{self.path}/offsets")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
