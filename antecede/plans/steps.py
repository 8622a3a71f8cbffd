"""Tables written between the steps of iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark then removes the shuffle files of a statement when the statement ends, not when the JVM collects its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master, as in tests, gets a new folder where that is unset; on a
    cluster each machine would write to its own disk, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="antecede-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call returned."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Step:
    """A table written and read back: its lineage ends in files that survive the loss of any executor, and the
    shuffle files behind it go when it is written."""

    def __init__(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        write(df, self.path, partition_by)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _written.setdefault(self.spark.sparkContext.applicationId, set()).add(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)
        _written.get(self.spark.sparkContext.applicationId, set()).discard(self.path)


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes Parquet and drops the shuffle files that it took."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=list(partition_by) or None)
    finally:
        spark.conf.set(_CLEANUP, before)


def sweep(spark: SparkSession) -> None:
    """Deletes every table that steps of this session wrote and still hold. For when all results have been read:
    a DataFrame that an operator returned may still read them."""
    for path in _written.pop(spark.sparkContext.applicationId, set()):
        delete(spark, path)


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Adds the place of each row in that order, from 0, without one task that sorts everything: rows are dealt
    out by range, counted by range, and numbered inside each."""
    ranged = Step(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges").df
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + own - 1).drop("_range", "_before")
