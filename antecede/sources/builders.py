"""Synthetic histories and histories over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import data_payload
from ..schema import COLUMNS, HISTORY

NO_PARENTS = "array<string>"


def pad(number: Column | str, width: int = 12) -> Column:
    """An id that sorts as its number does."""
    return F.lpad((F.col(number) if isinstance(number, str) else number).cast("string"), width, "0")


def _numbered(df: DataFrame, parents: Column, tag: Column, kind: Column, payload: Column, history: Column | None = None) -> DataFrame:
    return df.select((history if history is not None else F.lit("main")).alias(HISTORY), pad("i").alias("id"), tag.alias("tag"), kind.alias("kind"), payload.alias("payload_json"), parents.alias("parents"))


def _sure(parents: Column) -> Column:
    return F.coalesce(parents, F.array().cast(NO_PARENTS))


def linear(spark: SparkSession, n: int) -> DataFrame:
    """A root and a chain of n events below it."""
    before = F.when(F.col("i") > 0, F.array(pad(F.col("i") - 1)))
    data = F.col("i") > 0
    payload = F.when(data, data_payload(F.lit("tx"), F.concat(F.lit('{"seq":'), (F.col("i") - 1).cast("string"), F.lit("}")))).otherwise('"Genesis"')
    return _numbered(spark.range(n + 1).withColumnRenamed("id", "i"), _sure(before), F.when(data, "Data").otherwise("Genesis"), F.when(data, "tx"), payload)


def fanout(spark: SparkSession, n: int, width: int = 4) -> DataFrame:
    """A root and n events, each event with up to ``width`` children."""
    data = F.col("i") > 0
    before = F.when(data, F.array(pad(F.expr(f"(i - 1) div {width}"))))
    value = F.concat(F.lit('{"b":'), ((F.col("i") - 1) % width).cast("string"), F.lit(',"c":'), F.col("i").cast("string"), F.lit("}"))
    payload = F.when(data, data_payload(F.lit("branch"), value)).otherwise('"Genesis"')
    return _numbered(spark.range(n + 1).withColumnRenamed("id", "i"), _sure(before), F.when(data, "Data").otherwise("Genesis"), F.when(data, "branch"), payload)


def noop_chain(spark: SparkSession, n: int, every: int = 3) -> DataFrame:
    """A root and a chain of n events, the first and then each ``every``-th a no-op."""
    k = F.col("i") - 1
    noop, root = k % every == 0, F.col("i") == 0
    tag = F.when(root, "Genesis").when(noop, "Noop").otherwise("Data")
    payload = F.when(root, '"Genesis"').when(noop, '"Noop"').otherwise(data_payload(F.lit("op"), F.concat(F.lit('{"i":'), k.cast("string"), F.lit("}"))))
    before = F.when(~root, F.array(pad(F.col("i") - 1)))
    return _numbered(spark.range(n + 1).withColumnRenamed("id", "i"), _sure(before), tag, F.when(~root & ~noop, "op"), payload)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("i"), "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _set_payload(key: Column, value: Column) -> Column:
    return data_payload(F.lit("set"), F.concat(F.lit('{"key":"'), key, F.lit('","val":'), value.cast("string"), F.lit("}")))


def user_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain for each user in order of time; errors are no-ops, others set their type to a number. Also ``i``
    and ``ts``, the sequence."""
    own = Window.partitionBy("user_id").orderBy("ts", "i")
    noop = F.col("event_type") == "error"
    rows = _events(spark, sf_dir).withColumn("before", F.lag("i").over(own))
    return rows.select(
        F.col("user_id").cast("string").alias(HISTORY), pad("i").alias("id"), F.when(noop, "Noop").otherwise("Data").alias("tag"), F.when(~noop, "set").alias("kind"),
        F.when(noop, '"Noop"').otherwise(_set_payload(F.col("event_type"), F.col("k"))).alias("payload_json"), _sure(F.when(F.col("before").isNotNull(), F.array(pad("before")))).alias("parents"), "ts", "i",
    )


def _graph(spark: SparkSession, sf_dir: str, parents: Column, noop: Column) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.select(
        F.lit("main").alias(HISTORY), pad("i").alias("id"), F.when(noop, "Noop").otherwise("Data").alias("tag"), F.when(~noop, "set").alias("kind"),
        F.when(noop, '"Noop"').otherwise(_set_payload(F.concat("event_type", (F.col("i") % 7).cast("string")), F.col("k"))).alias("payload_json"), _sure(parents).alias("parents"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event i below event (i - 1) div 4."""
    return _graph(spark, sf_dir, F.when(F.col("i") > 0, F.array(pad(F.expr("(i - 1) div 4")))), F.lit(False))


def two_parents(spark: SparkSession, sf_dir: str, noops: bool = True) -> DataFrame:
    """Event i below events (i - 1) div 4 and (i - 1) div 3; those with i mod 3 = 1 are no-ops."""
    both = F.array_sort(F.array_distinct(F.array(pad(F.expr("(i - 1) div 4")), pad(F.expr("(i - 1) div 3")))))
    return _graph(spark, sf_dir, F.when(F.col("i") > 0, both), (F.col("i") % 3 == 1) if noops else F.lit(False))


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping parts of the tree, each with gaps; both hold the root."""
    every = tree(spark, sf_dir)
    i = F.col("id").try_cast("long")  # the filter may be pushed to other tables, whose ids are no numbers
    return every.where(i % 3 != 2), every.where((i % 3 != 0) | (i == 0))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain for each conversation; system turns are no-ops, others are logged. Also ``turn``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    noop = F.col("role") == "system"
    return rows.withColumn("before", before).select(
        F.col("conv_id").cast("string").alias(HISTORY), pad("turn").alias("id"), F.when(noop, "Noop").otherwise("Data").alias("tag"), F.when(~noop, "log").alias("kind"),
        F.when(noop, '"Noop"').otherwise(data_payload(F.lit("log"), F.to_json(F.to_variant_object(F.struct("text"))))).alias("payload_json"),
        _sure(F.when(F.col("before").isNotNull(), F.array(pad("before")))).alias("parents"), "turn",
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below one root and labels below their document, with ids that are no hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    root = spark.range(1).select(F.lit("main").alias(HISTORY), F.lit("0").alias("id"), F.lit("Genesis").alias("tag"), F.lit(None).cast("string").alias("kind"), F.lit('"Genesis"').alias("payload_json"), F.array().cast(NO_PARENTS).alias("parents"))
    d = docs.select(F.lit("main").alias(HISTORY), F.concat(F.lit("d"), pad("doc_id")).alias("id"), F.lit("Data").alias("tag"), F.lit("doc").alias("kind"), F.coalesce("text", F.lit("")).alias("payload_json"), F.array(F.lit("0")).alias("parents"))
    own = F.concat(F.lit("q"), F.coalesce(F.col("quality").cast("string"), F.lit("-")), F.lit("t"), F.coalesce(F.col("toxic").cast("string"), F.lit("-")))
    lab = labels.select(F.lit("main").alias(HISTORY), F.concat(F.lit("l"), pad("doc_id")).alias("id"), F.lit("Data").alias("tag"), F.lit("label").alias("kind"), own.alias("payload_json"), F.array(F.concat(F.lit("d"), pad("doc_id"))).alias("parents"))
    return root.unionByName(d).unionByName(lab).select(*COLUMNS)


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events for each test event below one root: a and b with one payload; c below both and d below a, with one
    payload; e below c and d and f below c, with one payload. Ids are no hashes."""
    rows = _events(spark, sf_dir).select(F.explode(F.array(*map(F.lit, "abcdef"))).alias("x"), "i")
    root = spark.range(1).select(F.lit("main").alias(HISTORY), F.lit("0").alias("id"), F.lit("Genesis").alias("tag"), F.lit(None).cast("string").alias("kind"), F.lit('"Genesis"').alias("payload_json"), F.array().cast(NO_PARENTS).alias("parents"))
    own = lambda *names: F.array(*(F.concat(F.lit(n), pad("i")) for n in names))
    parents = F.when(F.col("x").isin("a", "b"), F.array(F.lit("0"))).when(F.col("x") == "c", own("a", "b")).when(F.col("x") == "d", own("a")).when(F.col("x") == "e", own("c", "d")).otherwise(own("c"))
    payload = F.concat(F.translate("x", "abcdef", "aaccee"), F.col("i").cast("string"))
    made = rows.select(F.lit("main").alias(HISTORY), F.concat("x", pad("i")).alias("id"), F.lit("Data").alias("tag"), F.lit("set").alias("kind"), payload.alias("payload_json"), parents.alias("parents"))
    return root.unionByName(made).select(*COLUMNS)
