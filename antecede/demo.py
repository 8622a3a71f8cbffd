"""``python -m antecede.demo``: state as a function of the normal form of a history, in four small examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import data, genesis, noop
from .kernel import Kernel, Node


def _history(kernel: Kernel, steps: list[tuple | None]) -> Kernel:
    """The kernel with a chain of events (kind, value), None for a no-op, taken in as one batch."""
    last, rows = genesis(), []
    for step in steps:
        last = noop([last[1]]) if step is None else data(*step, [last[1]])
        rows.append(last)
    kernel.append(rows)
    return kernel


def run(spark: SparkSession) -> DataFrame:
    """example, name, value: the derived state of each example."""
    kv = _history(Kernel(spark), [("set", {"key": "name", "val": "Alice"}), ("set", {"key": "role", "val": "admin"}), ("set", {"key": "name", "val": "Bob"})])
    counter = _history(Kernel(spark), [("increment", n) for n in (1, 5, 3, -2, 10)])
    log = _history(Kernel(spark), [("log", "system started"), None, ("log", "user logged in"), None, ("log", "action performed")])
    nodes = [Node(spark, "A"), Node(spark, "B")]
    for node, amounts in zip(nodes, ((100, 50), (25, 75)), strict=True):
        _history(node, [("increment", n) for n in amounts])
    nodes[0].sync_with(nodes[1])
    nodes[1].sync_with(nodes[0])
    found = [kv.state("key_value").select(F.lit("key_value").alias("example"), F.col("key").alias("name"), F.get_json_object("val", "$").alias("value"))]
    found.append(counter.state("counter").select(F.lit("counter"), F.lit("total"), F.col("total").cast("string")))
    found.append(log.state("log").select(F.lit("log"), F.col("pos").cast("string"), F.get_json_object("value", "$")))
    found += [n.state("counter").select(F.lit("convergence"), F.lit(n.name), F.col("total").cast("string")) for n in nodes]
    sizes = [("key_value", kv), ("counter", counter), ("log", log), ("convergence", nodes[0])]
    found += [k.events.agg(F.count("*").cast("string").alias("n")).select(F.lit(name), F.lit("events"), "n") for name, k in sizes]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def main() -> int:
    spark = SparkSession.builder.appName("antecede-demo").getOrCreate()
    for row in run(spark).orderBy("example", "name").collect():
        print(f"{row['example']}: {row['name']} = {row['value']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
