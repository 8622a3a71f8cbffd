"""Messages between replicas as JSON lines.

A line is an object with ``type`` and the field of that type; an event in it looks as it does in a log. The ids or
events of one message may take many lines of its type, so no line grows with the history. Events are written one to
a line and keep their payload's bytes; of several in a line of another writer the JSON parser writes numbers its way.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HISTORY
from ..sources.wal import parse_lines, to_lines

#: The types of messages and the field that each has.
FIELDS = {
    "hello": "node_id",
    "hello_ack": "node_id",
    "have": "ids",
    "want": "ids",
    "events": "events",
    "events_ack": "count",
    "push": "events",
    "push_ack": "count",
    "error": "message",
    "bye": None,
}

#: Ids in a line, about.
PER_LINE = 1000

_WIRE = f"type string, {HISTORY} string, node_id string, count long, message string, ids array<string>, events array<string>"


def note(kind: str, value: str | int | None = None) -> str:
    """The line of a message without rows: a greeting, an acknowledgement, an error or a farewell."""
    name = FIELDS[kind]
    if name in ("ids", "events"):
        raise ValueError(f"{kind} is made of rows")
    return json.dumps({"type": kind} | ({name: value} if name else {}), ensure_ascii=False)


def messages(kind: str, rows: DataFrame, per_line: int = PER_LINE) -> DataFrame:
    """Ids (have, want) or whole events (events, push) as lines; no rows are one line with an empty list."""
    name = FIELDS[kind]
    if name not in ("ids", "events"):
        raise ValueError(f"{kind} has no rows")
    none = rows.sparkSession.range(1).select(F.lit(f'{{"type":"{kind}","{name}":[]}}').alias("line"))
    head = F.to_json(F.struct(F.lit(kind).alias("type"), HISTORY))
    start = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(f',"{name}":['))
    if name == "events":
        if rows.isEmpty():
            return none
        return to_lines(rows, (HISTORY,)).select(F.concat(start, "value", F.lit("]}")).alias("line"))
    n = rows.count()
    if not n:
        return none
    part = F.pmod(F.xxhash64("id"), F.lit(math.ceil(n / per_line)))
    lists = rows.groupBy(HISTORY, part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("ids"))
    return lists.select(F.concat(start, F.substring("ids", F.lit(2), F.length("ids") - 1), F.lit("}")).alias("line"))


def parse_messages(lines: DataFrame, history: str = "main") -> DataFrame:
    """Back from JSON lines, a row for each id, event or message without rows: type, history_id (as written, else
    ``history``), node_id, count, message, id, payload_json, parents, and the event's own line in ``value``. A line
    of an unknown type is an error; a list without entries gives a row without an id."""
    read = lines.select(F.from_json("line", _WIRE).alias("m"), "line").select("m.*", "line")
    bad = F.raise_error(F.concat(F.lit("bad message: "), F.col("line")))
    read = read.withColumn("type", F.when(F.col("type").isin(*FIELDS), F.col("type")).otherwise(bad)).withColumn(HISTORY, F.coalesce(HISTORY, F.lit(history)))
    own = ["type", HISTORY, "node_id", "count", "message"]
    has_events = F.col("type").isin("events", "push")
    ids = read.where(~has_events).select(*own, F.explode_outer("ids").alias("id"))
    none = {"payload_json": F.lit(None).cast("string"), "parents": F.lit(None).cast("array<string>"), "value": F.lit(None).cast("string")}
    only = F.regexp_extract("line", r'(?s)"events"\s*:\s*\[\s*(.*\S)\s*\]\s*\}\s*$', 1)
    exact = F.when((F.size("events") == 1) & (only != ""), F.array(only)).otherwise(F.col("events"))
    each = read.where(has_events).select(*own, F.explode_outer(exact).alias("value"))
    empty = each.where("value IS NULL").select(*own, F.lit(None).cast("string").alias("id"))
    full = parse_lines(each.where("value IS NOT NULL"), True, F.col(HISTORY), keep=("type", "node_id", "count", "message", "value"))
    found = full.select(*own, "id", "payload_json", "parents", "value")
    return ids.unionByName(empty).withColumns(none).unionByName(found)


def ids_in(parsed: DataFrame) -> DataFrame:
    """The ids of a parsed have or want: history_id, id."""
    return parsed.where("id IS NOT NULL").select(HISTORY, "id")


def events_in(parsed: DataFrame) -> DataFrame:
    """The events of parsed messages, with the columns of a history."""
    return parse_lines(parsed.where("value IS NOT NULL").select(HISTORY, "value"), True, F.col(HISTORY))
