from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from antecede import sql
from antecede.functions.identity import data, frame, genesis, noop
from antecede.kernel import DurableKernel, Kernel, Node
from antecede.operators.project import project
from antecede.plans.steps import new_path, numbered
from antecede.schema import GENESIS_ID, KEY
from antecede.sources.snapshot import from_json, read_snapshot, to_json, write_snapshot
from antecede.sources.wal import FileStore, MemoryStore, parse_lines, to_lines
from antecede.streaming.ingest import HistoryTable, deduplicated, read_log


def chain(n, kind="increment"):
    out = [genesis()]
    for i in range(n):
        out.append(data(kind, i, [out[-1][1]]) if i % 3 else noop([out[-1][1]]))
    return out


def ids(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


def test_log_round_trip_and_errors(spark):
    events = frame(spark, [*chain(6), data("set", {"key": "é\"\\", "val": [1.0, None]}, [GENESIS_ID])])
    back = parse_lines(to_lines(events))
    assert back.exceptAll(events).isEmpty() and events.exceptAll(back).isEmpty()
    bad = spark.createDataFrame([('{"id":"x","parents":[],"payload":"Noop"}',), ("  ",), ("not json",)], "value string")
    with pytest.raises(Exception, match="bad line"):
        parse_lines(bad).collect()
    assert sorted(str(r["_corrupt"]) for r in parse_lines(bad, strict=False).collect()) == ["None", "not json"]
    other = spark.createDataFrame([('{"payload": {"Data": {"value": {"b": 1, "a": 2}, "kind": "k"}}, "parents": ["b", "a", "b"], "id": "x"}',)], "value string")
    row = parse_lines(other, hash_safe=True).first()
    assert row["payload_json"] == '{"Data":{"kind":"k","value":{"a":2,"b":1}}}' and row["parents"] == ["a", "b"]


def test_stores(spark):
    events = frame(spark, chain(4))
    for store in (MemoryStore(spark), FileStore(spark, new_path(spark, "wal"))):
        assert store.is_empty() and len(store) == 0
        store.append(events)
        store.append(events.limit(2))
        assert ids(store.load_all()) == ids(events) == ids(store.known_ids())
    assert len(store) == 7  # lines, with the repeated ones


def test_snapshots(spark):
    events = frame(spark, chain(4))
    snap = write_snapshot(events, new_path(spark, "snap"), 3, 9, 1000)
    assert (snap.seq, snap.timestamp, snap.source_event_count) == (3, 1000, 9) and ids(snap.events) == ids(events)
    back = from_json(to_json(snap))
    assert back.source_event_count == 9 and back.events.exceptAll(events).isEmpty()


def test_durable_kernel_recovers(spark):
    store, path = FileStore(spark, new_path(spark, "wal")), new_path(spark, "snapshots")
    kernel = DurableKernel(spark, store, path, interval=5)
    rows = chain(9)
    kernel.append(rows[:6])
    assert kernel.snapshot_seq == 1
    kernel.append(rows[6:])
    total = kernel.state("counter").first()["total"]
    again = DurableKernel(spark, store, path)
    # no-ops eliminated before the snapshot are replayed too
    assert again.restore(read_snapshot(spark, path, 1)) == len(rows[6:]) + 2
    assert again.state("counter").first()["total"] == total and ids(again.events) == ids(kernel.events)
    fresh = DurableKernel(spark, store, path)
    assert fresh.replay_from_store() == len(rows) and ids(fresh.events) == ids(kernel.events)
    assert fresh.diff_from(kernel.events).isEmpty()


def test_nodes_converge(spark):
    a, b = Node(spark, "A"), Node(spark, "B")
    a.batch_append([a.new_event("increment", 100)])
    a.batch_append([a.new_event("increment", 50)])
    b.batch_append([b.new_event("increment", 25)])
    b.batch_append([b.new_event("increment", 75)])
    a.sync_with(b)
    b.sync_with(a)
    assert a.state("counter").first()["total"] == b.state("counter").first()["total"] == 250
    assert len(a.tips()) == 2
    a.append([a.new_noop(), a.new_event("set", {"key": "k", "val": 1})])
    stats = a.exchange(b)
    assert (stats.sent, stats.received) == (1, 0) and ids(a.events) == ids(b.events)


def test_kernel_state_follows_versions(spark):
    k = Kernel(spark)
    k.append([k.new_event("set", {"key": "x", "val": 1})])
    assert k.cached_state("key_value").first()["val"] == "1"
    k.append([k.new_event("set", {"key": "x", "val": 2})])
    assert k.cached_state("key_value").first()["val"] == "2" and k.history_size() == 3
    k.append([k.new_noop()])
    assert k.stats.noops_eliminated == 1 and k.stats.events_after == 3


def test_stream_with_late_and_repeated_events(spark):
    rows, path = chain(11), new_path(spark, "log")
    for part in (rows[6:], rows[:6], rows[3:8]):
        to_lines(frame(spark, part)).coalesce(1).write.mode("append").text(path)
    table, deltas = HistoryTable(spark, projections=("counter", "key_value")), []
    table.subscribe(lambda n, delta: deltas.append((n, delta.count())))
    table.follow(read_log(spark, path, files_per_batch=1)).awaitTermination()
    assert ids(table.events()) == ids(frame(spark, rows)) and len(deltas) == 3
    assert table.state("counter").first()["total"] == project(frame(spark, rows), "counter").first()["total"]
    sink = deduplicated(read_log(spark, path)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    sink.awaitTermination()
    assert spark.table("once").count() == len(rows)


def test_sql_views_and_functions(spark):
    events = frame(spark, chain(5))
    names = sql.register_views(events, "h")
    assert "h_counter" in names and spark.sql("SELECT total FROM h_counter").first()["total"] == 7
    sql.register_functions(spark)
    got = spark.sql("SELECT id, depth, pos FROM topo_order(TABLE(SELECT id, parents, history_id FROM h_events) PARTITION BY history_id) ORDER BY pos").collect()
    assert [r["id"] for r in got] == [e[1] for e in chain(5)]
    last = chain(5)[-1][1]
    up = spark.sql(f"SELECT * FROM ancestors(TABLE(SELECT id, parents, id = '{last}' AS asked FROM h_events) WITH SINGLE PARTITION)")
    assert up.count() == 5


def test_numbered(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("x"))
    assert [r["x"] for r in numbered(df, "x").orderBy("pos").collect()] == list(range(1000))


def test_messages(spark):
    from antecede.operators.replicate import messages, parse_messages

    events = frame(spark, chain(3))
    assert sorted(r["id"] for r in parse_messages(messages("have", events)).collect()) == sorted(r["id"] for r in events.collect())
    back = parse_messages(messages("events", events)).select("id", "payload_json", "parents")
    assert back.exceptAll(events.select("id", "payload_json", "parents")).isEmpty()


def test_stream_depth_waits_for_parents(spark):
    from antecede.streaming.stateful import PROVIDER, stream_depth
    from tests.test_histories import model_depth, random_dag

    from antecede.schema import EVENTS

    rows, path = random_dag(11), new_path(spark, "in")
    for part in (rows[1::2], rows[::2], rows[:10]):
        spark.createDataFrame(part, EVENTS).select("history_id", "id", "parents").coalesce(1).write.mode("append").parquet(path)
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema("history_id string, id string, parents array<string>").option("maxFilesPerTrigger", 1).parquet(path)
        stream_depth(stream).writeStream.format("memory").queryName("depths").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    got = [(r["history_id"], r["id"], r["depth"]) for r in spark.table("depths").collect()]
    assert len(got) == len(set(got)) and {(h, i): d for h, i, d in got} == model_depth(rows)


def test_a_stream_goes_on_after_a_restart(spark):
    """A table opened anew on the same path, also where a batch was cut short before its marker was written."""
    lines, path = new_path(spark, "lines"), new_path(spark, "stream")
    every = chain(9, "increment")
    for part in (every[:4], every[4:]):
        to_lines(frame(spark, part)).coalesce(1).write.mode("append").text(lines)
        HistoryTable(spark, path, ("counter",)).follow(read_log(spark, lines)).awaitTermination()
    again = HistoryTable(spark, path, ("counter",))
    assert again.batches == 2 and ids(again.events()) == ids(frame(spark, every))
    want = project(frame(spark, every), "counter").collect()
    assert again.state("counter").collect() == want
    fs = again._fs("finished/1")
    fs[1].delete(fs[0], False)
    cut = HistoryTable(spark, path, ("counter",))
    assert cut.batches == 1 and len(ids(cut.events())) == 4
    cut.take(frame(spark, every[4:]), 1)
    assert ids(cut.events()) == ids(frame(spark, every)) and cut.state("counter").collect() == want


def test_lines_with_odd_ids_and_fields(spark):
    odd = frame(spark, [genesis(), data("set", {"key": "k", "val": "]},{"}, [GENESIS_ID])])
    odd = odd.withColumn("id", F.concat("id", F.lit('"\\\n]'))).withColumn("parents", F.transform("parents", lambda p: F.concat(p, F.lit('",["'))))
    back = parse_lines(to_lines(odd))
    assert back.exceptAll(odd).isEmpty() and odd.exceptAll(back).isEmpty()
    more = spark.createDataFrame([('{"id":"x","parents":["p"],"payload":{"Data":{"kind":"k","value":1}},"note":{"a":"}"}}',)], "value string")
    row = parse_lines(more).first()
    assert row["payload_json"] == '{"Data":{"kind":"k","value":1}}' and row["parents"] == ["p"]


def test_order_of_arrival(spark):
    store, events = FileStore(spark, new_path(spark, "wal")), frame(spark, chain(6)).coalesce(1)
    for part in (events.where("tag = 'Noop'"), events, events.limit(2)):
        store.append(part)
    rows = store.in_order().orderBy("ingest_seq").collect()
    assert [r["ingest_seq"] for r in rows] == list(range(7)) and [r["tag"] for r in rows[:2]] == ["Noop", "Noop"]
    assert sorted(r["id"] for r in rows) == sorted(i for _, i in ids(events))
