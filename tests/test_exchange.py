from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from antecede.exchange import Connection, ProtocolError, answer, call, converged, push_to, run, talk
from antecede.functions.identity import data, frame, genesis
from antecede.kernel import Node
from antecede.operators.messages import FIELDS, events_in, ids_in, messages, note, parse_messages
from antecede.plans.steps import new_path
from antecede.schema import GENESIS_ID, KEY
from antecede.sources.wal import FileStore, MemoryStore, to_lines
from tests.test_durability import chain, ids


def link(spark):
    path = new_path(spark, "link")
    return Connection(spark, path, "A", "B"), Connection(spark, path, "B", "A")


def test_messages_of_every_type(spark):
    events = frame(spark, [*chain(4), data("set", {"key": 'é"\\]', "val": [1.10, 1e300, None]}, [GENESIS_ID])])
    for kind, field in FIELDS.items():
        if field == "events":
            back = parse_messages(messages(kind, events))
            assert events_in(back).exceptAll(events).isEmpty() and events.exceptAll(events_in(back)).isEmpty()
        elif field == "ids":
            lines = messages(kind, events, per_line=2)
            assert lines.count() > 1 and ids(ids_in(parse_messages(lines))) == ids(events)
        else:
            said = 7 if field == "count" else 'é "y"'
            row = parse_messages(spark.createDataFrame([(note(kind, said),)], "line string")).first()
            assert row["type"] == kind and (field is None or row[field] == said)
    for kind in ("have", "events"):
        empty = parse_messages(messages(kind, events.limit(0)))
        assert [r["type"] for r in empty.collect()] == [kind] and ids_in(empty).isEmpty() and events_in(empty).isEmpty()
    other = spark.createDataFrame([('{"type":"want","ids":["b","a"]}',)], "line string")
    assert ids(ids_in(parse_messages(other, "h"))) == [("h", "a"), ("h", "b")]
    lines = [r["value"] for r in to_lines(frame(spark, chain(4))).collect()]
    several = spark.createDataFrame([('{"type": "events", "events": [' + ", ".join(lines) + "]}",)], "line string")
    assert events_in(parse_messages(several)).exceptAll(frame(spark, chain(4))).isEmpty() and parse_messages(several).count() == 5
    for line in ('{"type":"shout"}', "no message"):
        with pytest.raises(Exception, match="bad message"):
            parse_messages(spark.createDataFrame([(line,)], "line string")).collect()


def test_dialogues(spark):
    a, b = Node(spark, "A"), Node(spark, "B")
    mine, theirs = chain(3), [data("increment", n, [GENESIS_ID]) for n in (5, 6)]
    a.batch_append(mine[1:])
    b.batch_append(theirs)
    la, lb = link(spark)
    left = a.history_size() - 1
    stats = talk(call(a, la), answer(b, lb))
    assert [(s.peer_id, s.sent, s.received) for s in stats] == [("B", left, 2), ("A", 2, left)]
    assert converged(a, b) and a.state("counter").collect() == b.state("counter").collect()
    more = frame(spark, [data("increment", 9, [GENESIS_ID])])
    la, lb = link(spark)
    stats = talk(push_to(a, more, la), answer(b, lb))
    assert [(s.sent, s.received) for s in stats] == [(1, 0), (0, 1)] and not converged(a, b)
    assert b.events.join(more.select(*KEY), KEY, "left_semi").count() == 1


def test_what_is_not_due_is_an_error(spark):
    la, lb = link(spark)
    la.note("bye")
    with pytest.raises(ProtocolError, match="expected hello, got bye"):
        run(answer(Node(spark, "B"), lb), lb, wait=5)
    with pytest.raises(ProtocolError, match="expected hello"):  # the other side reads the error
        next(la.receive("hello_ack"))
    with pytest.raises(ProtocolError, match="closed"):
        next(la.receive("hello_ack"))
    la, lb = link(spark)
    with pytest.raises(TimeoutError):
        run(answer(Node(spark, "B"), lb), lb, wait=0.3)


def test_numbers_of_bad_lines(spark):
    store = FileStore(spark, new_path(spark, "wal"))
    assert store.bad_lines().isEmpty() and store.in_order().isEmpty()
    good = [r["value"] for r in to_lines(frame(spark, chain(3))).collect()]
    for lines in ([good[0], "", "oops", good[1]], good[2:], ["{}", good[3]]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(store.path)
    assert sorted((r["line_number"], r["value"]) for r in store.bad_lines().collect()) == [(1, "{}"), (3, "oops")]


def test_order_of_arrival_in_a_store_without_lines(spark):
    store, rows = MemoryStore(spark), chain(5)
    assert store.in_order().isEmpty()
    for part in (rows[3:], [genesis(), *rows[2:4]], rows):
        store.append(spark.createDataFrame(part, frame(spark, rows).schema).coalesce(1))
    order = [r["id"] for r in store.in_order().orderBy("ingest_seq").collect()]
    assert order == [r[1] for r in (*rows[3:], rows[0], rows[2], rows[1])]
    assert len(store) == 6 and store.load_all().select(F.count_distinct("id")).first()[0] == 6


def test_command_line(spark, capsys):
    from antecede.cli import main

    logs, shared = [new_path(spark, "wal"), new_path(spark, "wal")], new_path(spark, "link")
    for log, amount in zip(logs, (3, 4), strict=True):
        assert main(["--log", log, "--append", str(amount), "--kind", "increment"]) == 0
    other = Node(spark, "other")
    other.append(FileStore(spark, logs[1]).load_all())
    link_ = Connection(spark, shared, "listener", "caller")
    # all that a listener says is there before the call
    link_.note("hello_ack", "other")
    link_.send(messages("want", FileStore(spark, logs[0]).load_all().where("tag = 'Data'")))
    link_.note("events_ack", 1)
    link_.send(messages("events", other.events))
    assert main(["--log", logs[0], "--call", shared, "--state", "counter"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert "sync with other: sent=1, received=2" in out and json.loads(out[-1])["total"] == 7
    assert FileStore(spark, logs[0]).load_all().count() == 3
    assert main(["--log", logs[0], "--state", "counter"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["total"] == 7
