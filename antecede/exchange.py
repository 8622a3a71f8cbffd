"""Two nodes that sync by messages: a line connection over a shared folder, and the two sides of the dialogue.

A side is a generator that stops where it waits for the other: ``talk`` runs several in one process, ``run`` one of
them until it ends or has waited too long. The events go from executors to files and back, never through the driver.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Generator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Node
from .operators.messages import FIELDS, events_in, ids_in, messages, note, parse_messages
from .operators.replicate import SyncStats, diff, serve, want
from .plans.steps import Step
from .schema import KEY

Side = Generator[None, None, SyncStats]


class ProtocolError(RuntimeError):
    """The other side sent something else than was due, an error, or has closed."""


class Connection:
    """One end: messages as folders of text lines, numbered, in a folder for each direction. A message counts once
    its marker is written; a closed end has a marker too."""

    def __init__(self, spark: SparkSession, path: str, own: str, other: str):
        self.spark, self.own, self.other = spark, f"{path}/{own}", f"{path}/{other}"
        self.sent = self.received = 0

    def _at(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, name: str) -> None:
        target, fs = self._at(name)
        fs.create(target, True).close()

    def _marked(self, name: str) -> bool:
        target, fs = self._at(name)
        return fs.exists(target)

    def send(self, lines: DataFrame) -> None:
        lines.write.text(f"{self.own}/{self.sent}")
        self._mark(f"{self.own}/{self.sent}.sent")
        self.sent += 1

    def note(self, kind: str, value: str | int | None = None) -> None:
        """A message without rows, written without a job."""
        target, fs = self._at(f"{self.own}/{self.sent}/line")
        out = fs.create(target, True)
        out.write(note(kind, value).encode())
        out.close()
        self._mark(f"{self.own}/{self.sent}.sent")
        self.sent += 1

    def close(self) -> None:
        self._mark(f"{self.own}/closed")

    def receive(self, *due: str, history: str = "main") -> Generator[None, None, tuple[str, DataFrame]]:
        """The next message, once it is there, and its type, which must be one of those due."""
        while not self._marked(f"{self.other}/{self.received}.sent"):
            if self._marked(f"{self.other}/closed") and not self._marked(f"{self.other}/{self.received}.sent"):
                raise ProtocolError("the other side has closed")
            yield
        lines = self.spark.read.schema("line string").text(f"{self.other}/{self.received}")
        self.received += 1
        parsed = parse_messages(lines, history)
        if any(FIELDS[kind] in ("ids", "events") for kind in due):
            parsed = Step(parsed, "message").df
        kinds = sorted(r["type"] for r in parsed.select("type").distinct().collect())  # as many as there are types
        if kinds == ["error"]:
            raise ProtocolError(parsed.first()["message"])
        if len(kinds) != 1 or kinds[0] not in due:
            text = f"expected {' or '.join(due)}, got {', '.join(kinds) or 'nothing'}"
            self.note("error", text)
            raise ProtocolError(text)
        return kinds[0], parsed


def _taken(node: Node, parsed: DataFrame) -> int:
    """Takes the events of a message into the node; how many came."""
    came = Step(events_in(parsed), "came").df
    n = came.count()
    if n:
        node.batch_append(came)
    return n


def _acknowledged(parsed: DataFrame, sent: int) -> None:
    count = parsed.first()["count"]
    if count != sent:
        warnings.warn(f"{sent} events were sent, {count} acknowledged", stacklevel=2)


def call(node: Node, link: Connection) -> Side:
    """The side that begins: offers its ids, sends what the other wants, takes in what it lacks itself."""
    try:
        link.note("hello", node.name)
        _, hello = yield from link.receive("hello_ack")
        mine = node.events
        link.send(messages("have", mine))
        _, wanted = yield from link.receive("want", history=node.history)
        sent = Step(serve(mine, ids_in(wanted)), "sent").df
        n = sent.count()
        link.send(messages("events", sent))
        _, ack = yield from link.receive("events_ack")
        _acknowledged(ack, n)
        _, back = yield from link.receive("events", history=node.history)
        received = _taken(node, back)
        link.note("events_ack", received)
        link.note("bye")
        return SyncStats(hello.first()["node_id"], n, received)
    finally:
        link.close()


def push_to(node: Node, events: DataFrame, link: Connection) -> Side:
    """Sends events unasked."""
    try:
        link.note("hello", node.name)
        _, hello = yield from link.receive("hello_ack")
        n = events.count()
        link.send(messages("push", events))
        _, ack = yield from link.receive("push_ack")
        _acknowledged(ack, n)
        link.note("bye")
        return SyncStats(hello.first()["node_id"], n, 0)
    finally:
        link.close()


def answer(node: Node, link: Connection) -> Side:
    """The side that is called: one dialogue, a sync or a push."""
    try:
        _, hello = yield from link.receive("hello")
        peer = hello.first()["node_id"]
        link.note("hello_ack", node.name)
        kind, first = yield from link.receive("have", "push", history=node.history)
        if kind == "push":
            received, sent = _taken(node, first), 0
            link.note("push_ack", received)
        else:
            have = ids_in(first)
            link.send(messages("want", want(node.events, have)))
            _, came = yield from link.receive("events", history=node.history)
            received = _taken(node, came)
            link.note("events_ack", received)
            back = Step(diff(node.events, have.select(*KEY)), "back").df
            sent = back.count()
            link.send(messages("events", back))
            _, ack = yield from link.receive("events_ack")
            _acknowledged(ack, sent)
        yield from link.receive("bye")
        return SyncStats(peer, sent, received)
    finally:
        link.close()


def talk(*sides: Side) -> list[SyncStats]:
    """Runs sides in turn until all have ended; what each returned."""
    open_, out = dict(enumerate(sides)), {}
    while open_:
        for k, side in list(open_.items()):
            try:
                next(side)
            except StopIteration as end:
                out[k] = end.value
                del open_[k]
    return [out[k] for k in sorted(out)]


def run(side: Side, link: Connection, wait: float = 60.0, pause: float = 0.2) -> SyncStats:
    """Runs one side, in a process of its own; waiting for a message longer than ``wait`` seconds is an error."""
    since, seen = time.monotonic(), link.received
    while True:
        try:
            next(side)
        except StopIteration as end:
            return end.value
        if link.received != seen:
            since, seen = time.monotonic(), link.received
        if time.monotonic() - since > wait:
            side.close()
            raise TimeoutError("the other side does not answer")
        time.sleep(pause)


def converged(a: Node, b: Node) -> bool:
    """Whether both hold the same ids."""
    ids = a.events.select(*KEY, F.lit(1).alias("n")).unionByName(b.events.select(*KEY, F.lit(-1).alias("n")))
    return ids.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n != 0").isEmpty()
