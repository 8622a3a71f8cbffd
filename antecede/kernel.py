"""Stateful fronts over the operators: a kernel with one history, a node that merges, and both with a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import data, frame, genesis, noop
from .operators.dag import frontier, insert
from .operators.project import project
from .operators.reduce import ReduceConfig, Reduced, Stats, reduce
from .operators.replicate import MERGE, SyncStats, diff, merge_histories, sync
from .plans.steps import Step
from .schema import KEY
from .sources.snapshot import Snapshot, read_snapshot, recover, replay, wal_tail, write_snapshot
from .sources.wal import Store


class Kernel:
    """A history that is kept in normal form. Appends come in batches: each is one insert and one reduction."""

    def __init__(self, spark: SparkSession, config: ReduceConfig | None = None, history: str = "main"):
        self.spark, self.config, self.history = spark, config or ReduceConfig(), history
        self.events = frame(spark, [genesis(history)])
        self.stats = Stats()
        self.version = 0
        self._states: dict[str, tuple[int, DataFrame]] = {}

    def append(self, events: DataFrame | list[tuple]) -> Reduced:
        """Inserts a batch and reduces once."""
        new = frame(self.spark, events) if isinstance(events, list) else events
        out = reduce(insert(self.events, new), self.config, before=self.events)
        self._accept(out)
        return out

    def _accept(self, out: Reduced) -> None:
        self.events = Step(out.events, "history").df
        self.stats = self.stats.added(out.stats)
        self.version += 1

    def tips(self) -> list[str]:
        """The frontier; small in any history that is appended to, since each append joins it."""
        return sorted(r["id"] for r in self.frontier().collect())

    def new_event(self, kind: str, value) -> tuple:
        return data(kind, value, self.tips(), self.history)

    def new_noop(self) -> tuple:
        return noop(self.tips(), self.history)

    def frontier(self) -> DataFrame:
        return frontier(self.events)

    def history_size(self) -> int:
        return self.events.count()

    def state(self, projection: str) -> DataFrame:
        return project(self.events, projection)

    def cached_state(self, projection: str) -> DataFrame:
        """The state, worked out once for each version of the history."""
        if self._states.get(projection, (None,))[0] != self.version:
            self._states[projection] = (self.version, Step(self.state(projection), "state").df)
        return self._states[projection][1]

    def invalidate(self) -> None:
        self._states.clear()


class Node(Kernel):
    """A replica."""

    def __init__(self, spark: SparkSession, name: str, config: ReduceConfig | None = None, history: str = "main"):
        super().__init__(spark, config, history)
        self.name = name

    def batch_append(self, events: DataFrame | list[tuple]) -> Reduced:
        return self.append(events)

    def sync_with(self, other: Node) -> Reduced:
        """Takes in what the other has; called on both sides, both agree."""
        out = merge_histories(self.events, other.events, MERGE)
        self._accept(out)
        return out

    def exchange(self, server: Node) -> SyncStats:
        """Both sides take in what they lack."""
        mine, theirs, stats = sync(self.events, server.events, server.name)
        self.events, server.events = Step(mine, "history").df, Step(theirs, "history").df
        self.version += 1
        server.version += 1
        return stats


class DurableKernel(Kernel):
    """Writes every batch to a store before it is applied, and a snapshot after every so many events."""

    def __init__(self, spark: SparkSession, store: Store, snapshots: str, interval: int = 0, config: ReduceConfig | None = None, history: str = "main"):
        super().__init__(spark, config, history)
        self.store, self.snapshots, self.interval = store, snapshots, interval
        self.event_count = self.events_since_snapshot = self.snapshot_seq = 0

    def append(self, events: DataFrame | list[tuple]) -> Reduced:
        new = frame(self.spark, events) if isinstance(events, list) else events
        self.store.append(new)
        n = new.count()
        self.event_count += n
        self.events_since_snapshot += n
        out = super().append(new)
        if self.interval and self.events_since_snapshot >= self.interval:
            self.take_snapshot()
        return out

    def take_snapshot(self) -> Snapshot:
        self.snapshot_seq += 1
        self.events_since_snapshot = 0
        return write_snapshot(self.events, self.snapshots, self.snapshot_seq, self.event_count)

    def latest_snapshot(self) -> Snapshot | None:
        return read_snapshot(self.spark, self.snapshots, self.snapshot_seq) if self.snapshot_seq else None

    def replay_from_store(self) -> int:
        out, n = replay(self.store, self.config)
        self._accept(out)
        self.event_count = n
        return n

    def restore(self, snapshot: Snapshot) -> int:
        """The snapshot and the log after it; how many events were replayed."""
        out, n = recover(snapshot, self.store, self.config)
        self._accept(out)
        self.snapshot_seq, self.event_count = snapshot.seq, snapshot.source_event_count + n
        return n

    def tail(self, snapshot: Snapshot) -> DataFrame:
        return wal_tail(snapshot, self.store.load_all())

    def diff_from(self, remote_ids: DataFrame) -> DataFrame:
        return diff(self.events, remote_ids)


def audit(kernel: Kernel) -> DataFrame:
    """Ids of the history in order, for comparisons between replicas."""
    return kernel.events.select(*KEY).orderBy(*(F.col(k) for k in KEY))
