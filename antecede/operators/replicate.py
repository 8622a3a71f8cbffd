"""Merging and synchronizing replicas: joins on ids, then one reduction."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as _fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HISTORY, KEY
from .dag import union
from .messages import messages as messages, parse_messages as parse_messages
from .reduce import ReduceConfig, Reduced, reduce

#: Merging checks that the result is closed.
MERGE = ReduceConfig(enable_closure_check=True)


def merge_histories(a: DataFrame, b: DataFrame, config: ReduceConfig = MERGE) -> Reduced:
    """The normal form of the union; commutative, associative and idempotent."""
    return reduce(union(a, b), config, before=a)


def diff(local: DataFrame, remote_ids: DataFrame) -> DataFrame:
    """Events the remote side lacks."""
    return local.join(remote_ids.select(*KEY), KEY, "left_anti")


def want(local: DataFrame, have: DataFrame) -> DataFrame:
    """Ids offered by ``have(history_id, id)`` that are not here."""
    return have.select(*KEY).distinct().join(local.select(*KEY), KEY, "left_anti")


def serve(local: DataFrame, wanted: DataFrame) -> DataFrame:
    """The events asked for."""
    return local.join(wanted.select(*KEY), KEY, "left_semi")


def known(local: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that both sides have."""
    return ids.select(*KEY).distinct().join(local.select(*KEY), KEY, "left_semi")


@dataclass(frozen=True)
class SyncStats:
    peer_id: str
    sent: int
    received: int

    def __str__(self) -> str:
        return f"sync with {self.peer_id}: sent={self.sent}, received={self.received}"


def sync(client: DataFrame, server: DataFrame, peer_id: str = "peer", config: ReduceConfig | None = None) -> tuple[DataFrame, DataFrame, SyncStats]:
    """Both replicas after an exchange: what each lacked is sent, and each reduces once. The way back offers what
    the server holds after its reduction that the client did not name."""
    have = client.select(*KEY)
    sent = serve(client, want(server, have))
    new_server = reduce(union(server, sent), config).events
    received = diff(new_server, have)
    new_client = reduce(union(client, received), config).events
    return new_client, new_server, SyncStats(peer_id, sent.count(), received.count())


def push(server: DataFrame, events: DataFrame, config: ReduceConfig | None = None) -> Reduced:
    """The server after events were sent to it unasked."""
    return reduce(union(server, events), config, before=server)


def gossip(replicas: list[DataFrame], config: ReduceConfig = MERGE) -> Reduced:
    """What all replicas come to when each has heard of all others: one union, one reduction."""
    return reduce(_fold(union, replicas), config, before=replicas[0])


def as_replicas(events: DataFrame, replica: str) -> DataFrame:
    return events.withColumn("replica", F.lit(replica))


def stats_frame(spark, stats: SyncStats) -> DataFrame:
    return spark.createDataFrame([(stats.peer_id, stats.sent, stats.received)], "peer_id string, sent long, received long")
