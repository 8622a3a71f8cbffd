"""Identity of events: pure column functions, and the canonical form of payloads.

id = sha256hex( sha256hex(payload_json) + sha256hex(sorted parent ids, concatenated) )
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COLUMNS, DATA, EVENTS, GENESIS, GENESIS_ID, HISTORY, NOOP


# what runs in Python workers travels with its code, so workers need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def canonical_json(value) -> str:
    """Compact, keys sorted, non-ASCII as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Canonical form of JSON texts as they come from outside. Spark's own writer rewrites numbers, which would
    change hashes, so only this step of the readers leaves the JVM."""
    return pd.Series([canonical_json(json.loads(t)) if isinstance(t, str) else None for t in text], dtype=object)


def data_payload(kind: Column, value_json: Column) -> Column:
    """Payload of a domain event from its kind and a canonical JSON value."""
    name = F.regexp_replace(F.regexp_replace(kind, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('{"Data":{"kind":"'), name, F.lit('","value":'), value_json, F.lit("}}"))


def hash_payload(payload_json: Column | str) -> Column:
    return F.sha2(payload_json, 256)


def hash_parents(parents: Column | str) -> Column:
    return F.sha2(F.array_join(F.array_sort(parents), ""), 256)


def compute_id_from_hashes(payload_hash: Column, parents_hash: Column) -> Column:
    return F.sha2(F.concat(payload_hash, parents_hash), 256)


def compute_id(payload_json: Column | str, parents: Column | str) -> Column:
    return compute_id_from_hashes(hash_payload(payload_json), hash_parents(parents))


def normal_parents(parents: Column | str) -> Column:
    return F.array_sort(F.array_distinct(parents))


def with_id(df: DataFrame) -> DataFrame:
    """Hashed ids for rows with payload_json and parents."""
    return df.withColumn("parents", normal_parents("parents")).withColumn("id", compute_id("payload_json", "parents"))


def audit_ids(events: DataFrame) -> DataFrame:
    """Rows whose stored id is not the hash of payload and parents (as after a reduction): history_id, id, hashed."""
    hashed = events.select(HISTORY, "id", compute_id("payload_json", "parents").alias("hashed"))
    return hashed.where("id != hashed")


def is_noop(tag: Column | str = "tag") -> Column:
    return (F.col(tag) if isinstance(tag, str) else tag) == NOOP


def rows(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, EVENTS)


def _event(history: str, tag: str, kind: str | None, payload_json: str, parents: list[str]) -> tuple:
    import hashlib

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    own = sorted(set(parents))
    return (history, sha(sha(payload_json) + sha("".join(own))), tag, kind, payload_json, own)


def genesis(history: str = "main") -> tuple:
    """The first event of a history, as a row."""
    found = _event(history, GENESIS, None, '"Genesis"', [])
    assert found[1] == GENESIS_ID
    return found


def data(kind: str, value, parents: list[str], history: str = "main") -> tuple:
    return _event(history, DATA, kind, canonical_json({"Data": {"kind": kind, "value": value}}), parents)


def noop(parents: list[str], history: str = "main") -> tuple:
    return _event(history, NOOP, None, '"Noop"', parents)


def frame(spark: SparkSession, events: list[tuple]) -> DataFrame:
    """A small history given as rows of the builders above; the first of equal ids counts."""
    seen: dict[tuple, tuple] = {}
    for e in events:
        seen.setdefault((e[0], e[1]), e)
    return rows(spark, list(seen.values())).select(*COLUMNS)
