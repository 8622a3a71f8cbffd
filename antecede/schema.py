"""The canonical history table and its constants.

One row is one event of one history. ``id`` is authoritative: after a reduction it is kept although the parents
changed, so it is never computed again on load. ``parents`` is sorted and free of duplicates.
"""

from __future__ import annotations

from pyspark.sql import types as T

HISTORY = "history_id"
KEY = [HISTORY, "id"]
DATA, NOOP, GENESIS = "Data", "Noop", "Genesis"
COLUMNS = [HISTORY, "id", "tag", "kind", "payload_json", "parents"]

EVENTS = T.StructType(
    [
        T.StructField(HISTORY, T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("kind", T.StringType(), True),
        T.StructField("payload_json", T.StringType(), False),
        T.StructField("parents", T.ArrayType(T.StringType(), False), False),
    ]
)

#: sha256 of nothing, and the id of the event that starts every history.
NO_PARENTS_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
GENESIS_ID = "e2991b0a092bef9538735b87e6a71c607a765336c1da69e2113f1cf01f41a680"
