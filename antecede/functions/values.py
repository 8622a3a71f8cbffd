"""Reading JSON values: a key that is there with null is not a missing key, and types are not coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_of(payload_json: Column | str) -> Column:
    """The value of a domain event as VARIANT; null for no-ops and the first event."""
    return F.try_variant_get(F.parse_json(F.col(payload_json) if isinstance(payload_json, str) else payload_json), "$.Data.value", "variant")


def get(value: Column, key: str) -> Column:
    """A key of an object: SQL null if it is missing or the value is no object, a VARIANT null if it is null."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def as_str(value: Column) -> Column:
    """The string, only where the value is one."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_i64(value: Column) -> Column:
    """The integer, only where the value is one that fits 64 bits; null for floats, bools and strings."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def contains(ids: Column, id_: Column) -> Column:
    return F.array_contains(ids, id_)


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))
