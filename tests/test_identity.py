from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from antecede.functions.identity import audit_ids, canonical, canonical_json, compute_id, data, data_payload, frame, genesis, noop, with_id
from antecede.functions.values import as_i64, as_str, get, value_of
from antecede.schema import GENESIS_ID

VALUES = st.one_of(st.integers(-(2**63), 2**63 - 1), st.booleans(), st.text("abcdefgh", min_size=1, max_size=8), st.dictionaries(st.text("abc", min_size=1, max_size=6), st.integers(-9, 9), max_size=3))


def test_golden_vectors():
    g = genesis()
    assert g[1] == GENESIS_ID
    n = noop([g[1]])
    assert n[1] == "1bfe10bb3ef7930ec5fac10c2fa93b0ee7c9bc9e666497b33961ee2edc1e437d"
    assert data("increment", 10, [g[1]])[1] == "65c345982e42df59821c1fb955712122624b264e3029f2fa3802817fa9c9c108"
    assert data("set", {"key": "x", "val": 1}, [g[1]])[1] == "4a0591f11a460e20a1230d175c01a8331edd7e9273ff60db21c22af29fbbbb1d"
    assert data("x", 1, [n[1]])[1] == "7168f56d5f4cd1fd325cf1a8b85ff24b6dbf39007c60565667d80e019daa68e2"


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(["set", "increment", "log", "op"]), VALUES, st.lists(st.sampled_from(["p0", "p1", "p2"]), max_size=4))
def test_ids_do_not_depend_on_the_order_of_parents(kind, value, parents):
    assert data(kind, value, parents) == data(kind, value, parents[::-1])
    assert data(kind, value, parents)[1] != data(kind + "x", value, parents)[1]


def test_columns_hash_as_the_builders(spark):
    events = frame(spark, [genesis(), data("set", {"key": "é\"", "val": None}, [GENESIS_ID]), data("a\"b\\c", [1.5, "x"], ["b", "a"]), noop(["z"])])
    assert events.where(compute_id("payload_json", "parents") != F.col("id")).isEmpty()
    assert audit_ids(events).isEmpty()
    again = with_id(events.withColumn("parents", F.concat("parents", F.reverse("parents"))))
    assert again.exceptAll(events.select(*again.columns)).isEmpty()
    quoted = spark.createDataFrame([("a\"b\\c", "[1.5,\"x\"]")], "k string, v string").select(data_payload(F.col("k"), F.col("v")).alias("p")).first()["p"]
    assert quoted == canonical_json({"Data": {"kind": "a\"b\\c", "value": [1.5, "x"]}})


def test_canonical_form(spark):
    rows = spark.createDataFrame([('{"b": 1.0, "a": "\\u00e9"}',), (None,)], "t string").select(canonical("t").alias("t")).collect()
    assert [r["t"] for r in rows] == ['{"a":"é","b":1.0}', None]


@pytest.mark.parametrize(
    ("value", "number", "text", "has_val"),
    [(5, 5, None, False), (5.0, None, None, False), (2**63, None, None, False), ("s", None, "s", False), (True, None, None, False), ({"val": None}, None, None, True), ({"x": 1}, None, None, False), ([1], None, None, False)],
)
def test_values_keep_their_types(spark, value, number, text, has_val):
    v = value_of("payload_json")
    row = frame(spark, [data("k", value, [])]).select(as_i64(v).alias("n"), as_str(v).alias("s"), get(v, "val").isNotNull().alias("h")).first()
    assert (row["n"], row["s"], row["h"]) == (number, text, has_val)
