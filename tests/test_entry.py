"""Every history query that has SQL gives the same rows as DuckDB does (a few of each kind; the driver runs all)."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import ROOT, SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["payload_hash", "event_ids", "frontier", "missing_ancestors", "depth", "noop_elim_chain", "noop_elim_dag", "cone_merge", "kv_state", "kv_after_merge", "log_state", "two_phase_set", "snapshot_recover", "wal_roundtrip", "wal_bad_lines", "message_roundtrip", "retract_counter"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def two_parents(duck):
    """What is above each event, by walking."""
    ids = [r[0] for r in duck.sql("SELECT event_id FROM events ORDER BY event_id").fetchall()]
    up = {}
    for i in ids:  # parents have smaller ids
        parents = {(i - 1) // 4, (i - 1) // 3} if i else set()
        up[i] = parents.union(*(up[p] for p in parents))
    return up


def test_ancestors_of_every_event(spark, duck):
    up = two_parents(duck)
    want = {(f"{i:012d}", f"{p:012d}") for i, above in up.items() for p in above}
    got = [tuple(r) for r in entry.queries()["ancestors"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted(got) == sorted(duck.sql(entry.oracle_sql()["ancestors"]).fetchall())


def test_pairs_of_every_event(spark, duck):
    up = two_parents(duck)
    for name, judge in (("precedes", lambda a, b: a in up[b]), ("concurrent", lambda a, b: a != b and a not in up[b] and b not in up[a])):
        want = sorted((f"{i // 10:012d}", f"{i:012d}", judge(i // 10, i)) for i in up if i > 0)
        assert sorted(tuple(r) for r in entry.queries()[name](spark, SF).collect()) == want
        assert sorted(duck.sql(entry.oracle_sql()[name]).fetchall()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_a_session_and_without_the_optional_part():
    code = "import sys; sys.modules['antecede.llm'] = None; import __spark_entry__ as e; assert 'kv_state' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    # a missing subpackage, as the entry sees it
    code = code.replace("sys.modules['antecede.llm'] = None", "import importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name.startswith('antecede.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\n")
    code = code.replace("; import __spark_entry__", "\nimport __spark_entry__").replace("import sys; ", "import sys\n").replace("\n; ", "\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
