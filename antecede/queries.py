"""The registered queries over the test tables, each with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo as examples
from .exchange import Connection, answer, call, push_to, talk
from .functions.identity import compute_id, data_payload, hash_parents, hash_payload
from .kernel import DurableKernel, Node
from .operators import dag, order, project, reduce, replicate
from .operators.cone import cone_hashes, isomorphic_groups, refreshed
from .operators.messages import events_in, messages, parse_messages
from .plans.steps import new_path
from .schema import GENESIS_ID, HISTORY, KEY
from .sources import builders as B
from .sources.snapshot import from_json, recover, replay, to_json, write_snapshot
from .sources.wal import FileStore, MemoryStore, parse_lines, to_lines
from .streaming.ingest import HistoryTable, read_log
from .streaming.stateful import PROVIDER, stream_depth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def _p(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 12, '0')"


# Common tables of the SQL: user chains, the tree, the graph with two parents, replicas.
_U = """u AS (SELECT CAST(user_id AS VARCHAR) AS history_id, event_id AS i, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""
_T = "t AS (SELECT event_id AS i, CASE WHEN event_id > 0 THEN (event_id - 1) // 4 END AS p FROM events)"
_G = """g AS (SELECT event_id AS i, (event_id - 1) // 4 AS p FROM events WHERE event_id > 0
  UNION SELECT event_id, (event_id - 1) // 3 FROM events WHERE event_id > 0)"""
_GD = "gd AS (SELECT i, max(d) AS d FROM (WITH RECURSIVE w(i, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT g.i, w.d + 1 FROM w JOIN g ON g.p = w.i) SELECT * FROM w) GROUP BY i)"
_R = "ra AS (SELECT * FROM t WHERE i % 3 <> 2), rb AS (SELECT * FROM t WHERE i % 3 <> 0 OR i = 0)"


# --- identity -----------------------------------------------------------------------------------------------


@query("""SELECT CAST(event_id AS BIGINT) AS event_id,
  sha256('{"Data":{"kind":"set","value":{"key":"' || event_type || '","val":' || json_extract_string(props, '$.k') || '}}}') AS payload_hash FROM events""")
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B._events(spark, sf_dir)
    return rows.select(F.col("i").alias("event_id"), hash_payload(B._set_payload(F.col("event_type"), F.col("k"))).alias("payload_hash"))


@query(f"""WITH {_G} SELECT {_p('i')} AS id, sha256(string_agg({_p('p')}, '' ORDER BY p)) AS parents_hash FROM g GROUP BY i
  UNION ALL SELECT {_p('0')}, sha256('')""")
def parents_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.two_parents(spark, sf_dir).select("id", hash_parents("parents").alias("parents_hash"))


@query(f"""WITH {_U}, c AS (SELECT history_id, list(CASE WHEN t = 'error' THEN '"Noop"' ELSE
  '{{"Data":{{"kind":"set","value":{{"key":"' || t || '","val":' || k || '}}}}}}' END ORDER BY seq) AS p FROM u GROUP BY history_id)
  SELECT history_id, list_reduce(list_prepend('{GENESIS_ID}', p), lambda a, x: sha256(sha256(x) || sha256(a))) AS tip FROM c""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed id of the last event of each user's chain, which depends on every event before it."""
    chain = B.user_chains(spark, sf_dir).groupBy(HISTORY).agg(F.array_sort(F.collect_list(F.struct("ts", "i", "payload_json"))).alias("c"))
    tip = F.aggregate("c", F.lit(GENESIS_ID), lambda before, x: compute_id(x["payload_json"], F.array(before)))
    return chain.select(HISTORY, tip.alias("tip"))


# --- sets and graph -----------------------------------------------------------------------------------------


@query(f"WITH {_T} SELECT {_p('i')} AS id FROM t WHERE i NOT IN (SELECT p FROM t WHERE p IS NOT NULL)")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.frontier(B.tree(spark, sf_dir)).select("id")


@query(f"WITH {_T} SELECT {_p('p')} AS parent, count(*) AS n_children, {_p('min(i)')} AS first_child, {_p('max(i)')} AS last_child FROM t WHERE p IS NOT NULL GROUP BY p")
def children_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.children(B.tree(spark, sf_dir)).select("parent", "n_children", F.array_min("children").alias("first_child"), F.array_max("children").alias("last_child"))


@query(f"WITH {_G} SELECT {_p('i')} AS child, {_p('p')} AS parent FROM g")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.edges(B.two_parents(spark, sf_dir)).select("child", "parent")


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id, CASE WHEN p IS NULL THEN '' ELSE {_p('p')} END AS parents FROM (SELECT * FROM ra UNION SELECT * FROM rb)")
def union_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return dag.union(a, b).select("id", F.array_join("parents", ",").alias("parents"))


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id FROM (SELECT i FROM ra INTERSECT SELECT i FROM rb)")
def known_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return replicate.known(a, b).select("id")


@query(f"WITH {_T}, {_R} SELECT DISTINCT {_p('p')} AS id FROM ra WHERE p IS NOT NULL AND p NOT IN (SELECT i FROM ra)")
def missing_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.missing_ancestors(B.replicas(spark, sf_dir)[0]).select("id")


@query(f"""WITH {_T}, {_R} SELECT 'ra' AS history, count(DISTINCT p) AS n_missing, count(DISTINCT p) = 0 AS is_closed FROM ra WHERE p NOT IN (SELECT i FROM ra)
  UNION ALL SELECT 't', count(DISTINCT p), count(DISTINCT p) = 0 FROM t WHERE p NOT IN (SELECT i FROM t)""")
def is_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [dag.closure_check(e).select(F.lit(n).alias("history"), "n_missing", "is_closed") for n, e in (("ra", B.replicas(spark, sf_dir)[0]), ("t", B.tree(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id FROM ra WHERE i NOT IN (SELECT i FROM rb)")
def diff_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return replicate.diff(a, b).select("id")


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id FROM rb WHERE i NOT IN (SELECT i FROM ra)")
def want_have(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return replicate.want(a, b).select("id")


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id, CASE WHEN p IS NULL THEN '' ELSE {_p('p')} END AS parents FROM rb WHERE i NOT IN (SELECT i FROM ra)")
def serve_want(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return replicate.serve(b, replicate.want(a, b)).select("id", F.array_join("parents", ",").alias("parents"))


@query(f"""WITH {_T}, {_R} SELECT 'b' AS peer_id, (SELECT count(*) FROM ra WHERE i NOT IN (SELECT i FROM rb)) AS sent,
  (SELECT count(*) FROM rb WHERE i NOT IN (SELECT i FROM ra)) AS received""")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return replicate.stats_frame(spark, replicate.sync(a, b, "b")[2])


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id FROM (SELECT i FROM ra UNION SELECT i FROM rb UNION SELECT i FROM t WHERE i % 5 = 0)")
def gossip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.replicas(spark, sf_dir)
    return replicate.gossip([a, b, B.tree(spark, sf_dir).where(F.col("id").cast("long") % 5 == 0)]).events.select("id")


# --- order and ancestry -------------------------------------------------------------------------------------


@query(f"WITH {_G}, {_GD} SELECT {_p('i')} AS id, CAST(d AS BIGINT) AS depth FROM gd")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.depth(B.two_parents(spark, sf_dir)).select("id", "depth")


@query(f"WITH {_G}, {_GD} SELECT {_p('i')} AS id, row_number() OVER (ORDER BY d, i) - 1 AS pos FROM gd")
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.topological_order(B.two_parents(spark, sf_dir)).select("id", "pos")


@query(f"WITH RECURSIVE {_T}, {_R}, w(i, d) AS (SELECT i, 0 FROM ra WHERE p IS NULL UNION ALL SELECT ra.i, w.d + 1 FROM w JOIN ra ON ra.p = w.i) SELECT {_p('i')} AS id, CAST(d AS BIGINT) AS depth FROM w")
def topo_drops_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.forest_depth(B.replicas(spark, sf_dir)[0]).select("id", "depth")


_UP = f"{_G}, up(i, p) AS (SELECT i, p FROM g UNION SELECT up.i, g.p FROM up JOIN g ON g.i = up.p)"


@query(f"WITH RECURSIVE {_UP} SELECT {_p('i')} AS id, {_p('p')} AS ancestor FROM up")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of every event."""
    events = B.two_parents(spark, sf_dir)
    return dag.ancestors(events, events.select(*KEY)).select("id", "ancestor")


def _pairs(events: DataFrame) -> DataFrame:
    """Each event but the first, and the one 10 times nearer to the root."""
    some = events.where(F.col("id").cast("long") > 0)
    return some.select(HISTORY, B.pad(F.expr("CAST(id AS BIGINT) div 10")).alias("a"), F.col("id").alias("b"))


_PAIRS = "pr AS (SELECT DISTINCT i // 10 AS a, i AS b FROM g)"


@query(f"WITH RECURSIVE {_UP}, {_PAIRS} SELECT {_p('a')} AS a, {_p('b')} AS b, (b, a) IN (SELECT (i, p) FROM up) AS precedes FROM pr")
def precedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.two_parents(spark, sf_dir)
    return dag.causally_precedes(events, _pairs(events)).select("a", "b", "precedes")


@query(f"WITH RECURSIVE {_UP}, {_PAIRS} SELECT {_p('a')} AS a, {_p('b')} AS b, a <> b AND NOT ((b, a) IN (SELECT (i, p) FROM up) OR (a, b) IN (SELECT (i, p) FROM up)) AS concurrent FROM pr")
def concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.two_parents(spark, sf_dir)
    return dag.are_concurrent(events, _pairs(events)).select("a", "b", "concurrent")


@query(f"""WITH RECURSIVE {_G}, x(i, p) AS (SELECT i, p FROM g WHERE i % 4 <> 2 UNION SELECT x.i, g.p FROM x JOIN g ON g.i = x.p WHERE x.p % 4 = 2)
  SELECT {_p('i')} AS child, {_p('p')} AS parent FROM x WHERE p % 4 <> 2 GROUP BY i, p""")
def remove_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event is removed; its children inherit its parents."""
    events = B.two_parents(spark, sf_dir)
    return dag.edges(dag.remove(events, events.where(F.col("id").cast("long") % 4 == 2).select(*KEY))).select("child", "parent")


# --- reduction ----------------------------------------------------------------------------------------------

_UC3 = f"""{_U}, c3 AS (SELECT *, last_value(CASE WHEN t <> 'error' THEN i END IGNORE NULLS) OVER (PARTITION BY history_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM u)"""


@query(f"WITH {_UC3} SELECT {_p('i')} AS id, CASE WHEN p IS NULL THEN '' ELSE {_p('p')} END AS parent FROM c3 WHERE t <> 'error'")
def noop_elim_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.eliminate_noops_in_chains(B.user_chains(spark, sf_dir), "ts", "i").select("id", F.array_join("parents", ",").alias("parent"))


_GC3 = f"{_G}, x(i, p) AS (SELECT i, p FROM g WHERE i % 3 <> 1 UNION SELECT x.i, g.p FROM x JOIN g ON g.i = x.p WHERE x.p % 3 = 1), gc AS (SELECT DISTINCT i, p FROM x WHERE p % 3 <> 1)"


@query(f"WITH RECURSIVE {_GC3} SELECT {_p('i')} AS child, {_p('p')} AS parent FROM gc")
def noop_elim_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.edges(reduce.eliminate_noops(B.two_parents(spark, sf_dir))).select("child", "parent")


@query("""SELECT CAST(1 AS BIGINT) AS iterations, CAST(0 AS BIGINT) AS cones_merged, CAST(0 AS BIGINT) AS chains_contracted,
  count(*) FILTER (event_id % 3 = 1) AS noops_eliminated, count(*) AS events_before, count(*) FILTER (event_id % 3 <> 1) AS events_after FROM events""")
def reduce_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.stats_frame(spark, reduce.reduce(B.two_parents(spark, sf_dir)).stats)


@query(f"""SELECT 'removed' AS op, {_p('event_id')} AS id FROM events WHERE event_id % 3 = 1 AND event_id % 2 = 0
  UNION ALL SELECT 'inserted', {_p('event_id')} FROM events WHERE event_id % 2 = 1 AND event_id % 3 <> 1""")
def reduce_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd events come to a history of the even ones, then the no-ops go."""
    events = B.two_parents(spark, sf_dir)
    return reduce.reduce(events, before=events.where(F.col("id").cast("long") % 2 == 0)).delta.select("op", "id")


_DOCS = """d AS (SELECT doc_id, sha256(coalesce(text, '') || sha256('"Genesis"')) AS h FROM documents),
 l AS (SELECT labels.doc_id, sha256('q' || coalesce(CAST(quality AS VARCHAR), '-') || 't' || coalesce(CAST(toxic AS VARCHAR), '-') || d.h) AS h FROM labels JOIN d USING (doc_id)),
 n AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, h FROM d UNION ALL SELECT 'l' || lpad(CAST(doc_id AS VARCHAR), 12, '0'), h FROM l UNION ALL SELECT '0', sha256('"Genesis"'))"""


@query(f"WITH {_DOCS} SELECT id, h AS cone_hash FROM n")
def cone_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cone_hashes(B.labelled_documents(spark, sf_dir)).select("id", "cone_hash")


@query(ORACLE_SQL["cone_hash"])
def cone_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document counts as changed: it and its label are hashed again, on top of the other hashes."""
    events = B.labelled_documents(spark, sf_dir)
    cones = cone_hashes(events)
    changed = events.where(F.substring("id", 1, 1) == "d").where(F.substring("id", 2, 12).cast("long") % 7 == 0)
    return refreshed(events, cones, changed).select("id", "cone_hash")


@query("SELECT CAST(4 AS BIGINT) AS iterations, 3 * count(*) AS cones_merged, CAST(0 AS BIGINT) AS chains_contracted, CAST(0 AS BIGINT) AS noops_eliminated, 6 * count(*) + 1 AS events_before, 3 * count(*) + 1 AS events_after FROM events")
def reduce_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pairs of twins for each event, each pair alike only when the one before is merged: three rounds that
    merge and one that finds nothing."""
    config = reduce.ReduceConfig(assume_content_addressed=False)
    return reduce.stats_frame(spark, reduce.reduce(B.twins(spark, sf_dir), config).stats)


@query(f"WITH {_DOCS} SELECT h AS cone_hash, count(*) AS n, min(id) AS first_id FROM n GROUP BY h HAVING count(*) > 1")
def isomorphic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomorphic_groups(cone_hashes(B.labelled_documents(spark, sf_dir))).select("cone_hash", "n", "first_id")


@query(f"""WITH {_DOCS}, k AS (SELECT id, min(id) OVER (PARTITION BY h) AS kept FROM n)
  SELECT k.id, CASE WHEN k.id = '0' THEN '' WHEN k.id LIKE 'd%' THEN '0' ELSE (SELECT o.kept FROM k o WHERE o.id = 'd' || substr(k.id, 2)) END AS parents FROM k WHERE k.id = k.kept""")
def cone_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = reduce.ReduceConfig(assume_content_addressed=False)
    return reduce.reduce(B.labelled_documents(spark, sf_dir), config).events.select("id", F.array_join("parents", ",").alias("parents"))


@query(f"""WITH RECURSIVE {_U}, c AS (SELECT *, lag(i) OVER w AS p, lead(i) OVER w AS n FROM u WINDOW w AS (PARTITION BY history_id ORDER BY seq)),
 m AS (SELECT *, t = 'view' AND p IS NOT NULL AND n IS NOT NULL AS gone FROM c),
 k AS (SELECT *, last_value(CASE WHEN NOT gone THEN i END IGNORE NULLS) OVER (PARTITION BY history_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM m)
 SELECT {_p('i')} AS id, CASE WHEN q IS NULL THEN '' ELSE {_p('q')} END AS parents FROM k WHERE NOT gone""")
def chain_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views inside a chain only pass on."""
    relay = F.coalesce(F.contains("payload_json", F.lit('"key":"view"')), F.lit(False))
    return reduce.contract_chains(B.user_chains(spark, sf_dir), relay)[0].select("id", F.array_join("parents", ",").alias("parents"))


# --- projections --------------------------------------------------------------------------------------------


@query(f"WITH {_U} SELECT history_id, t AS key, CAST(arg_max(k, seq) AS VARCHAR) AS val FROM u WHERE t <> 'error' GROUP BY history_id, t")
def kv_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user and key after no-ops are eliminated. Chains in a known sequence: two windows."""
    reduced = reduce.eliminate_noops_in_chains(B.user_chains(spark, sf_dir), "ts", "i")
    return project.key_value(order.chain_depth(reduced, "ts", "i"))


@query(f"""WITH RECURSIVE {_GC3}, w(i, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT gc.i, w.d + 1 FROM w JOIN gc ON gc.p = w.i), dd AS (SELECT i, max(d) AS d FROM w GROUP BY i)
 SELECT event_type || CAST(event_id % 7 AS VARCHAR) AS key, arg_max(json_extract_string(props, '$.k'), (d, event_id)) AS val FROM events JOIN dd ON dd.i = event_id GROUP BY 1""")
def kv_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the graph merged; concurrent writes of a key are settled by (depth, id)."""
    every = B.two_parents(spark, sf_dir)
    i = F.col("id").cast("long")
    merged = replicate.merge_histories(every.where(i % 2 == 0), every.where((i % 2 == 1) | (i % 5 == 0)))
    return project.key_value(merged.events).select("key", "val")


@query("""SELECT CAST(conv_id AS VARCHAR) AS history_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, sha256(text) AS value_hash FROM conversations WHERE role <> 'system'""")
def log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = order.chain_depth(reduce.eliminate_noops_in_chains(B.conversations(spark, sf_dir), "turn"), "turn")
    return project.log(chain).select(HISTORY, "pos", F.sha2(F.get_json_object("value", "$.text"), 256).alias("value_hash"))


def _increments(events: DataFrame) -> DataFrame:
    """The same events counting by their number."""
    amount = F.coalesce(F.get_json_object("payload_json", "$.Data.value.val"), F.lit("0"))
    data = F.col("tag") == "Data"
    return events.withColumn("kind", F.when(data, "increment")).withColumn("payload_json", F.when(data, data_payload(F.lit("increment"), amount)).otherwise(F.col("payload_json")))


@query(f"WITH {_U} SELECT history_id, CAST(coalesce(sum(k) FILTER (t <> 'error'), 0) AS BIGINT) AS total FROM u GROUP BY history_id")
def counter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.counter(_increments(B.user_chains(spark, sf_dir)))


@query("SELECT CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_id % 3 <> 2")
def counter_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments below missing events count too."""
    return project.counter(_increments(B.replicas(spark, sf_dir)[0])).select("total")


@query(f"WITH {_U} SELECT history_id, t AS key, CAST(arg_max(k, (k % 10, seq)) AS VARCHAR) AS val FROM u WHERE t <> 'error' GROUP BY history_id, t")
def lww_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that carry a ts of their own; equal ones are settled by causal order."""
    chain = order.chain_depth(B.user_chains(spark, sf_dir), "ts", "i")
    data = F.col("tag") == "Data"
    key, val = (F.get_json_object("payload_json", f"$.Data.value.{k}") for k in ("key", "val"))
    value = F.concat(F.lit('{"key":"'), key, F.lit('","ts":'), (val.cast("long") % 10).cast("string"), F.lit(',"val":'), val, F.lit("}"))
    writes = chain.withColumn("payload_json", F.when(data, data_payload(F.lit("write"), value)).otherwise(F.col("payload_json"))).withColumn("kind", F.when(data, "write"))
    return project.lww_register(writes)


@query(f"WITH {_U} SELECT history_id, CAST(k AS VARCHAR) AS item FROM u WHERE t <> 'error' AND t <> 'view' EXCEPT SELECT history_id, CAST(k AS VARCHAR) FROM u WHERE t = 'view'")
def two_phase_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views remove a number, other events add theirs."""
    chain = B.user_chains(spark, sf_dir)
    data = F.col("tag") == "Data"
    kind = F.when(F.get_json_object("payload_json", "$.Data.value.key") == "view", "rem").otherwise("add")
    changed = chain.withColumn("kind", F.when(data, kind)).withColumn("payload_json", F.when(data, data_payload(kind, F.get_json_object("payload_json", "$.Data.value.val"))).otherwise(F.col("payload_json")))
    return project.two_phase_set(changed)


# --- durability and streaming -------------------------------------------------------------------------------


@query(f"SELECT {_p('event_id')} AS id, (SELECT count(*) FROM events WHERE event_id % 3 = 1 OR event_id % 4 = 0 AND event_id > 0) AS replayed FROM events WHERE event_id % 3 <> 1")
def snapshot_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of a part, the log of everything; eliminated no-ops are replayed and eliminated again."""
    every, i = B.two_parents(spark, sf_dir), F.col("id").cast("long")
    store = FileStore(spark, new_path(spark, "wal"))
    store.append(every)
    early = reduce.reduce(every.where((i % 4 != 0) | (i == 0)))
    snapshot = write_snapshot(early.events, new_path(spark, "snapshots"), 1, early.stats.events_after, 0)
    out, n = recover(snapshot, store)
    return out.events.select("id", F.lit(n).cast("long").alias("replayed"))


@query(f"""WITH {_G} SELECT {_p('e.event_id')} AS id, CASE WHEN event_id % 3 = 1 THEN 'Noop' ELSE 'Data' END AS tag,
 CASE WHEN event_id % 3 = 1 THEN sha256('"Noop"') ELSE sha256('{{"Data":{{"kind":"set","value":{{"key":"' || event_type || CAST(event_id % 7 AS VARCHAR) || '","val":' || json_extract_string(props, '$.k') || '}}}}}}') END AS payload_hash,
 coalesce((SELECT string_agg({_p('p')}, ',' ORDER BY p) FROM g WHERE g.i = e.event_id), '') AS parents FROM events e""")
def wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = FileStore(spark, new_path(spark, "wal"))
    store.append(B.two_parents(spark, sf_dir))
    return store.load_all().select("id", "tag", hash_payload("payload_json").alias("payload_hash"), F.array_join("parents", ",").alias("parents"))


@query(ORACLE_SQL["wal_roundtrip"])
def wal_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of another writer: fields in another order, white space, a field of its own."""
    parents = F.when(F.size("parents") == 0, F.lit("[ ]")).otherwise(F.concat(F.lit('[ "'), F.array_join("parents", '" , "'), F.lit('" ]')))
    loose = F.regexp_replace("payload_json", '([:,{}])"', '$1 "')
    lines = B.two_parents(spark, sf_dir).select(F.concat(F.lit('{ "parents" : '), parents, F.lit(', "payload":'), loose, F.lit(', "id": "'), "id", F.lit('", "payload2": 1 }')).alias("value"))
    return parse_lines(lines, hash_safe=True).select("id", "tag", hash_payload("payload_json").alias("payload_hash"), F.array_join("parents", ",").alias("parents"))


@query(f"SELECT {_p('event_id')} AS id, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS ingest_seq FROM events")
def wal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are appended, then odd ones, then some of both again, which keep their first place."""
    every, i = B.two_parents(spark, sf_dir), F.col("id").cast("long")
    store = FileStore(spark, new_path(spark, "wal"))
    for part in (every.where(i % 2 == 0), every.where(i % 2 == 1), every.where(i % 3 == 0)):
        store.append(part.coalesce(1).sortWithinPartitions("id"))
    return store.in_order().select("id", "ingest_seq")


@query(ORACLE_SQL["noop_elim_dag"])
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history from the whole log, reduced."""
    store = FileStore(spark, new_path(spark, "wal"))
    store.append(B.two_parents(spark, sf_dir))
    return dag.edges(replay(store)[0].events).select("child", "parent")


@query(ORACLE_SQL["edges"])
def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot to JSON lines and back."""
    snapshot = write_snapshot(B.two_parents(spark, sf_dir), new_path(spark, "snapshots"), 3, 7, 11)
    back = from_json(to_json(snapshot))
    same = F.lit((back.seq, back.timestamp, back.source_event_count) == (3, 11, 7))
    return dag.edges(back.events.where(same)).select("child", "parent")


@query(ORACLE_SQL["kv_after_merge"])
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream by two tables on one path, the second opened after the first has ended."""
    every, i = B.two_parents(spark, sf_dir), F.col("id").cast("long")
    lines, path = new_path(spark, "stream-wal"), new_path(spark, "stream")
    for part in (every.where(i % 2 == 1), every.where(i % 2 == 0).unionByName(every.where(i % 10 == 1))):
        to_lines(part).coalesce(1).write.mode("append").text(lines)
        HistoryTable(spark, path).follow(read_log(spark, lines)).awaitTermination()
    return HistoryTable(spark, path).state("key_value").select("key", "val")


@query(ORACLE_SQL["kv_after_merge"])
def stream_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph comes as a stream of log files, late events first and some twice; the same state as in batch."""
    every, i = B.two_parents(spark, sf_dir), F.col("id").cast("long")
    path = new_path(spark, "stream-wal")
    for part in (every.where(i % 2 == 1), every.where(i % 2 == 0).unionByName(every.where(i % 10 == 1))):
        to_lines(part).coalesce(1).write.mode("append").text(path)
    table = HistoryTable(spark)
    table.follow(read_log(spark, path, files_per_batch=1)).awaitTermination()
    return table.state("key_value").select("key", "val")


@query(f"WITH {_U} SELECT history_id, {_p('i')} AS id, seq - 1 AS depth FROM u")
def stream_chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' chains as a stream of two files, later halves first: each event gets its depth once its past is there."""
    chains, path, out = B.user_chains(spark, sf_dir), new_path(spark, "stream-in"), new_path(spark, "stream-out")
    for part in (0, 1):
        chains.where(F.pmod(F.col("i"), F.lit(2)) != part).select(HISTORY, "id", "parents").coalesce(1).write.mode("append").parquet(path)
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema("history_id string, id string, parents array<string>").option("maxFilesPerTrigger", 1).parquet(path)
        sink = stream_depth(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start()
        sink.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.parquet(out)


# --- nodes, messages, examples ------------------------------------------------------------------------------


@query(ORACLE_SQL["wal_roundtrip"])
def message_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a part of a message and back."""
    back = events_in(parse_messages(messages("events", B.two_parents(spark, sf_dir))))
    return back.select("id", "tag", hash_payload("payload_json").alias("payload_hash"), F.array_join("parents", ",").alias("parents"))


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[list[Node], list[Connection]]:
    """Two nodes with the replicas, and a connection."""
    nodes, path = [Node(spark, "A"), Node(spark, "B")], new_path(spark, "link")
    for node, part in zip(nodes, B.replicas(spark, sf_dir), strict=True):
        node.batch_append(part)
    return nodes, [Connection(spark, path, "A", "B"), Connection(spark, path, "B", "A")]


_BOTH = f"""WITH {_T}, {_R}, x AS (SELECT {_p('i')} AS id FROM (SELECT i FROM ra UNION SELECT i FROM rb) UNION ALL SELECT '{GENESIS_ID}'),
  na AS (SELECT count(*) AS n FROM ra WHERE i NOT IN (SELECT i FROM rb)), nb AS (SELECT count(*) AS n FROM rb WHERE i NOT IN (SELECT i FROM ra))"""


@query(f"""{_BOTH} SELECT 'A' AS node, id, (SELECT n FROM na) AS sent, (SELECT n FROM nb) AS received FROM x
  UNION ALL SELECT 'B', id, (SELECT n FROM nb), (SELECT n FROM na) FROM x""")
def sync_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both nodes after a dialogue in messages, with what each sent and received."""
    (a, b), (la, lb) = _nodes(spark, sf_dir)
    stats = talk(call(a, la), answer(b, lb))
    held = [n.events.select(F.lit(n.name).alias("node"), "id", F.lit(s.sent).cast("long").alias("sent"), F.lit(s.received).cast("long").alias("received")) for n, s in zip((a, b), stats, strict=True)]
    return held[0].unionByName(held[1])


@query(f"WITH {_T}, {_R} SELECT {_p('i')} AS id FROM (SELECT i FROM rb UNION SELECT i FROM ra WHERE i % 2 = 0) UNION ALL SELECT '{GENESIS_ID}'")
def push_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second node after the first has pushed its even events, which it has in part."""
    (a, b), (la, lb) = _nodes(spark, sf_dir)
    even = a.events.where(F.col("id").try_cast("long") % 2 == 0)
    talk(push_to(a, even, la), answer(b, lb))
    return b.events.select("id")


@query(f"SELECT line_number, value FROM (SELECT row_number() OVER (ORDER BY event_id) AS line_number, event_id, 'bad ' || {_p('event_id')} AS value FROM events) WHERE event_id % 10 = 3")
def wal_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth line of a log is none; their numbers."""
    store, i = FileStore(spark, new_path(spark, "wal")), F.col("id").cast("long")
    lines = to_lines(B.two_parents(spark, sf_dir), ("id",)).coalesce(1).sortWithinPartitions("id")
    lines.select(F.when(i % 10 == 3, F.concat(F.lit("bad "), "id")).otherwise(F.col("value")).alias("value")).write.text(store.path)
    return store.bad_lines().select("line_number", "value")


@query(ORACLE_SQL["wal_order"])
def store_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three appends as of the log, to a store without lines."""
    every, i = B.two_parents(spark, sf_dir), F.col("id").cast("long")
    store = MemoryStore(spark)
    for part in (every.where(i % 2 == 0), every.where(i % 2 == 1), every.where(i % 3 == 0)):
        store.append(part.coalesce(1).sortWithinPartitions("id"))
    return store.in_order().select("id", "ingest_seq")


@query(f"SELECT {_p('event_id')} AS id, (SELECT count(*) FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 1) AS replayed FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT '{GENESIS_ID}', (SELECT count(*) FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 1)")
def durable_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel takes in the even events, which makes a snapshot, then the odd ones; another restores it."""
    every, i = B.two_parents(spark, sf_dir), F.col("id").try_cast("long")
    store, path = MemoryStore(spark), new_path(spark, "snapshots")
    kernel = DurableKernel(spark, store, path, interval=1)
    kernel.append(every.where(i % 2 == 0))
    kernel.interval = 0
    kernel.append(every.where(i % 2 == 1))
    again = DurableKernel(spark, store, path)
    n = again.restore(kernel.latest_snapshot())
    return again.events.select("id", F.lit(n).cast("long").alias("replayed"))


@query(f"WITH {_U} SELECT history_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY seq) || ',' AS state FROM u WHERE t <> 'error' GROUP BY history_id")
def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that depends on the order: the numbers of each user one after the other."""
    chain = order.chain_depth(B.user_chains(spark, sf_dir), "ts", "i")
    return project.fold(chain, F.get_json_object("payload_json", "$.Data.value.val"), F.lit(""), lambda s, v: F.concat(s, v, F.lit(",")), "set")


@query(f"""WITH {_U} SELECT history_id, CAST(coalesce(sum(k) FILTER (t <> 'error' AND i % 4 <> 0), 0) AS BIGINT) AS total FROM u GROUP BY history_id
  HAVING count(*) FILTER (i % 2 = 0) > 0 OR count(*) FILTER (t <> 'error' AND i % 2 = 1) > 0""")
def retract_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the even events, then the odd ones come and every fourth goes again."""
    every, i = _increments(B.user_chains(spark, sf_dir)), F.col("i")
    change = every.where((i % 2 == 1) | (i % 4 == 0)).withColumn("sign", F.when(i % 2 == 1, 1).otherwise(-1))
    return project.signed_counter(project.counter(every.where(i % 2 == 0)), change)


@query(f"""SELECT * FROM (VALUES ('key_value', 'name', 'Bob'), ('key_value', 'role', 'admin'), ('key_value', 'events', '4'), ('counter', 'total', '17'), ('counter', 'events', '6'),
  ('log', '0', 'system started'), ('log', '1', 'user logged in'), ('log', '2', 'action performed'), ('log', 'events', '4'),
  ('convergence', 'A', '250'), ('convergence', 'B', '250'), ('convergence', 'events', '5')) x(example, name, value)""")
def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.run(spark)


# --- the shapes of the benchmark ----------------------------------------------------------------------------


def _shape(events: DataFrame, n: int) -> DataFrame:
    s = reduce.reduce(events).stats
    return events.sparkSession.createDataFrame([(n, s.iterations, s.noops_eliminated, s.cones_merged, s.events_before, s.events_after)], "n long, iterations long, noops long, merged long, before long, after long")


SHAPE_SIZE = 100_000


@query(f"SELECT CAST({SHAPE_SIZE} AS BIGINT) AS n, CAST(1 AS BIGINT) AS iterations, CAST(0 AS BIGINT) AS noops, CAST(0 AS BIGINT) AS merged, CAST({SHAPE_SIZE + 1} AS BIGINT) AS before, CAST({SHAPE_SIZE + 1} AS BIGINT) AS after")
def shape_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(B.linear(spark, SHAPE_SIZE), SHAPE_SIZE)


@query(ORACLE_SQL["shape_linear"])
def shape_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(B.fanout(spark, SHAPE_SIZE), SHAPE_SIZE)


_NOOPS = -(-SHAPE_SIZE // 3)


@query(f"SELECT CAST({SHAPE_SIZE} AS BIGINT) AS n, CAST(1 AS BIGINT) AS iterations, CAST({_NOOPS} AS BIGINT) AS noops, CAST(0 AS BIGINT) AS merged, CAST({SHAPE_SIZE + 1} AS BIGINT) AS before, CAST({SHAPE_SIZE + 1 - _NOOPS} AS BIGINT) AS after")
def shape_noop_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(B.noop_chain(spark, SHAPE_SIZE), SHAPE_SIZE)


def entry(spark: SparkSession) -> DataFrame:
    return kv_state(spark, "/root/testdata/sf0.001")

