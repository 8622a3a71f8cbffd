"""Laws of histories, on random DAGs against a plain model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from antecede.functions.identity import data, frame, genesis, noop
from antecede.operators import cone, dag, order, project, reduce, replicate
from antecede.schema import EVENTS, GENESIS_ID, KEY
from antecede.sources import builders as B


def random_dag(seed: int, n: int = 30, missing: bool = True) -> list[tuple]:
    """Events of two histories with up to three parents, no-ops in runs, some parents missing."""
    rng, out = random.Random(seed), []
    for h in ("a", "b"):
        ids = []
        for i in range(n):
            parents = set(rng.sample(ids, min(len(ids), rng.choice([0, 1, 1, 2, 3])))) if i else set()
            if missing and rng.random() < 0.05:
                parents.add(f"gone{rng.randrange(3)}")
            tag = "Noop" if rng.random() < 0.4 else "Data"
            ids.append(f"{rng.randrange(10**6):06d}-{i}")
            value = f'{{"key":"k{rng.randrange(4)}","val":{i}}}'
            out.append((h, ids[-1], tag, "set" if tag == "Data" else None, f'{{"Data":{{"kind":"set","value":{value}}}}}' if tag == "Data" else '"Noop"', sorted(parents)))
    return out


def model_depth(events):
    own = {(e[0], e[1]): e for e in events}
    depth, todo = {}, True
    while todo:
        todo = False
        for k, e in own.items():
            if k not in depth and all((k[0], p) in depth for p in e[5]):
                depth[k] = 1 + max((depth[(k[0], p)] for p in e[5]), default=-1)
                todo = True
    return depth


def model_compact(events, gone):
    own = {(e[0], e[1]): e[5] for e in events}

    def resolve(h, p, seen=()):
        if (h, p) in gone and (h, p) in own:
            return {x for q in own[(h, p)] for x in resolve(h, q)}
        return {p}

    return {(e[0], e[1]): sorted({x for p in e[5] for x in resolve(e[0], p)}) for e in events if (e[0], e[1]) not in gone}


def as_map(df, value):
    return {(r["history_id"], r["id"]): r[value] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_model(spark, seed):
    rows = random_dag(seed)
    events = spark.createDataFrame(rows, EVENTS)
    want = model_depth(rows)
    assert as_map(order.level_depth(events), "depth") == want
    assert as_map(order.grouped_depth(events), "depth") == want
    topo = order.topological_order(events).collect()
    for h in ("a", "b"):
        expected = [i for _, i in sorted((d, k[1]) for k, d in want.items() if k[0] == h)]
        assert [r["id"] for r in sorted((r for r in topo if r["history_id"] == h), key=lambda r: r["pos"])] == expected
    gone = {(e[0], e[1]) for e in rows if e[2] == "Noop"}
    assert as_map(reduce.eliminate_noops(events), "parents") == model_compact(rows, gone)
    present = {(e[0], e[1]) for e in rows}
    parents = {(e[0], p) for e in rows for p in e[5]}
    assert {tuple(r) for r in dag.frontier(events).collect()} == present - parents
    assert {tuple(r) for r in dag.missing_ancestors(events).collect()} == parents - present
    cones = as_map(cone.cone_hashes(events), "cone_hash")
    assert cones == as_map(cone.grouped_cone_hashes(events), "cone_hash") and set(cones) == set(want)


def test_forest_depth_is_level_depth(spark):
    rows = [(h, i, t, k, p, parents[:1]) for h, i, t, k, p, parents in random_dag(5)]
    events = spark.createDataFrame(rows, EVENTS)
    assert as_map(order.forest_depth(events), "depth") == as_map(order.level_depth(events), "depth") == model_depth(rows)


def test_cycles_and_unknown_tombstones(spark):
    rows = [("m", "r", "Data", "x", "{}", []), ("m", "a", "Data", "x", "{}", ["b"]), ("m", "b", "Data", "x", "{}", ["a"]), ("m", "c", "Data", "x", "{}", ["r"])]
    events = spark.createDataFrame(rows, EVENTS)
    assert as_map(order.level_depth(events), "depth") == {("m", "r"): 0, ("m", "c"): 1}
    same = dag.compact_tombstones(events, spark.createDataFrame([("m", "zzz")], "history_id string, id string"))
    assert as_map(same, "parents") == as_map(events, "parents")
    rootless = dag.remove(events, spark.createDataFrame([("m", "r")], "history_id string, id string"))
    assert as_map(rootless, "parents")[("m", "c")] == []


def test_ancestry(spark):
    rows = random_dag(3, 25)
    events = spark.createDataFrame(rows, EVENTS)
    own = {(e[0], e[1]): e[5] for e in rows}

    def up(h, i):
        found, todo = set(), list(own.get((h, i), ()))
        while todo:
            p = todo.pop()
            if p not in found:
                found.add(p)
                todo += own.get((h, p), ())
        return found

    ids = [(e[0], e[1]) for e in rows][::5]
    asked = spark.createDataFrame(ids, "history_id string, id string")
    assert {tuple(r) for r in dag.ancestors(events, asked).collect()} == {(h, i, a) for h, i in ids for a in up(h, i)}
    pairs = [(h, a, b) for h, a in ids for k, b in ids if h == k] + [("a", "u1", "u2")]
    df = spark.createDataFrame(pairs, "history_id string, a string, b string")
    for r in dag.causally_precedes(events, df).collect():
        assert r["precedes"] == (r["a"] in up(r["history_id"], r["b"]))
    for r in dag.are_concurrent(events, df).collect():
        assert r["concurrent"] == (r["a"] != r["b"] and r["a"] not in up(r["history_id"], r["b"]) and r["b"] not in up(r["history_id"], r["a"]))


def test_reduce_is_idempotent_and_counts(spark):
    events = spark.createDataFrame(random_dag(4, missing=False), EVENTS)
    once = reduce.reduce(events)
    twice = reduce.reduce(once.events)
    assert as_map(once.events, "parents") == as_map(twice.events, "parents")
    assert once.stats.iterations == 1 and once.stats.events_after == once.events.count() and twice.is_empty()
    assert once.has_reductions() and once.delta.where("op = 'removed'").count() == once.stats.noops_eliminated
    assert dag.is_causally_closed(events) == dag.is_causally_closed(once.events)


def test_equal_pasts_merge(spark):
    g = genesis()
    rows = [g, ("main", "node_a", "Data", "op", '{"x":42}', [GENESIS_ID]), ("main", "node_b", "Data", "op", '{"x":42}', [GENESIS_ID]), ("main", "kid_a", "Data", "op", "1", ["node_a"]), ("main", "kid_b", "Data", "op", "1", ["node_b"]), ("main", "both", "Data", "op", "2", ["node_a", "node_b"])]
    events = spark.createDataFrame(rows, EVENTS)
    out = reduce.reduce(events, reduce.ReduceConfig(assume_content_addressed=False))
    assert as_map(out.events, "parents") == {("main", GENESIS_ID): [], ("main", "node_a"): [GENESIS_ID], ("main", "kid_a"): ["node_a"], ("main", "both"): ["node_a"]}
    assert out.stats.cones_merged == 2 and out.stats.iterations == 2
    assert reduce.reduce(events).stats.cones_merged == 0
    groups = cone.isomorphic_groups(cone.cone_hashes(events)).collect()
    assert sorted(r["ids"] for r in groups) == [["kid_a", "kid_b"], ["node_a", "node_b"]]


def test_refreshed_cones(spark):
    rows = random_dag(6, missing=False)
    events = spark.createDataFrame(rows, EVENTS)
    old = cone.cone_hashes(events)
    changed = [(h, i, t, k, p + " " if n == 3 else p, q) for n, (h, i, t, k, p, q) in enumerate(rows)]
    new = spark.createDataFrame(changed, EVENTS)
    dirty = spark.createDataFrame([(rows[3][0], rows[3][1])], "history_id string, id string")
    assert as_map(cone.refreshed(new, old, dirty), "cone_hash") == as_map(cone.cone_hashes(new), "cone_hash")


def test_merge_laws_and_convergence(spark):
    def branch(name, kinds):
        out, tip = [genesis()], GENESIS_ID
        for i, kind in enumerate(kinds):
            e = data(kind, {"key": f"k{i % 2}", "val": name + str(i)} if kind == "set" else i + ord(name), [tip]) if kind != "noop" else noop([tip])
            out.append(e)
            tip = e[1]
        return frame(spark, out)

    a, b, c = branch("a", ["set", "noop", "increment", "set"]), branch("b", ["increment", "set"]), branch("c", ["set", "noop"])
    merge = lambda x, y: replicate.merge_histories(x, y).events
    ids = lambda x: {tuple(r) for r in x.select(*KEY).collect()}
    ab, ba = merge(a, b), merge(b, a)
    assert ids(ab) == ids(ba) and ids(merge(ab, c)) == ids(merge(a, merge(b, c))) and ids(merge(ab, ab)) == ids(ab)
    assert {tuple(r) for r in project.key_value(ab).collect()} == {tuple(r) for r in project.key_value(ba).collect()}
    x, y, stats = replicate.sync(reduce.reduce(a).events, reduce.reduce(b).events, "b")
    assert ids(x) == ids(y) == ids(ab) and (stats.sent, stats.received) == (3, 2)
    assert str(stats) == "sync with b: sent=3, received=2"
    assert ids(replicate.gossip([a, b, c]).events) == ids(merge(ab, c))


def test_projections(spark):
    g, rows = genesis(), [genesis()]

    def add(kind, value, parents=None):
        rows.append(data(kind, value, [rows[-1][1]] if parents is None else parents))

    for kind, value in (("set", {"key": "name", "val": "Alice"}), ("set", {"key": "role", "val": "admin"}), ("set", {"key": "name", "val": None}), ("set", {"key": 5, "val": 1}), ("set", {"key": "x"}), ("log", "one"), ("increment", 5), ("increment", 2.5), ("increment", True), ("log", {"two": 2}), ("write", {"key": "c", "val": 1, "ts": 200}), ("write", {"key": "c", "val": 2, "ts": 50}), ("add", "apple"), ("add", "banana"), ("rem", "banana")):
        add(kind, value)
    add("increment", 7, ["nowhere"])
    add("log", "lost", ["nowhere"])
    h = frame(spark, rows)
    assert {(r["key"], r["val"]) for r in project.project(h, "key_value").collect()} == {("name", "null"), ("role", '"admin"')}
    assert [r["value"] for r in project.project(h, "log").orderBy("pos").collect()] == ['"one"', '{"two":2}'] == [r["value"] for r in project.log_window(h).orderBy("pos").collect()]
    assert project.log_array(h).first()["entries"] == ['"one"', '{"two":2}']
    assert project.project(h, "counter").first()["total"] == 12
    assert [(r["key"], r["val"]) for r in project.project(h, "lww_register").collect()] == [("c", "1")]
    assert [r["item"] for r in project.project(h, "two_phase_set").collect()] == ['"apple"']
    assert g[1] == GENESIS_ID
    project.register_projection("size", lambda e: e.groupBy("history_id").count())
    assert project.project(h, "size").first()["count"] == h.count()
    lengths = project.fold(h, F.length("payload_json"), F.lit(0), lambda s, x: s + x, "log").first()["state"]
    assert lengths == sum(len(r[4]) for r in rows if r[3] == "log" and r[5] != ["nowhere"])
    signed = frame(spark, [data("increment", 5, [])]).withColumn("sign", F.lit(-1))
    assert project.signed_counter(project.counter(h).where("total > 0"), signed).first()["total"] == 7


def test_shapes(spark):
    for build, noops in ((B.linear, 0), (B.fanout, 0), (B.noop_chain, 34)):
        out = reduce.reduce(build(spark, 100))
        assert (out.stats.iterations, out.stats.noops_eliminated, out.stats.events_after) == (1, noops, 101 - noops)
        assert dag.is_causally_closed(out.events)
    big = reduce.reduce(B.noop_chain(spark, 5000, 1)).events
    assert big.count() == 1


def test_rounds_of_merging(spark):
    """Seven events of which each pair of twins is alike only when the one before is merged."""
    own = [("a", []), ("a", []), ("c", [1, 2]), ("c", [1]), ("e", [3, 4]), ("e", [3])]
    rows = [("h", "0", "Genesis", None, '"Genesis"', [])]
    rows += [("h", str(k), "Data", "set", f'{{"Data":{{"kind":"set","value":"{p}"}}}}', sorted(map(str, above)) or ["0"]) for k, (p, above) in enumerate(own, 1)]
    events = spark.createDataFrame(rows, EVENTS)
    for rounds, merged, left in ((1, 1, {"0", "1", "3", "4", "5", "6"}), (2, 2, {"0", "1", "3", "5", "6"}), (3, 3, {"0", "1", "3", "5"}), (1000, 3, {"0", "1", "3", "5"})):
        out = reduce.reduce(events, reduce.ReduceConfig(assume_content_addressed=False, max_iterations=rounds))
        assert (out.stats.iterations, out.stats.cones_merged, out.stats.events_after) == (min(rounds, 4), merged, 7 - merged)
        assert {r["id"] for r in out.events.collect()} == left
    at_once = reduce.merge_cones(events, at_once=True)
    assert {r["id"] for r in at_once[0].collect()} == {"0", "1", "3", "5"} and at_once[1].count() == 3
    idle = reduce.reduce(events, reduce.ReduceConfig(enable_cone_merge=False, enable_chain_contract=False, enable_noop_elim=False))
    assert idle.cones.count() == 7 and idle.stats.iterations == 1 and reduce.reduce(events).cones is None


def test_cones_and_depth_of_a_deep_chain(spark):
    """A chain deeper than any number of rounds of jobs would do."""
    chain = B.linear(spark, 20_000)
    assert order.depth(chain).agg(F.max("depth"), F.count("*")).first() == (20_000, 20_001)
    assert cone.cone_hashes(chain).select(F.countDistinct("cone_hash")).first()[0] == 20_001
    few = B.linear(spark, 3)
    assert {tuple(r) for r in cone.cone_hashes(few).collect()} == {tuple(r) for r in cone.cone_hashes(few, method="levels").collect()}
