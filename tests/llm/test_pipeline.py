from __future__ import annotations

import collections

import corpus_pipeline as P
from antecede.llm.common import ship
from tests.conftest import SF
from tests.llm.test_small_tables import brute_repeats, check_bins, words


def test_stages(spark):
    """Each stage on what the one before left, against brute force."""
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = [f for _, f in P.STAGES]
    known = stage[0](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == docs.where("text rlike '[A-Za-z]'").count()
    known = spark.createDataFrame(known.collect(), docs.schema)
    apart = stage[1](spark, known, SF).collect()
    rows = sorted((r for r in known.collect()), key=lambda r: r["doc_id"])
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (words(r["text"]) for r in rows)]
    par = list(range(len(rows)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in apart) == [rows[k]["doc_id"] for k in range(len(rows)) if find(k) == k]
    left = spark.createDataFrame(apart, docs.schema)
    cut = stage[2](spark, left, SF).collect()
    want = {r[0]: r for r in brute_repeats(sorted((r["doc_id"], r["text"]) for r in apart), 100)}
    assert {r["doc_id"] for r in cut} == {i for i, r in want.items() if r[2] < r[1]}
    assert all(want[r["doc_id"]][1] - want[r["doc_id"]][2] - len(r["text"].encode()) < 4 * max(1, want[r["doc_id"]][3]) for r in cut)
    mixed = stage[3](spark, spark.createDataFrame(cut, docs.schema), SF)
    assert mixed.columns == docs.columns
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    assert max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    packed = stage[4](spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in mixed.collect())
    check_bins([(r["sequence_id"], r["offset"], r["length"]) for r in packed])


def test_texts_that_share_a_doc_id_or_have_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    say = lambda *k: " ".join(f"w{i}" for r in k for i in range(r, r + 40))
    rows = [(None, say(0)), (None, say(100)), (None, say(100)), (7, say(200)), (7, say(300)), (3, say(200)), (None, say(300)), (8, ""), (8, ""), (None, None)]
    df = spark.createDataFrame([{"doc_id": i, "text": t} for i, t in rows], docs.schema)
    left = P.STAGES[1][1](spark, df, SF)
    assert left.columns == docs.columns
    want = [(None, say(0)), (None, say(100)), (7, say(300)), (3, say(200)), (8, ""), (8, ""), (None, None)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in left.collect()) == collections.Counter(want)


def test_run(spark):
    assert P.run(spark, SF).count() > 0
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing", "best-fit packing"]
