"""Sparse products in tiles against every pair, and no row for a pair."""

import random

import pytest

from quern.operators import dense


@pytest.mark.parametrize("rows,tile", [(200_000, 1 << 20), (40, 64)])
def test_equals_every_pair(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(dense, "ASKED_ROWS", rows)
    monkeypatch.setattr(dense, "TILE", tile)
    r = random.Random(1)
    side = lambda n, m: [(i, f"t{t}", r.choice([-1.0, 0.0, 0.5, 2.0])) for i in range(n) for t in r.sample(range(30), r.randrange(0, m))]
    d, q = side(150, 12), side(40, 5)
    docs = spark.createDataFrame([*d, (None, "t1", 9.0)], "doc_id long, term string, w double").repartition(3)
    queries = spark.createDataFrame([*q, (99, "nowhere", 1.0)], "query_id long, term string, w double")
    pairs: dict = {}
    for i, t, w in q:
        for j, u, x in d:
            if t == u:
                pairs[i, j] = pairs.get((i, j), 0.0) + w * x
    want = []
    for i in {i for i, _ in pairs}:
        best = sorted((-round(s, 6), j) for (a, j), s in pairs.items() if a == i)[:4]
        want += [(i, j, n, -s) for n, (s, j) in enumerate(best, 1)]
    out = dense.sparse_dot(docs, queries, 4)
    assert sorted((x.query_id, x.doc_id, x["rank"], round(x.score, 6) + 0.0) for x in out.collect()) == sorted((*w[:3], w[3] + 0.0) for w in want)
    assert dense.sparse_dot(docs, queries.filter("false"), 4).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan  # no join that makes a row for a pair
