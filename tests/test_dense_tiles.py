"""Neighbour search and late interaction in tiles of bounded size: equal to all pairs, and no larger matrix of scores."""

import numpy as np
import pandas as pd
import pytest

from quern.operators import dense

K = 5


def brute(docs, queries, metric, exclude):
    want = []
    for i, q in queries:
        scores = []
        for j, x in docs:
            if exclude and i == j:
                continue
            s = float(np.dot(q, x))
            if metric == "cosine":
                n = np.linalg.norm(q) * np.linalg.norm(x)
                s = s / n if n else 0.0
            scores.append((-round(s, 6), j))
        want += [(i, j, r, -s) for r, (s, j) in enumerate(sorted(scores)[:K], 1)]
    return sorted(want)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("tile,exclude", [(1 << 20, True), (64, True), (1, False)])
def test_knn_equals_all_pairs(spark, monkeypatch, metric, tile, exclude):
    monkeypatch.setattr(dense, "TILE", tile)
    r = np.random.default_rng(3)
    docs = [(i, r.normal(size=4).tolist()) for i in range(120)]
    docs += [(200 + i, docs[i % 3][1]) for i in range(30)] + [(300, [0.0] * 4)]  # many ties
    queries = [d for d in docs if d[0] % 10 == 0]
    d = spark.createDataFrame(docs, "doc_id long, vec array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted((x.query_id, x.doc_id, x["rank"], round(x.score, 6)) for x in dense.knn(d, q, K, metric, exclude).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(docs, queries, metric, exclude)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_scores_come_in_tiles():
    """A block of 20,000 queries against a batch of 10,000 rows was one matrix of 1.6 GB."""
    assert max((b - a) * 10_000 for a, b in dense.tiles(20_000, 10_000, dense.TILE)) <= dense.TILE
    starts = np.arange(0, 80_000, 4)
    ranges = dense.query_tiles(starts, 80_000, 10_000, dense.TILE)
    assert ranges[0][0] == 0 and ranges[-1][1] == 20_000 and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    assert max((b - a) * 4 * 10_000 for a, b in ranges) <= dense.TILE


def test_best_of_batches():
    r, k = np.random.default_rng(4), 3
    s, docs = np.round(r.normal(size=(8, 500)), 1), r.permutation(500)
    best = dense.Best(8, k)
    for i in range(0, 500, 50):
        best.add(0, docs[i : i + 50], s[:, i : i + 50])
    got = pd.concat(best.frames(np.arange(8)))
    for i in range(8):
        assert got[got.query_id == i].doc_id.tolist() == [docs[j] for j in np.lexsort((docs, -s[i]))[:k]]


@pytest.mark.parametrize("tile", [1, 40])
def test_late_interaction_in_small_tiles(spark, monkeypatch, tile):
    r = np.random.default_rng(5)
    rows = [(i, p, r.normal(size=3).tolist()) for i in range(40) for p in range(1 + i % 7)]
    asked = [x for x in rows if x[0] % 10 == 0]
    d = spark.createDataFrame(rows, "doc_id long, pos int, vec array<double>")
    q = spark.createDataFrame(asked, "query_id long, pos int, vec array<double>")
    found = lambda: sorted((x.query_id, x.doc_id, round(x.score, 6)) for x in dense.maxsim(d, q, 4).collect())
    want = found()
    monkeypatch.setattr(dense, "TILE", tile)
    assert found() == want
