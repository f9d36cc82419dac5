"""Greedy selection, approximate search and text metrics against brute force."""

import math
import random
from collections import Counter

import numpy as np

from quern.operators import context, dense, evaluate, fusion


def _embeddings(spark, n=400, d=16, seed=3):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in r.normal(size=d)]) for i in range(n)], "doc_id long, vec array<double>")


def test_ann_recall(spark):
    v = _embeddings(spark)
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in dense.knn_cosine(v, q, 5).collect()}
    near = {(r.query_id, r.doc_id) for r in dense.knn_ann(v, q, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_mmr(spark):
    r = random.Random(1)
    rows = [(q, d, r.random(), d + 1, [r.gauss(0, 1) for _ in range(4)]) for q in (1, 2) for d in range(120)]
    got = {}
    for x in fusion.mmr(spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int, vec array<double>"), 12).collect():
        got.setdefault(x.query_id, {})[x.position] = x.doc_id
    for q in (1, 2):
        own = [x for x in rows if x[0] == q]
        low, high = min(x[2] for x in own), max(x[2] for x in own)
        unit = {x[1]: np.array(x[4]) / np.linalg.norm(x[4]) for x in own}
        rel = {x[1]: (x[2] - low) / (high - low) for x in own}
        chosen = [max(rel, key=rel.get)]
        while len(chosen) < 12:
            chosen.append(max((d for d in rel if d not in chosen), key=lambda d: 0.7 * rel[d] - 0.3 * max(float(unit[d] @ unit[c]) for c in chosen)))
        assert [got[q][i + 1] for i in range(12)] == chosen


def test_select_diverse(spark):
    r = random.Random(2)
    rows = [(1, d, d + 1, " ".join(f"w{r.randrange(30)}" for _ in range(8)), r.random()) for d in range(60)]
    got = {x.position: x.doc_id for x in context.select_diverse(spark.createDataFrame(rows, "query_id long, doc_id long, rank int, text string, importance double"), 6, 0.4).collect()}
    sets, imp = {x[1]: set(x[3].split()) for x in rows}, {x[1]: x[4] for x in rows}
    chosen = [max(imp, key=imp.get)]
    while len(chosen) < 6:
        far = lambda d: min(1 - len(sets[d] & sets[c]) / len(sets[d] | sets[c]) for c in chosen)
        chosen.append(max((d for d in imp if d not in chosen), key=lambda d: 0.6 * imp[d] + 0.4 * far(d)))
    assert [got[i + 1] for i in range(6)] == chosen


def test_context_window_keeps_to_its_budget(spark):
    text = "This is an important result of the key study. " * 30
    rows = [(q, level, d, d + 1, text + str(d), 1.0 - d / 100) for q, level in ((1, "simple"), (2, "analytical")) for d in range(70)]
    out = context.context_window(spark.createDataFrame(rows, "query_id long, level string, doc_id long, rank int, text string, importance double"), budget=500).toPandas()
    for q, most in ((1, 3), (2, 12)):
        own = out[out.query_id == q]
        assert 0 < len(own) <= most and own.token_count.sum() <= 500 + len(own) and own.position.tolist() == list(range(1, len(own) + 1))


def test_retriever_bench_overlap(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.3)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 1, 1.0), (1, 3, 1.0)], "query_id long, doc_id long, score double")
    got = {r.method: (r.queries, r.results, round(r.mean_score, 6), r.overlap) for r in evaluate.retriever_bench({"a": a, "b": b}, "a").collect()}
    assert got == {"a": (2, 1.5, 0.4, 1.0), "b": (1, 2.0, 1.0, 0.5)}
