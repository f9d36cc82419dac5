"""Fused search with its reranking step against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import fusion
from quern.plans import retrieval
from tests.oracle import SF_DIR


def chosen(rows, vectors, k):
    """The reference's order of fused rows (doc_id, combined), best first: relevance scaled over all of them, 0.7 of it less 0.3 of the closest chosen."""
    s = np.array([c for _, c in rows])
    relevance = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else s
    unit = [vectors[d] / max(np.linalg.norm(vectors[d]), 1e-300) for d, _ in rows]
    out = [int(np.argmax(np.round(relevance, 9)))]
    while len(out) < min(k, len(rows)):
        rest = [i for i in range(len(rows)) if i not in out]
        out.append(max(rest, key=lambda i: (round(0.7 * relevance[i] - 0.3 * max(unit[i] @ unit[j] for j in out), 9), -i)))
    return [rows[i][0] for i in out]


def test_reranks_queries_with_more_than_k_rows(spark):
    r, k = random.Random(4), 3
    texts = {d: " ".join(f"w{r.randrange(6)}" for _ in range(10)) for d in range(30)}
    side = lambda: [(q, d, r.random()) for q in range(6) for d in r.sample(range(30), 1 if q == 0 else 2 * k)]
    a, b = (spark.createDataFrame(side(), "query_id long, doc_id long, score double") for _ in range(2))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", fusion.keyword_slots(F.col("text")).alias("vec"))
    got = fusion.hybrid_search(a, b, k, reranker=lambda c: fusion.rerank(c.join(docs, "doc_id"), k, slots=fusion.SLOTS)).collect()
    vectors = {x.doc_id: np.bincount(x.vec, minlength=fusion.SLOTS).astype(float) for x in docs.collect()}
    moved = 0
    for q in range(6):
        fused = [(x.doc_id, x.combined_score) for x in sorted(fusion.fuse_weighted(a, b).filter(F.col("query_id") == q).collect(), key=lambda x: x["rank"])]
        own = [x.doc_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])]
        want = chosen(fused, vectors, k) if len(fused) > k else [d for d, _ in fused]
        assert own == want and sorted(x["rank"] for x in got if x.query_id == q) == list(range(1, len(want) + 1))
        moved += own != [d for d, _ in fused[:k]]
    assert moved


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_reranks(spark):
    fused = fusion.fuse_weighted(*retrieval._lists(spark, SF_DIR)).collect()
    texts = {x.doc_id: x.vec for x in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", fusion.keyword_slots(F.substring("text", 1, 500)).alias("vec")).collect()}
    vectors = {d: np.bincount(np.array(v, "int64"), minlength=fusion.SLOTS).astype(float) for d, v in texts.items()}
    got = {}
    for x in retrieval.hybrid_search(spark, SF_DIR).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = x.doc_id
    for q in {x.query_id for x in fused}:
        rows = [(x.doc_id, x.combined_score) for x in sorted((x for x in fused if x.query_id == q), key=lambda x: x["rank"])]
        want = chosen(rows, vectors, retrieval.K) if len(rows) > retrieval.K else [d for d, _ in rows]
        assert [got[q][i + 1] for i in range(len(want))] == want and len(got[q]) == len(want)
