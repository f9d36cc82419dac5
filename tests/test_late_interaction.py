"""maxsim against every pair of tokens: documents over several batches, long documents, blocks of queries, ties and nulls."""

import numpy as np
import pytest

from quern.operators import dense

N_DOCS, K = 60, 4


def token_rows(seed, sizes):
    r = np.random.default_rng(seed)
    return [(i, p, v.tolist()) for i, n in enumerate(sizes) for p, v in enumerate(r.normal(size=(n, 6)))]


def brute(docs, queries, k):
    def units(rows):
        out = {}
        for i, _, v in rows:
            n = np.linalg.norm(v)
            out.setdefault(i, []).append(np.array(v) / n if n else np.zeros(6))
        return {i: np.array(v) for i, v in out.items()}

    d, want = units(docs), []
    for i, q in units(queries).items():
        scores = sorted((-round(float((q @ x.T).max(axis=1).sum()), 6), j) for j, x in d.items())
        want += [(i, j, n, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return want


@pytest.fixture(scope="module")
def tables():
    sizes = [1 + (i * 7) % 40 for i in range(N_DOCS)]
    docs = token_rows(1, sizes)
    docs += [(N_DOCS + i, p, v) for i in range(3) for j, p, v in docs if j == 5]  # copies of one document
    docs.append((N_DOCS + 9, 0, [0.0] * 6))
    return docs, token_rows(2, [1, 3, 5, 2, 8])


@pytest.mark.parametrize("long_tokens,query_bytes,batch", [(1000, 16 << 20, 10_000), (20, 16 << 20, 7), (1000, 300, 7), (0, 300, 50)])
def test_maxsim_equals_all_pairs(spark, tables, monkeypatch, long_tokens, query_bytes, batch):
    monkeypatch.setattr(dense, "QUERY_BYTES", query_bytes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        d = spark.createDataFrame([*tables[0], (None, 0, [1.0] * 6)], "doc_id long, pos int, vec array<double>")
        q = spark.createDataFrame(tables[1], "query_id long, pos int, vec array<double>")
        got = sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in dense.maxsim(d, q, K, long_tokens).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(brute(*tables, K))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_maxsim_of_nothing(spark, tables):
    empty = "doc_id long, pos int, vec array<double>"
    d, q = spark.createDataFrame(tables[0], empty), spark.createDataFrame(tables[1], empty.replace("doc_id", "query_id"))
    assert dense.maxsim(d.filter("false"), q, K).count() == 0 and dense.maxsim(d, q.filter("false"), K).count() == 0
