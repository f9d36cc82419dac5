"""Inverted lists of product codes: recall, rows read in full, and awkward tables."""

import os

import numpy as np
import pytest

from quern.functions import clusters
from quern.operators import dense, embed, ivf
from quern.plans import retrieval
from tests.oracle import SF_DIR


def table(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(e) for e in v]) for i, v in enumerate(x)], "doc_id long, vec array<double>").repartition(4)


def measured(spark, v, k=5):
    """Recall of the k nearest, the share of rows that a query reads in full, and the lists probed of those there are."""
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = ivf.build(v, k)
    refine = ivf.refine_rows(index.rows, k)
    read = ivf.survivors(index, q, refine, exclude_self=True).groupBy("query_id").count().agg({"count": "max"}).first()[0]
    exact = {(r.query_id, r.doc_id) for r in dense.knn_cosine(v, q, k, exclude_self=True).collect()}
    near = {(r.query_id, r.doc_id) for r in ivf.search(index, v, q, k, exclude_self=True).collect()}
    return len(exact & near) / len(exact), read / index.rows, index.probes / len(index.centres)


def test_unstructured_rows(spark):
    recall, read, _ = measured(spark, table(spark, np.random.default_rng(3).normal(size=(1500, 32))))
    assert recall >= 0.9 and read <= 0.1


def test_clustered_rows_probe_few_lists(spark):
    r = np.random.default_rng(4)
    recall, read, probed = measured(spark, table(spark, r.normal(size=(20, 24))[r.integers(20, size=2000)] + 0.15 * r.normal(size=(2000, 24))))
    assert recall >= 0.9 and read <= 0.1 and probed <= 0.25


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_given_rows(spark):
    recall, read, _ = measured(spark, retrieval.corpus(spark, SF_DIR).select("doc_id", "vec"))
    assert recall >= 0.9 and read <= 0.1


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    v = table(spark, np.random.default_rng(5).normal(size=(600, 16)))
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = ivf.build(v, 5)
    whole = sorted(map(tuple, ivf.search(index, v, q, 5).collect()))
    monkeypatch.setattr(ivf, "QUERY_BYTES", 1000)
    assert sorted(map(tuple, ivf.search(index, v, q, 5).collect())) == whole


def test_awkward_tables(spark):
    rows = [None, [0.0] * 4, *[[1.0, 2.0, 3.0, 4.0]] * 30, [4.0, 3.0, 2.0, 1.0]]
    v = table(spark, rows)
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [0.0] * 4)], "query_id long, vec array<double>")
    got = [(r.query_id, r.doc_id, round(r.score, 6)) for r in dense.knn_ann(v, q, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0)] and {x[0] for x in got} == {1, 3} and all(x[2] == 0 for x in got[3:])
    assert dense.knn_ann(v.filter("false"), q, 3).count() == 0 and dense.knn_ann(v, q.filter("false"), 3).count() == 0


def test_a_table_is_the_product_with_the_decoded_row():
    r = np.random.default_rng(6)
    x, q = r.normal(size=(300, 10)), r.normal(size=(7, 10))
    books = clusters.codebooks(x, 4, 16)
    codes = clusters.encode(x, books)
    decoded = np.concatenate([b[c] for b, c in zip(books, codes.T)], axis=1)
    assert np.allclose(sum(t[:, c] for t, c in zip(clusters.tables(q, books), codes.T)), q @ decoded.T)
    for own, b, c in zip(clusters.runs(x, 4), books, codes.T):
        assert (((own[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) == c).all()


def test_quantize_pq_codes_are_nearest_centroids(spark):
    x = np.random.default_rng(7).normal(size=(200, 16))
    coded, book = embed.quantize_pq(table(spark, x), 4, 32)
    books = {(r["sub"], r["code"]): np.array(r["centroid"]) for r in book.collect()}
    error = 0.0
    for r in coded.collect():
        for s, code in enumerate(r.codes):
            own = x[r.doc_id, s * 4 : s * 4 + 4]
            far = {c: ((own - m) ** 2).sum() for (part, c), m in books.items() if part == s}
            assert far[code] == pytest.approx(min(far.values()))
            error += far[code]
    assert error < 0.6 * ((x - x.mean(axis=0)) ** 2).sum()
    back = {r.doc_id: r.vec for r in embed.dequantize(coded, "pq", book).collect()}
    one = coded.filter("doc_id = 9").first()
    assert back[9] == [v for s, c in enumerate(one.codes) for v in books[s, c].tolist()]
