"""What a task of the neighbour search holds does not grow with the queries of a block."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from quern.operators import dense

ROWS, DIMENSIONS, K = 10_000, 8, 5  # Spark's usual Arrow batch


def task(spark, monkeypatch, n: int, metric: str):
    """The function that knn runs in its tasks for n queries, which are one block."""
    r = np.random.default_rng(n)
    found = []
    corpus = spark.createDataFrame([(0, [0.0] * DIMENSIONS)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame(list(enumerate(r.normal(size=(n, DIMENSIONS)).tolist())), "query_id long, vec array<double>")
    usual = type(corpus).mapInPandas
    with monkeypatch.context() as m:
        m.setattr(type(corpus), "mapInPandas", lambda df, f, *a, **x: found.append(f) or usual(df, f, *a, **x))
        dense.knn(corpus, queries, K, metric)
    assert len(found) == 1
    return found[0]


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_memory_of_a_task(spark, monkeypatch, metric):
    """2,000 queries against a batch were a matrix of 160 MB and its sorted copies, 4,000 twice as much."""
    r = np.random.default_rng(1)
    batches = [pd.DataFrame({"doc_id": np.arange(i, i + ROWS), "vec": list(r.normal(size=(ROWS, DIMENSIONS)))}) for i in (0, ROWS)]
    peaks = []
    for n in (2_000, 4_000):
        run = task(spark, monkeypatch, n, metric)
        tracemalloc.start()
        rows = sum(map(len, run(iter(batches))))
        peaks.append(tracemalloc.get_traced_memory()[1] / 2**20)
        tracemalloc.stop()
        assert rows >= n * K
    assert peaks[1] < 64 and peaks[1] < peaks[0] + 8
