"""Near duplicates by hyperplane buckets against the comparison of everything; a chunker called from SQL."""

import numpy as np

from quern.operators import dedupe, dense, hooks


def table(spark, x, key="doc_id", start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(e) for e in v]) for i, v in enumerate(x)], f"{key} long, vec array<double>").repartition(3)


def test_recall_at_the_bound(spark):
    r = np.random.default_rng(1)
    stored = r.normal(size=(1500, 24))
    unit = stored / np.linalg.norm(stored, axis=1, keepdims=True)
    noise = r.normal(size=(600, 24))
    noise -= (noise * unit[:600]).sum(axis=1, keepdims=True) * unit[:600]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    # just above the bound, where buckets are shared least, and just below it
    cos = np.where(np.arange(600) % 3 == 0, 0.94, 0.955)[:, None]
    new = cos * unit[:600] + np.sqrt(1 - cos**2) * noise
    v, q = table(spark, stored), table(spark, new, "query_id", 10_000)
    exact = {(x.query_id, x.doc_id) for x in dense.knn_cosine(v, q, 1).filter("score > 0.95").collect()}
    got = {(x.query_id, x.doc_id): x.relevance for x in dedupe.near_dup(q, v).collect()}
    assert set(got) <= exact and len(exact) == 400 and len(got) >= 0.95 * len(exact) and all(abs(s - 0.955) < 1e-6 for s in got.values())


def test_few_pairs_meet(spark):
    v = table(spark, np.random.default_rng(2).normal(size=(2000, 32)))
    q = table(spark, np.random.default_rng(3).normal(size=(300, 32)), "query_id")
    bits, tables = dedupe.planes_needed(2000, 0.95)
    met = dedupe.buckets(q, "query_id", 32, bits, tables, dedupe.FLIPS).join(dedupe.buckets(v, "doc_id", 32, bits, tables), "bucket").select("query_id", "doc_id").distinct().count()
    assert met < 0.5 * 2000 * 300


def test_copies_zero_and_missing_rows(spark):
    v = table(spark, [None, [0.0, 0.0], [3.0, 4.0], [6.0, 8.0], [3.0, 4.0], [4.0, -3.0]])
    q = table(spark, [[0.3, 0.4], [0.0, 0.0], None, [-3.0, -4.0], [4.0, -3.01]], "query_id", 10)
    assert sorted((x.query_id, x.doc_id, round(x.relevance, 4)) for x in dedupe.near_dup(q, v).collect()) == [(10, 2, 1.0), (14, 5, 1.0)]
    assert dedupe.near_dup(q, v.filter("false")).count() == 0 and dedupe.near_dup(q.filter("false"), v).count() == 0


def test_chunker_from_sql(spark):
    hooks.register_chunker(spark, "by_word", str.split)
    spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (4, "one")], "doc_id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("select t.doc_id, c.chunk_index, upper(c.content) u from texts t, lateral by_word(t.text) c where c.chunk_index < 5").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "TWO"), (1, 1, "WORDS"), (4, 0, "ONE")]
