"""A caller's own functions: models, tokenizers, chunkers, computation on a miss and callbacks."""

from pyspark.sql import functions as F

from quern.operators import hooks
from quern.sources import tabular


def _docs(spark):
    return spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "doc_id long, text string")


def test_models_tokenizers_and_chunkers(spark):
    docs = _docs(spark)
    got = {r.doc_id: list(r.vec) for r in hooks.embed_with(docs, lambda: lambda texts: [(len(t), 1) for t in texts]).collect()}
    assert got == {1: [9.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    assert {r.doc_id: list(r.tokens) for r in hooks.tokenize_with(docs, lambda: str.split).collect()} == {1: ["two", "words"], 2: [], 3: []}
    assert sorted(map(tuple, hooks.chunk_with(docs, str.split).collect())) == [(1, 0, "two"), (1, 1, "words")]


def test_compute_on_miss(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "key string, n long")
    memo = spark.createDataFrame([("a", 10)], "key string, value long")
    values, new = hooks.compute_on_miss(wanted, memo, ["key"], lambda keys: keys.withColumn("value", F.lit(20).cast("long")))
    assert sorted(map(tuple, values.select("n", "value").collect())) == [(1, 10), (2, 20), (3, 20), (4, 20)]
    assert sorted(r.key for r in new.collect()) == ["b", "c"]


def test_callbacks(spark, tmp_path):
    _docs(spark).write.parquet(f"{tmp_path}/in")
    seen = []
    q = hooks.on_each_batch(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in"), [lambda batch, n: seen.append(batch.count()), lambda batch, n: seen.append(-n)], f"{tmp_path}/state")
    q.awaitTermination()
    assert sum(x for x in seen if x > 0) == 3


def test_load_golden_of_an_array(spark, tmp_path):
    (tmp_path / "golden.json").write_text('[{"id": "q1", "question": "Why?", "answer": "So.", "relevant_docs": ["d1", "d2"], "metadata": {"difficulty": "easy"}},\n {"id": "q2", "question": "How?"}]')
    rows = {r.id: r for r in tabular.load_golden(spark, str(tmp_path / "golden.json")).collect()}
    assert rows["q1"].relevant_docs == ["d1", "d2"] and rows["q1"].metadata == {"difficulty": "easy"} and rows["q2"].answer is None
