"""The pipeline's stages: columns, kept documents and effects."""

import corpus_pipeline
from quern.llm.pieces import model_path, piece_digests
from tests.llm.fixtures import words
from tests.llm.test_learned_operators import _labelled


def test_pipeline(spark, tmp_path):
    docs, own = _labelled(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    passage = " ".join(words(15, 5, 10**6))
    extra = [(900, "clean one. " + ". ".join(words(60, 1001)), "en", "s", 0), (901, passage + ". " + ". ".join(words(60, 555, 10**5)), "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    own.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    ids = {r.doc_id for r in step.collect()}
    assert 901 not in ids and 900 not in ids and 1 in ids and not ids & {i for i in range(240) if i % 4 == 0}
    out = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r.doc_id: r.ids_sha256 for r in piece_digests(step, model_path()).collect()}


def test_pipeline_of_nulls_repeats_and_nothing(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None), (2, ""), (3, "the same words stand in both of these rows"), (3, "the same words stand in both of these rows"), (None, "a text that has no number of its own"), (None, None)]
    for name, own in (("some", [(i, t, "en", "s", None) for i, t in rows]), ("none", [])):
        spark.createDataFrame(own, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out) == [(0, False), (0, True), (1, False), (2, False), (3, True), (3, True)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
