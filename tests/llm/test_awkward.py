"""Repeated rows, missing ids, one kind of label, empty tables and clashing names, operator by operator."""

import pytest

from pyspark.sql import functions as F

from quern.llm import common, decontaminate, line_dedup, near_dedup, pieces, pii, quality, quality_rules, secrets_scan, url_filter
from tests.llm.fixtures import SCHEMA, documents, labels, rows

TEXT = "mail a.b@c.example.com or secret=abcdefghijkl1234 there"


@pytest.mark.parametrize("find", [pii.find_pii, secrets_scan.find_secrets])
def test_scans_of_repeated_rows_without_ids(spark, find):
    docs = spark.createDataFrame([(None, TEXT, "x", 1), (None, TEXT, "x", 1), (1, TEXT, "x", 1), (1, TEXT, "x", 1), (1, None, "x", 1)], "doc_id long, text string, base string, added int")
    out = find(docs).collect()
    assert sorted((str(r.doc_id), len(r.base), len(r.added)) for r in out) == [("1", 0, 0), ("1", 1, 0), ("1", 1, 0), ("None", 1, 0), ("None", 1, 0)]


def test_pieces_of_repeated_rows(spark):
    docs = documents(spark, [rows()[5], rows()[5]])
    out = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in pieces.piece_digests(docs, pieces.model_path()).collect()]
    assert len(out) == docs.count() and len({x for x in out if x[0] == 5}) == 1


@pytest.mark.parametrize("kept", ["quality = 9", "quality = 1", "quality = 0"])
def test_quality_with_less_than_two_kinds_of_label(spark, kept):
    docs, own = documents(spark, [rows()[5]]), labels(spark).filter(kept)
    want = 0.0 if kept == "quality = 0" else 1.0
    assert {r.score for r in quality.score_quality(docs, quality.train(docs, own)).collect()} == {want}
    judged = quality_rules.judge_quality(docs, quality_rules.train_trees(docs, own)).collect()
    assert len(judged) == docs.count() and all(not r.kept for r in judged if r.base_failed)


def test_quality_rules_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge_quality(empty, quality_rules.train_trees(empty, labels(spark))).count() == 0


#: Inner names of the operators, and names that they add.
CLASHING = ("_doc", "_drop", "_DROP_", "_raw", "_score", "_gone", "_id", "_text", "N_Dropped", "row", "hashes", "class", "y", "drop")


def clashing(spark):
    docs = documents(spark)
    return docs.select(*docs.columns, *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))


OPERATORS = {
    "dedup_lines": lambda d, spark: line_dedup.dedup_lines(d),
    "score_quality": lambda d, spark: quality.score_quality(d, quality.train(d, labels(spark)), "score"),
    "keep_quality": lambda d, spark: quality.keep_quality(d, labels(spark), 0.0),
    "keep_one": lambda d, spark: near_dedup.keep_one(d),
    "drop_contaminated": lambda d, spark: decontaminate.drop_contaminated(d, d.selectExpr("doc_id as item_id", "substr(text, 1, 0) as text")),
    "filter_urls": lambda d, spark: url_filter.filter_urls(d.withColumnRenamed("text", "url").withColumns({"HOST": F.lit(1), "Blocked": F.lit("x")}), url_filter.default_blocklist(spark)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_clashing_names_pass_through(spark, name):
    out = OPERATORS[name](clashing(spark), spark)
    replaced = {"N_Dropped"} if name == "dedup_lines" else set()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.select("doc_id", *(F.col(f"`{c}`") for c in CLASHING if c not in replaced)).collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING if c not in replaced)


def test_free_name(spark):
    assert common.free_name(spark.createDataFrame([], "_A int, `_a_` int"), "_a") == "_a__"


def test_training_takes_the_least_text_of_a_repeated_id(spark):
    more = [(i, f"other text number {i} of the same id", "en", "s", 1, "x", None, "r", 7, 0.5, "c") for i in range(12)]
    a, b = documents(spark, more), documents(spark, more).repartition(7).sort(F.desc("text"))
    own = labels(spark).union(labels(spark).selectExpr("doc_id", "1 - quality", "toxic"))
    scores = [sorted((str(r.doc_id), str(r.text), r.score) for r in quality.score_quality(a, quality.train(d, own)).collect()) for d in (a, b)]
    assert scores[0] == scores[1]


def test_held_out_is_a_boolean_for_every_row(spark, tmp_path):
    spark.createDataFrame([(None, "a text"), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.held_out for r in quality.op8_quality_classifier(spark, str(tmp_path)).collect()} <= {True, False}
