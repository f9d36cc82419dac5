"""A training corpus from the documents table: judge, dedupe, decontaminate and encode it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's docs; all but the
last return the columns of documents.

Defined cases: a null text is an empty one to every stage, and line dedup writes it as empty; rows without a doc_id lose no line, are
nobody's near duplicate, and are judged by the other stages like any row; rows with the same doc_id stand or fall together as near
duplicates and are judged each by the other stages; empty documents give an empty result; without labels the classifier keeps all;
further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import stored, table
from quern.llm.decontaminate import drop_contaminated
from quern.llm.line_dedup import dedup_lines
from quern.llm.near_dedup import keep_one
from quern.llm.pieces import model_path, piece_digests
from quern.llm.quality import keep_quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go from all but one; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of what they decode to."""
    return piece_digests(docs, model_path(), keep=("doc_id", "lang", "source"), with_ids=True, with_text=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The classifier, signatures and encoding have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
