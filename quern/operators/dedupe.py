"""Exact and nearest-neighbour duplicates of stored documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose sides of all hyperplanes a task holds at a time.
BATCH_ROWS = 512


def content_hash(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def dedupe_exact(docs: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """The least doc_id of each text, without texts in the ledger (content_hash). Copies meet as hashes only."""
    own = docs.withColumn("content_hash", content_hash())
    first = own.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    if processed is not None:
        first = first.join(processed, "content_hash", "left_anti")
    return own.join(first.select("doc_id"), "doc_id", "left_semi")


def processed_ledger(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger (content_hash) with the batch's hashes."""
    return ledger.union(batch.select(content_hash().alias("content_hash"))).distinct()


def dup_by_hash(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New documents whose text is stored already."""
    return new.withColumn("content_hash", content_hash()).join(stored.select(content_hash().alias("content_hash")), "content_hash", "left_semi")


#: Bits of a bucket at the least and most, the share of pairs at the bound that tables alone find, and bits that a new row also tries flipped.
LEAST_BITS, MOST_BITS, FOUND, FLIPS = 6, 24, 0.98, 3


def planes_needed(rows: int, least: float) -> tuple[int, int]:
    """Bits of a bucket and tables of buckets: bits grow with the rows, so that a bucket of unlike rows stays small, and tables with the bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, rows.bit_length() - 3))
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    return bits, max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - agree**bits))) if agree < 1 else 1


def buckets(df: DataFrame, key: str, dimensions: int, bits: int, tables: int, flips: int = 0) -> DataFrame:
    """(key, bucket): the buckets of each row (key, vec) by the sides of random hyperplanes that it lies on.

    With flips, also those across the nearest hyperplanes of each table, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(7).normal(size=(tables * bits, dimensions))
        weights = 1 << np.arange(bits, dtype="int64")
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                side = (np.array([np.asarray(v, float) for v in part.column("vec").to_pylist()]) @ planes.T).reshape(-1, tables, bits)
                own = (side > 0) @ weights + (np.arange(tables, dtype="int64") << MOST_BITS)
                found = [own]
                for near in range(min(flips, bits)):
                    nearest = np.argsort(np.abs(side), axis=2)[:, :, near]
                    found.append(own ^ weights[nearest])
                every = np.stack(found, axis=2).reshape(part.num_rows, -1)
                ids = part.column(key).take(pa.array(np.repeat(np.arange(part.num_rows), every.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(every.ravel())], names=[key, "bucket"])

    return df.select(key, "vec").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, bucket long")


def near_dup(new: DataFrame, embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """(query_id, relevance, doc_id): new rows (query_id, vec) with a stored row (doc_id, vec) of more than least relevance, and the nearest one.

    New and stored rows meet in buckets of random hyperplanes; those that meet are compared exactly, so what is found is right, and about
    a FOUND of the pairs at the bound are found, more above it. Equal stored rows count as the one of the least id. A zero row is near none.
    """
    from ..functions.embeddings import dot, unit
    from ..sources.shared import kept

    own = embeddings.filter(F.col("vec").isNotNull()).select("doc_id", unit(F.col("vec")).alias("vec"))
    stored = kept(own.groupBy("vec").agg(F.min("doc_id").alias("doc_id")), "stored-rows")
    asked = kept(new.filter(F.col("vec").isNotNull()).select("query_id", unit(F.col("vec")).alias("vec")), "new-rows")
    first = stored.select(F.size("vec").alias("d")).head()
    dimensions = first.d if first else 1
    bits, tables = planes_needed(stored.count(), least)
    # a pair meets once, however many buckets it shares
    met = buckets(asked, "query_id", dimensions, bits, tables, FLIPS).join(buckets(stored, "doc_id", dimensions, bits, tables), "bucket").select("query_id", "doc_id").distinct()
    scored = met.join(asked.withColumnRenamed("vec", "_new"), "query_id").join(stored, "doc_id").select("query_id", "doc_id", dot(F.col("vec"), F.col("_new")).alias("score"))
    near = scored.withColumn("relevance", F.least(F.lit(1.0), "score")).filter(F.round("relevance", 6) > least)
    return near.groupBy("query_id").agg(F.max("relevance").alias("relevance"), F.min_by("doc_id", F.struct((-F.round("score", 6)).alias("m"), "doc_id")).alias("doc_id"))


def file_dedupe(files: DataFrame) -> DataFrame:
    """binaryFile rows with sha256, size and whether an earlier path has the same content."""
    own = files.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.octet_length("content"))
    return own.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("sha256").orderBy("path")) > 1)
