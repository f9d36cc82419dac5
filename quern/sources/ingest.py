"""Batch ingestion of files into a chunk store, whole delimited files as documents, and exports of monitoring tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import chunk_documents
from ..operators.dedupe import content_hash
from .tabular import clean_cell, clean_name


def ingest_pipeline(files: DataFrame, store: str, strategy: str = "hybrid", **sizes) -> DataFrame:
    """Hashes, dedupes and chunks documents (doc_id, text), and appends them to the store's chunks and ledger.

    Of equal texts the least doc_id stays; texts that the ledger has are skipped. Returns (doc_id, status): new, duplicate or known.
    The ledger is appended last, so a job that broke off is repeated, and chunks of its documents are read once by their doc_id.
    """
    spark = files.sparkSession
    own = files.select("doc_id", "text").withColumn("content_hash", content_hash())
    first = own.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    try:
        known = spark.read.parquet(f"{store}/ledger").select("content_hash").distinct().withColumn("known", F.lit(True))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "content_hash string, known boolean")
    judged = own.join(first, "content_hash").join(known, "content_hash", "left")
    status = F.when(F.col("known"), "known").when(F.col("doc_id") == F.col("first"), "new").otherwise("duplicate")
    judged = judged.withColumn("status", status)
    fresh = judged.filter("status = 'new'").dropDuplicates(["content_hash"])
    chunks = chunk_documents(fresh, strategy, **sizes)
    titled = chunks.withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.format_string(" (chunk %d)", F.col("chunk_index") + 1)))
    titled.write.mode("append").parquet(f"{store}/chunks")
    judged.select("doc_id", "status").write.mode("overwrite").parquet(f"{store}/last_run")
    fresh.select("content_hash", "doc_id").write.mode("append").parquet(f"{store}/ledger")
    return spark.read.parquet(f"{store}/last_run")


def csv_as_text_doc(rows: DataFrame, file: str = "path", order: str = "line_no") -> DataFrame:
    """(path, text, row_count, column_count): each file's rows as one text with a list of its columns, rows in order.

    A file is one document by definition, so its rows meet in one group; larger tables go by rows_to_docs_packed.
    """
    cells = [f for f in rows.schema.fields if f.name not in (file, order)]
    line = F.concat_ws(" | ", *(F.coalesce(clean_cell(f), F.lit("")) for f in cells))
    head = F.concat(F.lit("CSV data from "), F.col(file), F.lit(":\n\nColumns: " + ", ".join(clean_name(f.name) for f in cells) + "\n\n"))
    own = rows.select(F.col(file).alias("path"), head.alias("head"), F.col(order).alias("o"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    one = own.groupBy("path").agg(F.first("head").alias("head"), body.alias("body"), F.count("*").alias("row_count"))
    return one.select("path", F.concat("head", "body").alias("text"), "row_count", F.lit(len(cells)).cast("long").alias("column_count"))


def export_monitoring(tables: dict[str, DataFrame], path: str, as_of: str, hours: int) -> None:
    """The rows (ts) of each table from the last hours before as_of, as a JSON folder a table."""
    end = F.lit(as_of).cast("timestamp")
    for name, df in tables.items():
        inside = (F.col("ts") <= end) & (F.unix_timestamp(end) - F.unix_timestamp("ts") <= hours * 3600)
        df.filter(inside).write.mode("overwrite").json(f"{path}/{name}")
