"""Statistics of collections, files, runs and logs: one aggregate each, over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import exact_quantiles


def doc_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: lengths, documents by source as a map, oldest and newest."""
    per = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"), F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    return per.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_length"), F.min("least").alias("min_length"), F.max("most").alias("max_length"), F.sum("total").alias("total_length"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def collection_status(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: documents and the sorted distinct values of low-cardinality columns."""
    return docs.agg(F.count("*").alias("n"), *(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in columns))


def document_stats(docs: DataFrame, as_of: str) -> DataFrame:
    """(kind, value, n): total, created on the day of as_of, by status and by source."""
    day = F.to_date(F.lit(as_of)) == F.to_date("created_at")
    grouped = docs.groupingSets([[F.col("status")], [F.col("source")], []], "status", "source").agg(F.count("*").alias("n"), F.count_if(day).alias("today"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "source").otherwise("total")
    rows = grouped.select(kind.alias("kind"), F.coalesce("status", "source", F.lit("")).alias("value"), "n")
    return rows.union(grouped.filter("g = 3").select(F.lit("today"), F.lit(""), "today"))


def file_stats(files: DataFrame) -> DataFrame:
    """(kind, value, n, bytes) by type, status and user (null: anonymous), and in all, in one pass."""
    own = files.withColumn("user", F.coalesce("user", F.lit("anonymous")))
    sets = own.groupingSets([[F.col("type")], [F.col("status")], [F.col("user")], []], "type", "status", "user").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "status").when(F.col("g") == 6, "user").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("type", "status", "user", F.lit("")).alias("value"), "n", "bytes")


def latency_stats(log: DataFrame, value: str = "latency_ms", ok: str = "ok") -> DataFrame:
    ps = (0.5, 0.9, 0.95, 0.99)
    at = F.col("ts").cast("timestamp")
    span = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    one = log.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.avg(F.col(ok).cast("int")).alias("success_rate"), (F.count("*") / span).alias("qps"))
    one = one.join(F.broadcast(exact_quantiles(log, value, ps)), how="left")  # one row each
    return one.select("n", "least", "most", "mean", "deviation", *(F.col("q")[i].alias(f"p{round(x * 100)}") for i, x in enumerate(ps)), "success_rate", "qps")


def ingest_stats(rows: DataFrame) -> DataFrame:
    """Documents made, rows refused, and the refusals counted by reason."""
    per = rows.groupBy("error").agg(F.count("*").alias("n"))
    made = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("error", "n"))))
    return per.agg(F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n"))), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0)).alias("errors"), F.transform(made, lambda s: F.concat_ws(":", s["error"], s["n"].cast("string"))).alias("details"))


def pipeline_stats(runs: DataFrame) -> DataFrame:
    """Uses, time and texts by combination of steps (steps array<string>, ms, texts)."""
    return runs.groupBy(F.array_join(F.array_sort("steps"), "_").alias("combination")).agg(F.count("*").alias("uses"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.sum("texts").alias("texts"))


def cache_log_stats(log: DataFrame) -> DataFrame:
    """Requests, hits and hit rate by type of an access log (type, hit)."""
    return log.groupBy("type").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("int")).alias("hits"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def event_log(events: DataFrame) -> DataFrame:
    """Events by hour and type."""
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
