"""Structured Streaming forms of scoring, summaries, alerts, feedback and ingestion; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import monitor as M
from ..operators.chunks import chunk_documents
from ..operators.dedupe import content_hash


def stream_scores(rows: DataFrame) -> DataFrame:
    """Scores of each arriving interaction: no state."""
    return M.score_interactions(rows)


def stream_quality(rows: DataFrame, window: str = "30 minutes", slide: str | None = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, end, n, overall, confidence, risk) by window of event time; rows later than late are dropped."""
    own = M.score_interactions(rows).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return own.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("overall").alias("overall"), F.avg("confidence").alias("confidence"), F.avg("hallucination_risk").alias("risk")).select("w.start", "w.end", "n", "overall", "confidence", "risk")


def stream_feedback(feedback: DataFrame, window: str = "24 hours", slide: str = "1 hour", least: int = 10) -> DataFrame:
    """(start, end, n, satisfaction) by sliding window, of least samples or more."""
    value = F.when(F.col("type") == "rating", F.col("rating") / 5).when(F.col("type") == "thumbs_up", 1.0).when(F.col("type") == "thumbs_down", 0.0)
    own = feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").withColumn("v", value)
    return own.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("v").alias("n"), F.avg("v").alias("satisfaction")).filter(F.col("n") >= least).select("w.start", "w.end", "n", "satisfaction")


def stream_event_log(events: DataFrame) -> DataFrame:
    """Events by hour and type."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return own.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


#: Hours after which an hour's count of alerts is forgotten, by event time.
KEPT_HOURS = 48
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HourlyLimit(StatefulProcessor):
    """Lets alerts of an hour through while fewer than a bound came before; a timer drops the hour's count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.count.get()
        if held is None:
            self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + (KEPT_HOURS + 1) * 3_600_000)
        before, out = held[0] if held else 0, []
        for row in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            if before >= M.ALERTS_PER_HOUR:
                break
            before += len(row.alerts)
            out += [(row.id, row.ts, a["metric"], a["level"], a["value"]) for a in row.alerts]
        self.count.update((before,))
        if out:
            yield pd.DataFrame(out, columns=["id", "ts", "metric", "level", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_alerts(alerts: DataFrame) -> DataFrame:
    """(id, ts, metric, level, value) of a stream of rows (id, ts, alerts), as many as an hour may give. The session's state goes to RocksDB."""
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = alerts.filter(F.size("alerts") > 0).withWatermark("ts", "1 hour").select(F.date_trunc("hour", "ts").alias("hour"), "id", "ts", "alerts")
    return keyed.groupBy("hour").transformWithStateInPandas(HourlyLimit(), "id long, ts timestamp, metric string, level string, value double", "Append", "EventTime")


def stream_alerts(rows: DataFrame) -> DataFrame:
    """(id, ts, metric, level, value): alerts while fewer than ten came before in the row's hour."""
    return limit_alerts(M.alert_candidates(M.score_interactions(rows).withColumn("ts", F.col("ts").cast("timestamp"))).select("id", "ts", "alerts"))


def stream_ingest(files: DataFrame, ledger_path: str, out_path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, time: str | None = None, late: str = "1 hour"):
    """Starts a restartable query: new documents (doc_id, text), without texts in the ledger, chunked and appended batch by batch.

    With a column of event time, a text that comes again within `late` is dropped before the ledger is read, and rows later than that are
    dropped; dropped_late() of the query tells how many.
    """
    own = files.withColumn("content_hash", content_hash())
    if time:
        own = own.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        # computed once a batch, so that what the stream drops is counted once
        own = batch.dropDuplicates(["content_hash"]).persist()
        try:
            known = spark.read.parquet(ledger_path).filter(F.col("batch") != n)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        fresh = own if known is None else own.join(known, "content_hash", "left_anti")
        chunk_documents(fresh).write.mode("overwrite").parquet(f"{out_path}/batch={n}")  # a repeated batch gives the same files
        fresh.select("content_hash").write.mode("overwrite").parquet(f"{ledger_path}/batch={n}")
        if on_batch:
            on_batch(fresh, n)
        own.unpersist()

    return own.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_late(query) -> int:
    """Rows that the watermark of a query has dropped so far, in the progress that it keeps."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
