"""Streams by mechanism: timers that drop state, restarts, late rows and repeats within the watermark."""

import datetime as dt

from pyspark.sql import functions as F

from quern.streaming import streams

START = dt.datetime(2024, 1, 1)
ALERTS = "id long, ts timestamp, alerts array<struct<metric:string,level:string,value:double>>"


def one(i, hours, n=3):
    return (i, START + dt.timedelta(hours=hours), [("m", "warning", 0.5)] * n)


def run(spark, folder):
    """One run over what is in the folder; the files come one a batch."""
    stream = spark.readStream.schema(ALERTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = streams.limit_alerts(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def put(spark, folder, rows, schema=ALERTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_alerts_of_an_hour_over_restarts_and_its_timer(spark, tmp_path):
    folder = f"file://{tmp_path}"
    put(spark, folder, [one(i, 0.1) for i in range(2)])
    run(spark, folder)
    put(spark, folder, [one(2 + i, 0.2) for i in range(5)])
    run(spark, folder)
    # six before the restart, and two rows more until ten have come
    out = spark.read.parquet(f"{folder}/out")
    assert sorted({r.id for r in out.collect()}) == [0, 1, 2, 3] and out.count() == 12
    held = lambda: {r.hour for r in spark.read.format("statestore").option("stateVarName", "count").load(f"{folder}/state").select(F.col("key.hour").alias("hour")).collect()}
    assert held() == {START}
    for hours in (60, 120):
        put(spark, folder, [one(100 + hours, hours)])
        run(spark, folder)
    assert START not in held() and spark.read.parquet(f"{folder}/out").filter("id >= 100").count() == 6


def test_ingest_counts_late_rows_and_repeats_nothing(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "doc_id long, text string, ts timestamp"
    at = lambda hours: START + dt.timedelta(hours=hours)
    seen = []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = streams.stream_ingest(stream, f"{folder}/ledger", f"{folder}/out", f"{folder}/state", lambda batch, n: seen.extend(r.doc_id for r in batch.collect()), time="ts")
        q.awaitTermination()
        return streams.dropped_late(q)

    put(spark, folder, [(1, "first text", at(0)), (2, "first text", at(0.1)), (3, "second text", at(0.2))], schema)
    assert run() == 0
    put(spark, folder, [(4, "third text", at(10)), (5, "second text", at(10))], schema)
    put(spark, folder, [(6, "fourth text", at(10.5))], schema)
    assert run() == 0
    put(spark, folder, [(7, "too late", at(3)), (8, "fifth text", at(11)), (9, "third text", at(11))], schema)
    assert run() == 1
    assert run() == 0
    assert sorted(seen)[-3:] == [4, 6, 8] and len(seen) == 5 and 3 in seen
    assert spark.read.parquet(f"{folder}/ledger").count() == 5
