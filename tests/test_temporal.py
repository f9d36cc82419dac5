"""Recency of documents that are dated ahead of the time of the job."""

from pyspark.sql import functions as F

from quern.operators import embed


def test_a_year_ahead_is_no_error(spark):
    rows = spark.createDataFrame([(1, "1998-04-01"), (2, "1999-04-01"), (3, None), (4, "1999-04-02")], "doc_id long, day string").withColumn("text", F.lit("a"))
    got = {r.doc_id: r.v[2] for r in rows.select("doc_id", embed.temporal_vector("1998-04-01 00:00:00", created="day").alias("v")).collect()}
    assert got[1] == 1.0 and got[2] == float("inf") and got[3] == 0.0 and round(got[4], 6) == -365.0
