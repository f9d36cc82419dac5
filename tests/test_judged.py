"""Judgement by labels: equal to the judgement by golden pairs, without a row for a pair."""

from pyspark.sql import functions as F

from quern.operators import evaluate


def labelled(spark, n):
    rows = [(i, None if i % 11 == 0 else i % 3) for i in range(n)]
    rows += [(4, 2), (5, 2), (8, 0), (8, 1), (8, 1), (9, None)]  # several labels, repeated rows
    return spark.createDataFrame(rows, "doc_id long, label int")


def parts(spark, n=60):
    items = labelled(spark, n)
    queries = items.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "label").union(spark.createDataFrame([(1000, 7), (1001, None)], "query_id long, label int"))
    asked = queries.select("query_id").distinct().filter("query_id % 8 = 0 or query_id >= 1000")  # some queries have no hits
    hits = asked.join(spark.range(1, 6).select(F.col("id").cast("int").alias("rank"))).withColumn("doc_id", (F.col("query_id") + F.col("rank") * F.col("rank") * 3) % 70)  # some hits are no items
    return hits.select("query_id", "doc_id", "rank"), queries, items


def test_equal_to_golden_pairs(spark):
    hits, queries, items = parts(spark)
    golden = queries.withColumnRenamed("label", "l").join(items, F.col("l") == F.col("label")).select("query_id", "doc_id")
    columns = ("query_id", "doc_id", "rank", "rel", "n_relevant")
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    got = rows(evaluate.judged_by_label(hits, queries, items))
    assert got == rows(evaluate.judged(hits, golden)) and {g[3] for g in got} == {0, 1} and any(g[1] is None for g in got)


def largest_operator(df):
    """The rows that the widest operator of an executed plan puts out."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            left.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        left += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_no_row_for_a_golden_pair(spark):
    """300 queries of one label among 6,000 items were 1,800,000 rows."""
    items = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    queries = items.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label")
    hits = queries.select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("rank"))
    out = evaluate.judged_by_label(hits, queries, items)
    assert largest_operator(out) <= 6000
    pairs = queries.withColumnRenamed("label", "l").join(items, F.col("l") == F.col("label")).select("query_id", "doc_id")
    assert largest_operator(evaluate.judged(hits, pairs)) >= 1_800_000  # so such rows are seen
    assert out.agg(F.min("n_relevant"), F.max("n_relevant"), F.sum("rel")).first()[:] == (6000, 6000, 300)
