"""The query log analyses a text once, and gives every row what the analysis of its own text gives."""

from pyspark.sql import functions as F

from quern.operators import query_log as Q

TEXTS = [None, "", "  ", "zzz", "=zzz", "Compare revenue of A and profit last quarter, and analyze trends", "How to improve customer service in X?", "Should I choose the API or the database for the new system?", "What is the current status of order 7?", "Plan: strategy, roadmap and performance metrics, kpi results"]


def test_texts_are_analysed_once(spark, monkeypatch):
    rows = [(i, t, i % 7) for i, t in enumerate(TEXTS * 300)] + [(None, "zzz", 1), (1, TEXTS[5], 2)]
    log = spark.createDataFrame(rows, "query_id long, text string, other long").repartition(3)
    seen = []
    monkeypatch.setattr(Q, "_process", lambda df, run=Q._process: seen.append(df.count()) or run(df))
    out = Q.process_query_log(log)
    assert seen == [len(TEXTS)] and set(log.columns) < set(out.columns)
    alone = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "query_id long, text string")
    kinds = {r.text: r for r in Q.classify_queries(alone).collect()}
    terms = {r.text: r for r in Q.expand_queries(alone).collect()}
    words = {r.text: r for r in Q.query_domains(Q.query_keywords(alone)).collect()}
    agents = {TEXTS[r.query_id]: r.agent for r in Q.route_queries(alone).filter("rank = 1").collect()}
    got = out.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((r.query_id, r.text, r.other) for r in got), key=key) == sorted(rows, key=key)
    for r in got:
        k, e, w = kinds[r.text], terms[r.text], words[r.text]
        assert (r.query_type, r.intent, r.confidence, r.complexity_score) == (k.query_type, k.intent, k.confidence, k.complexity_score)
        assert (r.new_terms, r.combined, r.keywords, r.domains, r.agent) == (e.new_terms, e.combined, w.keywords, w.domains, agents.get(r.text))


def test_distinct_texts_are_not_joined(spark):
    log = spark.createDataFrame([(i, f"why is {i}?") for i in range(50)], "query_id long, text string")
    out = Q.process_query_log(log)
    assert out.count() == 50 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert Q.process_query_log(log.filter(F.lit(False))).count() == 0
