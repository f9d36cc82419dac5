"""Queries of retrieval, answer and run evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense, fusion
from ..operators import evaluate as E
from .inputs import read
from .quality import interactions
from .retrieval import _AB as _LISTS
from .retrieval import _MM, asked, corpus

K = 10


def _judged(spark, sf_dir):
    """Neighbours of every twentieth embedding; relevant are all embeddings of the same label."""
    v = corpus(spark, sf_dir)
    hits = dense.knn(v, asked(v), K).select("query_id", "doc_id", "rank")
    return E.judged_by_label(hits, asked(v), v)


def _metrics(spark, sf_dir):
    return E.retrieval_metrics(_judged(spark, sf_dir))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pick(name, *columns):
    def query(spark, sf_dir):
        return _rounded(_metrics(spark, sf_dir).select("query_id", *columns))

    query.__name__ = name
    return query


def evaluate_retrieval(spark, sf_dir):
    return _rounded(E.evaluate_retrieval(_metrics(spark, sf_dir)).select("queries", "recall_5", "precision_5", "ndcg_5", "mrr", "average_precision"))


def evaluate_search_run(spark, sf_dir):
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("latency_ms"))
    return _rounded(E.evaluate_search_run(_metrics(spark, sf_dir), times))


def _answers(spark, sf_dir):
    return interactions(spark, sf_dir)


def faithfulness(spark, sf_dir):
    return _rounded(_answers(spark, sf_dir).select("id", E.faithfulness().alias("faithfulness")))


def answer_relevance(spark, sf_dir):
    return _rounded(_answers(spark, sf_dir).select("id", E.answer_relevance().alias("relevance")))


def answer_coherence(spark, sf_dir):
    return _rounded(_answers(spark, sf_dir).select("id", E.answer_coherence().alias("coherence")))


def informativeness(spark, sf_dir):
    return _rounded(_answers(spark, sf_dir).select("id", E.informativeness().alias("informativeness")))


def evaluate_rag(spark, sf_dir):
    return _rounded(E.evaluate_rag(_answers(spark, sf_dir)))


def _pairs(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", F.col("response").alias("candidate"), F.coalesce("doc1", F.lit("")).alias("reference"))


def bleu(spark, sf_dir):
    return _rounded(E.bleu(_pairs(spark, sf_dir)))


def rouge(spark, sf_dir):
    return _rounded(E.rouge_n(_pairs(spark, sf_dir), 2))


def rouge_l(spark, sf_dir):
    return _rounded(E.rouge_l(_pairs(spark, sf_dir)))


def evaluate_generation(spark, sf_dir):
    return _rounded(E.evaluate_generation(_pairs(spark, sf_dir)))


def _embedding_pairs(spark, sf_dir):
    v = corpus(spark, sf_dir)
    return v.select("doc_id", F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"))


def embedding_score(spark, sf_dir):
    return _rounded(_embedding_pairs(spark, sf_dir).select("doc_id", E.embedding_score(F.col("a"), F.col("b")).alias("score")))


def groundedness(spark, sf_dir):
    return _rounded(_embedding_pairs(spark, sf_dir).select("doc_id", E.groundedness(F.col("a"), F.col("b")).alias("score")))


def _requests(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return E.request_log(e.select("event_id", "ts", F.col("value").alias("response_ms"), (F.col("event_id") % 7).cast("double").alias("memory_mb"), (F.col("event_type") == "error").alias("error")))


def request_log(spark, sf_dir):
    return _requests(spark, sf_dir).select("event_id", "response_ms", "memory_mb", "error")


def request_stats(spark, sf_dir):
    return _rounded(E.request_stats(_requests(spark, sf_dir)))


def _runs(spark, sf_dir):
    """A run a customer: scores from its balance and key."""
    c = read(spark, sf_dir, "customer")
    x = F.pmod(F.col("c_custkey") * 37, F.lit(100)) / 100
    runs = c.select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("experiment"), F.col("c_custkey").alias("ts"), x.alias("retrieval"), (1 - x * 0.5).alias("generation"), (0.3 + x * 0.4).alias("rag"), (F.abs("c_acctbal") / 7).alias("mean_ms"))
    return E.overall_score(runs)


def overall_score(spark, sf_dir):
    return _rounded(_runs(spark, sf_dir).select("run_id", "overall"))


def evaluate_all(spark, sf_dir):
    retrieval = E.evaluate_retrieval(_metrics(spark, sf_dir))
    return _rounded(E.evaluate_all(retrieval, E.evaluate_generation(_pairs(spark, sf_dir)), E.evaluate_rag(_answers(spark, sf_dir)), E.request_stats(_requests(spark, sf_dir)), "run"))


def compare_baseline(spark, sf_dir):
    return _rounded(E.compare_baseline(_runs(spark, sf_dir), 0))


def run_trends(spark, sf_dir):
    return _rounded(E.run_trends(_runs(spark, sf_dir), "experiment"))


def recommendations(spark, sf_dir):
    own = _runs(spark, sf_dir).withColumn("recall_5", F.col("retrieval")).withColumn("precision_5", F.col("rag"))
    return E.recommendations(own).select("run_id", F.array_join("advice", "|").alias("advice"))


def grade_run(spark, sf_dir):
    return E.grade_run(_runs(spark, sf_dir), ("retrieval", "generation", "rag", "overall")).select("run_id", "grade")


def source_analysis(spark, sf_dir):
    v = corpus(spark, sf_dir)
    out = fusion.fuse_weighted(dense.knn(v, asked(v), K), dense.knn(v, asked(v), K, "dot"))
    return _rounded(E.source_analysis(out.withColumn("score", F.round("combined_score", 6))))


def compare_modes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.when(F.col("user_id") % 2 == 0, "basic").otherwise("enhanced").alias("mode"), F.col("value").alias("latency"), (F.col("event_id") % 10 / 10).alias("recall"))
    return _rounded(E.compare_modes(e, ("latency", "recall")))


def ab_assign(spark, sf_dir):
    return E.ab_assign(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")))


def _ab(spark, sf_dir):
    own = E.ab_assign(_runs(spark, sf_dir).withColumnRenamed("run_id", "user_id"))
    return own.select("experiment", "user_id", "arm", (F.col("overall") + F.when((F.col("arm") == "A") & (F.col("experiment") == "BUILDING"), 0.2).otherwise(0.0)).alias("score"))


def ab_runs(spark, sf_dir):
    known = read(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("experiment"))
    return E.ab_runs(_ab(spark, sf_dir), known).select("experiment", "user_id", "arm")


def ab_analyze(spark, sf_dir):
    return _rounded(E.ab_analyze(_ab(spark, sf_dir)))


def ab_message(spark, sf_dir):
    return E.ab_message(E.ab_analyze(_ab(spark, sf_dir))).select("experiment", "message")


def ab_significance(spark, sf_dir):
    return _rounded(E.with_p_value(E.ab_analyze(_ab(spark, sf_dir))).select("experiment", "p_value", "significant"))


_J = """with v as (select vec_id as doc_id, cast(embedding as double[]) as vec, label from embeddings),
h as (select query_id, doc_id, row_number() over (partition by query_id order by round(s, 6) desc, doc_id) as rank from (select q.doc_id as query_id, v.doc_id, list_cosine_similarity(q.vec, v.vec) as s from v q, v where q.doc_id % 20 = 0) qualify rank <= 10),
g as (select q.doc_id as query_id, v.doc_id from v q join v on q.label = v.label where q.doc_id % 20 = 0),
n as (select query_id, count(*) as n from g group by query_id),
j as (select h.query_id, h.rank, n, case when g.doc_id is null then 0 else 1 end as rel from h join n using (query_id) left join g on h.query_id = g.query_id and h.doc_id = g.doc_id),
js as (select *, sum(rel) over (partition by query_id order by rank) as seen from j),
m as (select query_id, """ + ", ".join(f"sum(case when rank <= {k} then rel else 0 end) / any_value(n) as recall_{k}, sum(case when rank <= {k} then rel else 0 end) / count(*) filter (where rank <= {k}) as precision_{k}, sum(case when rank <= {k} then rel / log2(rank + 1) else 0 end) / (select sum(1 / log2(i + 1)) from range(1, 1 + cast(least({k}, any_value(n)) as bigint)) r(i)) as ndcg_{k}" for k in (1, 3, 5, 10)) + """,
  coalesce(1 / min(case when rel = 1 then rank end), 0) as mrr, sum(case when rel = 1 then seen / rank else 0 end) / any_value(n) as average_precision from js group by query_id)"""


def _sel(*cs):
    return ", ".join(f"round({c}, 6) as {c}" for c in cs)


_W = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"
_A = rf"""with i as (select id, response, {_W.format('response')} as w, {_W.format('query')} as q, {_W.format("coalesce(doc1 || ' ' || doc2, '')")} as c, list_filter(list_transform(string_split(response, '.'), lambda x: trim(x)), lambda x: x <> '') as s, list_filter(regexp_split_to_array(response, '\s+'), lambda x: x <> '') as raw from interactions),
p as (select id, case when len(w) = 0 then 0 else len(list_intersect(list_distinct(w), list_distinct(c))) / len(list_distinct(w)) end as faithfulness,
  case when len(q) = 0 then 0 else len(list_intersect(list_distinct(q), list_distinct(w))) / len(list_distinct(q)) end as relevance,
  case when len(s) = 0 then 0 else least(1, case when len(s) > 1 then 0.3 / (1 + list_var_samp(list_transform(s, lambda x: cast(len(list_filter(string_split(x, ' '), lambda y: y <> '')) as double))) / 100) else 0.3 end
    + 0.2 * least(1, len(list_intersect(list_distinct(w), [{', '.join(f"'{t}'" for t in E.TRANSITIONS)}])) / greatest(1, len(s) - 1)) + 0.5 * case when len(w) between 10 and 200 then 1 when len(w) < 10 then len(w) / 10 else greatest(0.5, 200 / len(w)) end) end as coherence,
  case when len(w) = 0 then 0 else least(1, 0.4 * len(list_distinct(w)) / len(w) + 0.3 * (len(list_filter(raw, lambda x: regexp_matches(x, '[0-9]'))) + len(list_filter(raw, lambda x: regexp_matches(x, '^[A-Z].')))) / len(w) + 0.15) end as informativeness from i)"""
_R = """with r as (select c_custkey as run_id, c_mktsegment as experiment, (c_custkey * 37 % 100) / 100 as x, abs(c_acctbal) / 7 as ms from customer),
o as (select run_id, experiment, x as retrieval, 1 - x * 0.5 as generation, 0.3 + x * 0.4 as rag, greatest(0, least(1, 0.3 * x + 0.25 * (1 - x * 0.5) + 0.35 * (0.3 + x * 0.4) + 0.1 * greatest(0, 1 - ms / 1000))) as overall from r)"""
_AB = f"""{_R}, u as (select *, case when (cast('0x' || substr(md5(cast(run_id as varchar)), 1, 8) as bigint) % 100) / 100 < 0.5 then 'A' else 'B' end as arm from o),
y as (select experiment, run_id as user_id, arm, overall + case when arm = 'A' and experiment = 'BUILDING' then 0.2 else 0 end as score from u),
st as (select experiment, avg(score) filter (where arm = 'A') as am, avg(score) filter (where arm = 'B') as bm, var_samp(score) filter (where arm = 'A') as av, var_samp(score) filter (where arm = 'B') as bv, count(*) filter (where arm = 'A') as an, count(*) filter (where arm = 'B') as bn from y group by experiment),
t as (select *, (am - bm) / sqrt(((an - 1) * av + (bn - 1) * bv) / (an + bn - 2) * (1 / an + 1 / bn)) as t, case when am > bm then 'A' else 'B' end as winner from st where an > 0 and bn > 0)"""
SQL = {
    "recall_at_k": f"{_J} select query_id, {_sel('recall_1', 'recall_3', 'recall_5', 'recall_10')} from m",
    "precision_at_k": f"{_J} select query_id, {_sel('precision_1', 'precision_3', 'precision_5', 'precision_10')} from m",
    "ndcg_at_k": f"{_J} select query_id, {_sel('ndcg_1', 'ndcg_3', 'ndcg_5', 'ndcg_10')} from m",
    "mrr": f"{_J} select query_id, {_sel('mrr')} from m",
    "average_precision": f"{_J} select query_id, {_sel('average_precision')} from m",
    "evaluate_retrieval": f"{_J} select count(*) as queries, {', '.join(f'round(avg({c}), 6) as {c}' for c in ('recall_5', 'precision_5', 'ndcg_5', 'mrr', 'average_precision'))} from m",
    "evaluate_search_run": f"{_J} select round(avg(recall_5), 6) as recall_5, round(avg(mrr), 6) as mrr, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99 from m join events on query_id = event_id",
    "faithfulness": f"{_A} select id, {_sel('faithfulness')} from p",
    "answer_relevance": f"{_A} select id, {_sel('relevance')} from p",
    "answer_coherence": f"{_A} select id, {_sel('coherence')} from p",
    "informativeness": f"{_A} select id, {_sel('informativeness')} from p",
    "evaluate_rag": f"{_A} select count(*) as n, {', '.join(f'round(avg({c}), 6) as {c}' for c in ('faithfulness', 'relevance', 'coherence', 'informativeness'))}, round((avg(faithfulness) + avg(relevance) + avg(coherence) + avg(informativeness)) / 4, 6) as overall from p",
    "rouge": rf"""with i as (select id, {_W.format('response')} as x, {_W.format("coalesce(doc1, '')")} as y from interactions),
      b as (select id, list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]) as x, list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1]) as y from i),
      e as (select id, g, count(*) filter (where s = 1) as a, count(*) filter (where s = 2) as b from (select id, unnest(x) as g, 1 as s from b union all select id, unnest(y), 2 from b) group by id, g),
      c as (select id, sum(least(a, b)) as m from e group by id), f as (select b.id, coalesce(m, 0) as m, len(x) as nx, len(y) as ny from b left join c on b.id = c.id),
      z as (select id, case when nx = 0 then 0 else m / nx end as precision, case when ny = 0 then 0 else m / ny end as recall from f)
      select id, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f from z""",
    "embedding_score": "select vec_id as doc_id, round(list_cosine_similarity(cast(embedding as double[])[1:32], cast(embedding as double[])[33:64]), 6) as score from embeddings",
    "groundedness": "select vec_id as doc_id, round(greatest(0, least(1, list_cosine_similarity(cast(embedding as double[])[1:32], cast(embedding as double[])[33:64]))), 6) as score from embeddings",
    "request_log": "select event_id, value as response_ms, nullif(cast(event_id % 7 as double), 0) as memory_mb, event_type = 'error' as error from events",
    "request_stats": """select count(*) as requests, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, round(quantile_cont(value, 0.99), 6) as p99_ms, cast(max(nullif(event_id % 7, 0)) as double) as peak_mb, round(avg(nullif(event_id % 7, 0)), 6) as mean_mb,
      round(avg(case when event_type = 'error' then 1 else 0 end), 6) as error_rate, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 6) as qps from events""",
    "overall_score": f"{_R} select run_id, {_sel('overall')} from o",
    "compare_baseline": f"{_R} select o.run_id, {', '.join(f'round(o.{c} - b.{c}, 6) as {c}_diff' for c in ('retrieval', 'generation', 'rag', 'overall'))} from o, (select * from o where run_id = 0) b where o.run_id <> 0",
    "run_trends": f"{_R} select experiment, run_id, case when last_value(overall) over w > first_value(overall) over w then 'improving' else 'declining' end as trend, round(avg(overall) over w, 6) as mean, round(stddev_pop(overall) over w, 6) as deviation from o window w as (partition by experiment order by run_id rows between 4 preceding and current row)",
    "recommendations": f"{_R} select run_id, concat_ws('|', case when retrieval < 0.7 then 'Improve retrieval recall' end, case when rag < 0.6 then 'Improve retrieval precision' end, case when rag < 0.7 then 'Improve answer quality' end, case when generation < 0.6 then 'Improve generation quality' end) as advice from o",
    "grade_run": f"{_R} select run_id, case when (retrieval + generation + rag + overall) / 4 >= 0.8 then 'Excellent' when (retrieval + generation + rag + overall) / 4 >= 0.7 then 'Good' when (retrieval + generation + rag + overall) / 4 >= 0.6 then 'Fair' else 'Needs Improvement' end as grade from o",
    "compare_modes": "select round(avg(value) filter (where user_id % 2 = 1) - avg(value) filter (where user_id % 2 = 0), 6) as latency_diff, round(avg(event_id % 10 / 10) filter (where user_id % 2 = 1) - avg(event_id % 10 / 10) filter (where user_id % 2 = 0), 6) as recall_diff from events",
    "ab_assign": f"{_AB} select run_id as user_id, arm from u",
    "ab_runs": f"{_AB} select experiment, user_id, arm from y where experiment <> 'MACHINERY'",
    "ab_analyze": f"{_AB} select experiment, round(am, 6) as A_mean, round(bm, 6) as B_mean, an as A_n, bn as B_n, winner, round(abs(am - bm), 6) as gap, round(t, 6) as t from t",
    "ab_message": f"{_AB} select experiment, case when abs(t) > 1.96 then 'Configuration ' || winner || ' is significantly better by ' || printf('%.1f', abs(am - bm) / least(am, bm) * 100) || '%. Recommend deploying ' || winner || '.' else 'No statistically significant difference found. More data may be needed.' end as message from t",
}
QUERIES = {n: _pick(n, *(f"{c}_{k}" for k in (1, 3, 5, 10))) for n, c in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("ndcg_at_k", "ndcg"))} | {n: _pick(n, n) for n in ("mrr", "average_precision")}
SQL["source_analysis"] = f"""{_LISTS}, {_MM}, s as (select source, count(*) as n, avg(round(c, 6)) as mean, quantile_cont(round(c, 6), 0.5) as median, stddev_pop(round(c, 6)) as deviation from fused group by source)
select source, n, round(mean, 6) as mean, round(median, 6) as median, round(deviation, 6) as deviation, round(n / sum(n) over (), 6) as share from s"""
QUERIES |= {f.__name__: f for f in (evaluate_retrieval, evaluate_search_run, faithfulness, answer_relevance, answer_coherence, informativeness, evaluate_rag, bleu, rouge, rouge_l, evaluate_generation, embedding_score, groundedness, request_log, request_stats, overall_score, evaluate_all, compare_baseline, run_trends, recommendations, grade_run, source_analysis, compare_modes, ab_assign, ab_runs, ab_analyze, ab_message, ab_significance)}
