"""Queries of answer-quality monitoring over interactions built from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..sources.shared import kept
from .inputs import read

AS_OF = "2000-06-01 00:00:00"


def interactions(spark, sf_dir):
    docs = F.when(F.col("doc1").isNull(), F.array().cast("array<string>")).otherwise(F.array("doc1", "doc2"))
    return read(spark, sf_dir, "interactions").withColumn("docs", docs)


def _metric(name, c):
    def query(spark, sf_dir):
        return interactions(spark, sf_dir).select("id", F.round(c(), 6).alias(name))

    query.__name__ = name
    return query


def scored(spark, sf_dir):
    return M.score_interactions(interactions(spark, sf_dir))


def confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("confidence", 6).alias("confidence"))


def hallucination_risk(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("hallucination_risk", 6).alias("hallucination_risk"))


def score_interactions(spark, sf_dir):
    return scored(spark, sf_dir).select("id", *(F.round(c, 6).alias(c) for c in ("grounding", "confidence", "hallucination_risk", "overall")))


def quality_alerts(spark, sf_dir):
    return M.quality_alerts(scored(spark, sf_dir)).select("id", "metric", "level", F.round("value", 6).alias("value"))


def degradation(spark, sf_dir):
    own = kept(scored(spark, sf_dir).select("id", "ts", "overall"), "scores")
    return M.degradation(own).select("id", F.round("recent", 6).alias("recent"), F.round("base", 6).alias("base"), "degraded")


def feedback(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").otherwise("rating")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", kind.alias("type"), (1 + F.col("event_id") % 5).alias("rating"))


def satisfaction(spark, sf_dir):
    return M.satisfaction(feedback(spark, sf_dir), "2024-01-05 00:00:00").select("n", F.round("satisfaction", 6).alias("satisfaction"), "alert")


def quality_summary(spark, sf_dir):
    own = kept(scored(spark, sf_dir).select("id", "ts", "overall", "confidence", "hallucination_risk", "grounding"), "scores")
    one = M.quality_summary(own, M.quality_alerts(own), AS_OF, 24 * 365)
    return one.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes))


def open_alerts(spark, sf_dir):
    alerts = kept(M.quality_alerts(scored(spark, sf_dir)), "alerts")
    return M.open_alerts(alerts, alerts.filter("id % 3 = 0").select("id", "metric")).select("id", "metric", "level")


def retention(spark, sf_dir):
    return M.retention(interactions(spark, sf_dir), AS_OF, 24 * 300).select("id")


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _has(words, c="low"):
    return "(" + " + ".join(f"cast(contains({c}, {_lit(w)}) as int)" for w in words) + ")"


def _words(c):
    return rf"list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> '')"


_BASE = rf"""with i as (select id, ts, query, response, doc1 is null as nodocs, coalesce(doc1 || ' ' || doc2, '') as c, lower(response) as low, lower(coalesce(doc1 || ' ' || doc2, '')) as lc,
  {_words('response')} as w, {_words('query')} as q, {_words("coalesce(doc1 || ' ' || doc2, '')")} as cw,
  list_filter(list_transform(string_split(response, '.'), lambda x: trim(x)), lambda x: x <> '') as s,
  regexp_extract_all(response, '{M.NUMBER}') as nums, regexp_extract_all(coalesce(doc1 || ' ' || doc2, ''), '{M.NUMBER}') as cnums, regexp_extract_all(response, '{M.NAME}') as names from interactions),
j as (select *, list_distinct(w) as ws, list_distinct(q) as qs, list_distinct(cw) as cs, len(s) as n, len(w) as nw,
  list_transform(s, lambda x: cast(len(list_filter(string_split(x, ' '), lambda y: y <> '')) as double)) as ls from i),
k as (select *,
  case when len(qs) = 0 then 0 else len(list_intersect(qs, ws)) / len(qs) end as semantic_overlap,
  case when nodocs or len(ws) = 0 then 0 else least(1, len(list_intersect(ws, cs)) / len(ws) + least(0.2, 0.05 * len(list_intersect(list_distinct(nums), list_distinct(cnums))))) end as grounding,
  (case when nw < 5 then 0.2 when nw > 300 then 0.8 when nw between 10 and 200 then 1.0 else 0.7 end
   + {' * '.join(f"case when {_has(g)} = 0 then power(0.8, len(list_filter(q, lambda x: x = {_lit(a)}))) else 1 end" for a, g in M.ANSWERS.items())}) / 2 as completeness,
  greatest(0, least(1, 0.5 + least(0.2, {_has(M.HEDGES)} * 0.05) + least(0.3, {_has(M.CITATIONS)} * 0.1) - case when nodocs then least(0.3, {_has(M.ABSOLUTES)} * 0.1) else 0 end)) as factual_score,
  case when trim(response) = '' then 0 when n = 0 then 0.1 else (case when n > 1 then 1 - least(1, list_var_samp(ls) / 100) else 0.8 end
   + least(1, len(list_intersect(ws, [{', '.join(map(_lit, M.CONNECTORS))}])) / greatest(1, n - 1)) + case when nw = 0 then 0 else len(ws) / nw end) / 3 end as coherence,
  case when nodocs then 0.8 else (case when len(nums) = 0 then 0 else len(list_filter(nums, lambda x: not list_contains(regexp_extract_all(lc, '{M.NUMBER}'), x))) / len(nums) end
   + case when len(names) = 0 then 0 else len(list_filter(names, lambda x: not contains(lc, lower(x)))) / len(names) end) / 2 end as unsupported_claims,
  0.5 as semantic_drift,
  case when {_has(M.SPECIFIC)} = 0 then 0 else least(1, {_has(M.SPECIFIC)} * 0.2 * (1 - case when len(ws) = 0 then 0 else len(list_intersect(ws, cs)) / len(ws) end)) end as ungrounded_specificity,
  least(1, {' + '.join(f"case when contains(low, '{a}') and contains(lc, '{b}') or contains(low, '{b}') and contains(lc, '{a}') then 0.1 else 0 end" for a, b in M.OPPOSED)}) as contradictions from j),
m as (select *, greatest(0, least(1, 0.35 * grounding + 0.15 * completeness + 0.15 * factual_score + 0.1 * coherence)) as confidence,
  case when nodocs then 0.8 else greatest(0, least(1, 0.4 * unsupported_claims + 0.15 + 0.2 * ungrounded_specificity + 0.1 * contradictions)) end as hallucination_risk from k),
z as (select *, (confidence + 1 - hallucination_risk + grounding + completeness + coherence) / 5 as overall from m)"""
_ALERTS = f"""{_BASE}, a as ({' union all '.join(f"select id, ts, '{m}' as metric, '{lv}' as level, {m} as value from z where round({m}, 6) {'>' if above else '<'} {b}" for m, b, above, lv in M.THRESHOLDS)}),
before as (select id, ts, sum(c) over (partition by date_trunc('hour', ts) order by ts, id rows between unbounded preceding and 1 preceding) as b from (select id, ts, count(*) as c from a group by id, ts)),
alerts as (select a.* from a join before using (id) where coalesce(b, 0) < 10)"""
_IN = f"ts <= timestamp '{AS_OF}' and epoch(timestamp '{AS_OF}') - epoch(ts) <= {24 * 365} * 3600"
METRICS = {n: getattr(M, n) for n in ("semantic_overlap", "grounding", "completeness", "factual_score", "coherence", "unsupported_claims", "semantic_drift", "ungrounded_specificity", "contradictions")}
SQL = {n: f"{_BASE} select id, round({n}, 6) as {n} from z" for n in (*METRICS, "confidence", "hallucination_risk")} | {
    "score_interactions": f"{_BASE} select id, round(grounding, 6) as grounding, round(confidence, 6) as confidence, round(hallucination_risk, 6) as hallucination_risk, round(overall, 6) as overall from z",
    "quality_alerts": f"{_ALERTS} select id, metric, level, round(value, 6) as value from alerts",
    "degradation": f"""{_BASE}, d as (select id, avg(overall) over (order by epoch(ts) range between 1800 preceding and current row) as recent, count(*) over (order by epoch(ts) range between 1800 preceding and current row) as n,
      avg(overall) over (order by ts, id rows between 99 preceding and current row) as base, row_number() over (order by ts, id) as seen from z)
      select id, round(recent, 6) as recent, round(base, 6) as base, n >= 5 and seen > 100 and round(recent - base, 6) < -0.15 as degraded from d""",
    "satisfaction": """with f as (select case event_type when 'click' then 1.0 when 'error' then 0.0 else (1 + event_id % 5) / 5 end as v from events where ts <= timestamp '2024-01-05' and floor(epoch(timestamp '2024-01-05')) - floor(epoch(ts)) <= 86400)
      select count(*) as n, round(avg(v), 6) as satisfaction, round(avg(v), 6) < 0.6 as alert from f having count(*) >= 10""",
    "quality_summary": f"""{_ALERTS} select * from (select count(*) as n, {', '.join(f"round({f}({m}), 6) as {n}_{m}" for m in ('overall', 'confidence', 'hallucination_risk') for n, f in (('avg', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max')))} from z where {_IN}),
      (select count(*) as alerts, count(*) filter (where level = 'warning') as alerts_warning, count(*) filter (where level = 'critical') as alerts_critical from alerts where {_IN})""",
    "open_alerts": f"{_ALERTS} select id, metric, level from alerts where id % 3 <> 0",
    "retention": f"select id from interactions where date_trunc('hour', ts) >= timestamp '{AS_OF}' - interval {24 * 300} hour",
}
QUERIES = {n: _metric(n, c) for n, c in METRICS.items()} | {f.__name__: f for f in (confidence, hallucination_risk, score_interactions, quality_alerts, degradation, satisfaction, quality_summary, open_alerts, retention)}
