"""Queries of the query-log operators over questions built from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query_log as Q
from .inputs import read


def _log(spark, sf_dir):
    return read(spark, sf_dir, "query_log").select("query_id", "text")


def _joined(df, column):
    return df.select("query_id", F.array_join(column, "|").alias(column))


def classify_queries(spark, sf_dir):
    return Q.classify_queries(_log(spark, sf_dir)).select("query_id", "query_type", "intent", F.round("confidence", 6).alias("confidence"), F.round("complexity_score", 6).alias("complexity_score"))


def query_entities(spark, sf_dir):
    return _joined(Q.query_entities(_log(spark, sf_dir)), "entities")


def query_keywords(spark, sf_dir):
    return _joined(Q.query_keywords(_log(spark, sf_dir)), "keywords")


def query_temporal(spark, sf_dir):
    return _joined(Q.query_temporal(_log(spark, sf_dir)), "temporal")


def query_domains(spark, sf_dir):
    return _joined(Q.query_domains(_log(spark, sf_dir)), "domains")


def expand_synonyms(spark, sf_dir):
    return _joined(Q.expand_synonyms(_log(spark, sf_dir)), "synonyms")


def expand_domain(spark, sf_dir):
    return _joined(Q.expand_domain(_log(spark, sf_dir)), "domain_terms")


def expand_hierarchy(spark, sf_dir):
    return _joined(Q.expand_hierarchy(_log(spark, sf_dir)), "hierarchy")


def expand_temporal(spark, sf_dir):
    return _joined(Q.expand_temporal(_log(spark, sf_dir)), "temporal_variants")


def expand_semantic(spark, sf_dir):
    return _joined(Q.expand_semantic(_log(spark, sf_dir)), "variations")


def expand_queries(spark, sf_dir):
    return Q.expand_queries(_log(spark, sf_dir)).select("query_id", F.array_join("new_terms", "|").alias("new_terms"), "combined")


def route_queries(spark, sf_dir):
    return Q.route_queries(_log(spark, sf_dir)).select("query_id", "agent", "affinity", "optimized", F.col("rank").cast("long").alias("rank"))


def process_query_log(spark, sf_dir):
    return Q.process_query_log(_log(spark, sf_dir)).select("query_id", "query_type", "intent", F.size("new_terms").cast("long").alias("n_new"), F.size("keywords").cast("long").alias("n_keywords"), F.size("domains").cast("long").alias("n_domains"), "agent")


def suggest_queries(spark, sf_dir):
    log = read(spark, sf_dir, "query_log")
    return Q.suggest_queries(read(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 3 == 0, "how to ").otherwise(""), F.substring(F.lower("n_name"), 1, 8)).alias("prefix")), log).select("prefix", "suggestion", F.col("rank").cast("long").alias("rank"))


def query_complexity(spark, sf_dir):
    return Q.query_complexity(_log(spark, sf_dir)).select("query_id", "level", F.round("level_confidence", 6).alias("level_confidence"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(words, c="t") -> str:
    return "(" + " + ".join(f"cast(contains({c}, {_lit(w)}) as int)" for w in words) + ")"


def _rx(patterns, c="t") -> str:
    return "(" + " + ".join(f"cast(regexp_matches({c}, {_lit(p)}) as int)" for p in patterns) + ")"


def _best(scores: dict[str, str]) -> tuple[str, str]:
    top = f"greatest({', '.join(scores.values())})"
    return "case " + " ".join(f"when {s} = {top} then '{n}'" for n, s in scores.items()) + " end", top


_KIND, _KS = _best({n: f"round({_rx(p)} * 0.4 + {_has(k)} * 0.2, 6)" for n, (p, k) in Q.TYPES.items()})
_INTENT, _IS = _best({n: f"round({_rx(p)} * 0.5 + {_has(k)} * 0.3, 6)" for n, (p, k) in Q.INTENTS.items()})
_W = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
_L = f"with l as (select query_id, text, lower(text) as t, {_W} as w from query_log)"
_CLASS = f"{_L}, c as (select *, {_KIND} as query_type, {_INTENT} as intent, least({_KS}, 1) as ks, least({_IS}, 1) as iz from l)"
_CX = " + ".join(f"len(regexp_extract_all({'text' if p == '[,;]' else 't'}, {_lit(p)})) * {w}" for p, w in Q.COMPLEXITY_PARTS)
_LEVEL, _LS = _best({n: f"round({_has(k)} * 0.3 + {_rx(p)} * 0.4 + case when len(list_distinct(w)) / len(w) >= {c / 10} then 0.2 else 0 end + case when len(list_filter(w, lambda x: x in ('what','how','why','when','where','who'))) >= {q} then 0.1 else 0 end, 6)" for n, (k, p, c, q) in Q.LEVELS.items()})


def _made(rows: list[tuple[str, str]], limit: int) -> str:
    """rows: (condition, value) in order."""
    return f"list_slice(list_filter([{', '.join(f'case when {c} then {v} end' for c, v in rows)}], lambda x: x is not null), 1, {limit})"


_SYN = _made([(f"list_contains(w, {_lit(t)})", f"replace(t, {_lit(t)}, {_lit(e)})") for t, own in Q.SYNONYMS.items() for e in own], 5)
_NODOM = "(" + " + ".join(_has(k) for k in Q.DOMAINS.values()) + ") = 0"
_DOM = _made([(f"({_has(Q.DOMAINS[d])} > 0" + (f" or {_NODOM}" if d != "operations" else "") + f") and contains(t, {_lit(t)})", f"replace(t, {_lit(t)}, {_lit(e)})") for d, terms in Q.DOMAIN_TERMS.items() for t, own in terms.items() for e in own], 5)
_HIER = _made([x for p, ch in Q.HIERARCHY.items() for x in [(f"contains(t, {_lit(p)})", f"text || {_lit(' ' + c)}") for c in ch] + [(f"not contains(t, {_lit(p)}) and {_has(ch)} > 0", f"text || {_lit(' ' + p)}")]], 3)
_TEMP = f"list_sort(list_distinct(flatten([{', '.join(f'regexp_extract_all(t, {_lit(p)})' for p in Q.TEMPORAL)}])))"
_VAR = _made([(f"(query_type = {_lit(k)} or intent = {_lit(k)}) and " + (f"starts_with(t, {_lit(t)})" if k == "factual" else f"contains(t, {_lit(t)})"), f"replace(text, {_lit(t)}, {_lit(e)})") for k, t, e in Q.VARIATIONS], 4)
_NEW = f"list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(list_concat(list_concat({_SYN}, {_DOM}), list_concat({_HIER}, {_VAR})), ' ')), '\\s+'), lambda x: x <> '')), lambda x: not list_contains(w, x)))"
_ROUTE = f"""{_CLASS}, r as (""" + " union all ".join(
    f"select query_id, {n} as n, '{a}' as agent, round(least(len(list_intersect(w, [{', '.join(map(_lit, k))}])) * 0.3 + case when query_type in ({', '.join(map(_lit, ty))}) then 0.4 else 0 end + case when intent in ({', '.join(map(_lit, it))}) then 0.3 else 0 end, 1), 6) as affinity, case when contains(t, '{h.split()[0]}') then text else '{h}: ' || text end as optimized from c"
    for n, (a, (k, ty, it, h)) in enumerate(Q.AGENTS.items())
) + "), routed as (select query_id, agent, affinity, optimized, row_number() over (partition by query_id order by affinity desc, n) as rank from r where affinity > 0.3 qualify rank <= 3)"
_STOPS = ", ".join(map(_lit, Q.STOP_WORDS))
_KEYS = rf"list_filter(regexp_extract_all(t, '\b\w+\b'), lambda x: length(x) >= 3 and x not in ({_STOPS}))"
_DOMS = "list_filter([" + ", ".join(f"case when {_has(k)} > 0 then '{d}:' || {_has(k)} end" for d, k in Q.DOMAINS.items()) + "], lambda x: x is not null)"

SQL = {
    "classify_queries": f"{_CLASS} select query_id, query_type, intent, round((ks + iz) / 2, 6) as confidence, round(least({_CX} + least(len(w) / 20, 0.3), 1), 6) as complexity_score from c",
    "query_entities": _L + rf""" select query_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '{Q.ENTITY[0][0]}'), regexp_extract_all(text, '{Q.ENTITY[1][0]}', 1)), list_filter(regexp_extract_all(text, '{Q.TECHNICAL}'), lambda x: length(x) > 2)))), '|') as entities from l""",
    "query_keywords": f"{_L} select query_id, array_to_string({_KEYS}, '|') as keywords from l",
    "query_temporal": f"{_L} select query_id, array_to_string({_TEMP}, '|') as temporal from l",
    "query_domains": f"{_L} select query_id, array_to_string({_DOMS}, '|') as domains from l",
    "expand_synonyms": f"{_L} select query_id, array_to_string({_SYN}, '|') as synonyms from l",
    "expand_domain": f"{_L} select query_id, array_to_string({_DOM}, '|') as domain_terms from l",
    "expand_hierarchy": f"{_L} select query_id, array_to_string({_HIER}, '|') as hierarchy from l",
    "expand_temporal": f"{_L}, x as (select query_id, text, array_to_string({_TEMP}, ' ') as z from l) select query_id, case when contains(z, 'recent') or contains(z, 'current') then text || ' past 3 months|' || text || ' year to date' else '' end as temporal_variants from x",
    "expand_semantic": f"{_CLASS} select query_id, array_to_string({_VAR}, '|') as variations from c",
    "expand_queries": f"{_CLASS}, n as (select query_id, text, {_NEW} as new_terms from c) select query_id, array_to_string(new_terms, '|') as new_terms, case when len(new_terms) > 0 then text || ' ' || array_to_string(list_slice(new_terms, 1, 8), ' ') else text end as combined from n",
    "route_queries": f"{_ROUTE} select query_id, agent, affinity, optimized, rank from routed",
    "process_query_log": f"{_ROUTE} select c.query_id, query_type, intent, cast(len({_NEW}) as bigint) as n_new, cast(len({_KEYS}) as bigint) as n_keywords, cast(len({_DOMS}) as bigint) as n_domains, agent from c left join (select query_id, agent from routed where rank = 1) b on c.query_id = b.query_id",
    "suggest_queries": """with top100 as (select text, ts, query_id from query_log order by ts desc, query_id desc limit 100),
      r as (select text, min(epoch(ts) * 100000000 + query_id) as place from top100 group by text),
      p as (select distinct (case when n_nationkey % 3 = 0 then 'how to ' else '' end) || substr(lower(n_name), 1, 8) as prefix from nation),
      h as (select prefix, text as suggestion, 0 as n, place from p join r on contains(lower(text), prefix)
            union all select prefix, prefix || [' improve efficiency', ' optimize process', ' best practices'][i], i, 0 from p, range(1, 4) s(i) where contains(prefix, 'how to'))
      select prefix, suggestion, row_number() over (partition by prefix order by n, place) as rank from h qualify rank <= 5""",
    "query_complexity": f"{_L} select query_id, {_LEVEL} as level, round(least({_LS}, 1), 6) as level_confidence from l",
}
QUERIES = {f.__name__: f for f in (classify_queries, query_entities, query_keywords, query_temporal, query_domains, expand_synonyms, expand_domain, expand_hierarchy, expand_temporal, expand_semantic, expand_queries, route_queries, process_query_log, suggest_queries, query_complexity)}
