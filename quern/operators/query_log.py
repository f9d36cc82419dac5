"""Analysis, expansion and routing of a query table (query_id, text), a job over all its rows at once.

Rules are small fixed tables. They are folded into column expressions, or joined as bounded literal tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import best_of, contained, matched, once, words
from ..sources.shared import kept
from .skew import join_groups

# Word lists and patterns of the rules, in the order in which the first of equal scores wins.
TYPES = {
    "factual": ([r"\bwhat\s+(is|are|was|were)\b", r"\bwho\s+(is|are|was|were)\b", r"\bwhen\s+(is|are|was|were|did|does)\b", r"\bwhere\s+(is|are|was|were)\b", r"\bdefine\b", r"\bdefinition\b"], ["what", "who", "when", "where", "define", "fact", "information"]),
    "analytical": ([r"\banalyze\b", r"\banalysis\b", r"\bexamine\b", r"\bevaluate\b", r"\bassess\b", r"\breview\b"], ["analyze", "analysis", "examine", "evaluate", "assess", "insights", "trends"]),
    "comparative": ([r"\bcompare\b", r"\bcomparison\b", r"\bversus\b", r"\bvs\b", r"\bdifference\b", r"\bsimilar\b", r"\bbetter\b", r"\bworse\b"], ["compare", "comparison", "versus", "difference", "similar", "better", "worse"]),
    "procedural": ([r"\bhow\s+to\b", r"\bsteps\b", r"\bprocess\b", r"\bprocedure\b", r"\bmethod\b", r"\bway\s+to\b"], ["how", "steps", "process", "procedure", "method", "guide", "tutorial"]),
    "temporal": ([r"\b(last|past|recent|current|future|next)\b", r"\b(today|yesterday|tomorrow)\b", r"\b(week|month|year|quarter)\b", r"\b(since|until|before|after|during)\b"], ["last", "recent", "current", "future", "trend", "history", "timeline"]),
    "causal": ([r"\bwhy\b", r"\bcause\b", r"\breason\b", r"\bimpact\b", r"\beffect\b", r"\bresult\b"], ["why", "cause", "reason", "impact", "effect", "result", "because"]),
    "exploratory": ([r"\bexplore\b", r"\binvestigate\b", r"\bdiscover\b", r"\bfind\s+out\b", r"\blearn\s+about\b"], ["explore", "investigate", "discover", "research", "learn", "understand"]),
    "definitional": ([r"\bdefine\b", r"\bdefinition\b", r"\bmeaning\b", r"\bwhat\s+does\s+.+\s+mean\b", r"\bexplain\b"], ["define", "definition", "meaning", "explain", "concept", "term"]),
}
INTENTS = {
    "information_seeking": ([r"\b(what|who|when|where|which)\b"], ["information", "data", "facts", "details", "learn", "know"]),
    "problem_solving": ([r"\b(how\s+to\s+fix|solve|resolve)\b"], ["solve", "fix", "resolve", "issue", "problem", "error"]),
    "decision_making": ([r"\b(should\s+i|which\s+is\s+better|recommend)\b"], ["decide", "choose", "select", "option", "recommendation", "should"]),
    "monitoring": ([r"\b(current\s+status|latest|progress)\b"], ["status", "progress", "update", "current", "latest", "monitor"]),
    "optimization": ([r"\b(how\s+to\s+improve|optimize|enhance)\b"], ["optimize", "improve", "enhance", "increase", "reduce", "efficiency"]),
    "planning": ([r"\b(plan\s+for|strategy|roadmap)\b"], ["plan", "strategy", "roadmap", "schedule", "future", "next"]),
    "analysis": ([r"\b(analyze|analysis|examine)\b"], ["analyze", "analysis", "examine", "evaluate", "insights", "trends"]),
    "research": ([r"\b(research|investigate|study)\b"], ["research", "investigate", "study", "explore", "survey"]),
}
COMPLEXITY_PARTS = ((r"[,;]", 0.1), (r"\b(what|how|why|when|where|who|which)\b", 0.15), (r"\b(if|unless|when|while|although)\b", 0.2), (r"\b(analyze|evaluate|compare|optimize|synthesize)\b", 0.25))
DOMAINS = {
    "business": ["revenue", "profit", "sales", "marketing", "customer", "roi", "kpi"],
    "technical": ["api", "database", "server", "code", "algorithm", "system"],
    "financial": ["budget", "cost", "expense", "investment", "finance", "accounting"],
    "operations": ["process", "workflow", "efficiency", "performance", "productivity"],
    "hr": ["employee", "staff", "hiring", "training", "performance review"],
    "legal": ["compliance", "regulation", "policy", "contract", "agreement"],
    "healthcare": ["patient", "medical", "treatment", "diagnosis", "clinical"],
    "education": ["student", "course", "curriculum", "learning", "assessment"],
}
SYNONYMS = {
    "revenue": ["income", "sales", "earnings", "turnover"], "profit": ["earnings", "gain", "margin", "return"], "customer": ["client", "user", "buyer", "consumer"],
    "employee": ["staff", "worker", "personnel", "team member"], "analyze": ["examine", "review", "assess", "evaluate"], "improve": ["enhance", "optimize", "upgrade", "better"],
    "issue": ["problem", "challenge", "difficulty", "concern"], "data": ["information", "statistics", "metrics", "figures"], "strategy": ["plan", "approach", "method", "framework"],
    "performance": ["results", "outcomes", "effectiveness", "efficiency"],
}
DOMAIN_TERMS = {
    "business": {"kpi": ["key performance indicator", "metric", "measurement"], "roi": ["return on investment", "profitability", "value"], "crm": ["customer relationship management", "customer system"], "b2b": ["business to business", "enterprise"], "b2c": ["business to consumer", "retail"]},
    "technical": {"api": ["application programming interface", "service", "endpoint"], "ui": ["user interface", "frontend", "interface"], "ux": ["user experience", "usability", "design"], "db": ["database", "data storage", "repository"], "ml": ["machine learning", "artificial intelligence", "ai"]},
    "operations": {"sla": ["service level agreement", "performance standard"], "kpi": ["key performance indicator", "success metric"], "bottleneck": ["constraint", "limitation", "blocking issue"], "workflow": ["process", "procedure", "system"]},
}
HIERARCHY = {
    "marketing": ["advertising", "promotion", "branding", "campaigns"], "sales": ["leads", "prospects", "conversion", "deals"], "finance": ["accounting", "budgeting", "forecasting", "reporting"],
    "operations": ["logistics", "supply chain", "procurement", "inventory"], "technology": ["software", "hardware", "infrastructure", "systems"], "human resources": ["recruiting", "training", "performance", "benefits"],
}
AGENTS = {
    "research": (["research", "study", "investigate", "analyze", "data", "findings"], ["analytical", "exploratory"], ["research", "analysis"], "detailed analysis"),
    "ceo": (["strategy", "leadership", "vision", "decision", "business", "executive"], ["analytical", "comparative"], ["decision_making", "planning"], "strategic perspective"),
    "performance": (["performance", "metrics", "kpi", "results", "efficiency", "productivity"], ["factual", "analytical"], ["monitoring", "optimization"], "performance metrics"),
    "coaching": (["coaching", "development", "training", "improvement", "skills", "growth"], ["procedural", "analytical"], ["problem_solving", "optimization"], "development guidance"),
    "business_intelligence": (["intelligence", "insights", "trends", "forecasting", "analytics", "reporting"], ["analytical", "temporal"], ["analysis", "monitoring"], "business intelligence"),
    "contact_center": (["customer", "service", "support", "contact", "calls", "satisfaction"], ["procedural", "analytical"], ["problem_solving", "optimization"], "customer service"),
}
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "can", "may", "might", "must", "shall", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
)
TEMPORAL = (r"\b(?:yesterday|today|tomorrow)\b", r"\b(?:last|this|next)\s+(?:week|month|year|quarter)\b", r"\b(?:since|until|before|after|during)\s+\w+\b", r"\b\d{4}\b", r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\b(?:recent|current|latest|upcoming|future|past)\b")
ENTITY = ((r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 0), (r'"([^"]+)"', 1))
TECHNICAL = r"\b\w*(?:\d+\w*|\w*-\w*)\w*\b"
#: (type or intent, what must occur, what is replaced, by what)
VARIATIONS = (
    ("factual", "what is", "define"), ("factual", "what is", "explain"), ("analytical", "analyze", "examine"), ("analytical", "analyze", "evaluate"), ("procedural", "how to", "steps to"), ("procedural", "how to", "process for"),
    ("problem_solving", "problem", "issue"), ("problem_solving", "problem", "challenge"), ("optimization", "improve", "optimize"), ("optimization", "improve", "enhance"),
)
SUGGESTIONS = (("how to", (" improve efficiency", " optimize process", " best practices")), ("what is", (" definition", " impact", " benefits")))
LEVELS = {
    "simple": (["what is", "who is", "when", "where", "define", "meaning"], [r"\bwhat\s+is\b", r"\bwho\s+is\b", r"\bdefine\b"], 1, 1),
    "moderate": (["how", "why", "compare", "difference", "relationship", "impact"], [r"\bhow\s+(does|do|can)\b", r"\bwhy\b", r"\bcompare\b"], 3, 2),
    "complex": (["analyze", "evaluate", "assess", "strategy", "optimize", "implications"], [r"\banalyze\b", r"\bevaluate\b", r"\bstrategy\b"], 5, 3),
    "analytical": (["synthesize", "correlation", "trends", "patterns", "insights", "recommendations"], [r"\bsynthesize\b", r"\btrends?\b", r"\binsights?\b"], 10, 5),
}


def low(text: str = "text") -> Column:
    return F.lower(F.col(text))


def _scores(text: Column, rules: dict, pattern: float, keyword: float) -> list[tuple[str, Column]]:
    return [(name, F.round(matched(text, p) * F.lit(pattern) + contained(text, k) * F.lit(keyword), 6)) for name, (p, k) in rules.items()]


def classify_queries(queries: DataFrame) -> DataFrame:
    """query_type, intent, confidence and complexity_score of each query."""
    own, text = once(queries, "_low", low()), F.col("_low")
    own = once(once(own, "_kind", best_of(_scores(text, TYPES, 0.4, 0.2))), "_intent", best_of(_scores(text, INTENTS, 0.5, 0.3)))
    parts = [F.regexp_count(F.col("text") if p == r"[,;]" else text, F.lit(p)) * F.lit(w) for p, w in COMPLEXITY_PARTS]
    length = F.least(F.size(words(F.col("text"))) / 20, F.lit(0.3))
    return own.select(
        *queries.columns, F.col("_kind.name").alias("query_type"), F.col("_intent.name").alias("intent"), ((F.least(-F.col("_kind.minus"), F.lit(1.0)) + F.least(-F.col("_intent.minus"), F.lit(1.0))) / 2).alias("confidence"),
        F.least(sum(parts[1:], parts[0]) + length, F.lit(1.0)).alias("complexity_score"),
    )


def query_entities(queries: DataFrame) -> DataFrame:
    """entities: capitalised runs, quoted terms and terms with digits or hyphens longer than two characters, distinct and sorted."""
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ENTITY]
    technical = F.filter(F.regexp_extract_all("text", F.lit(TECHNICAL), F.lit(0)), lambda t: F.length(t) > 2)
    return queries.withColumn("entities", F.array_sort(F.array_distinct(F.concat(*found, technical))))


def query_keywords(queries: DataFrame, min_length: int = 3) -> DataFrame:
    return queries.withColumn("keywords", F.filter(F.regexp_extract_all(low(), F.lit(r"\b\w+\b"), F.lit(0)), lambda w: (F.length(w) >= min_length) & ~w.isin(*STOP_WORDS)))


def query_temporal(queries: DataFrame) -> DataFrame:
    return queries.withColumn("temporal", F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(low(), F.lit(p), F.lit(0)) for p in TEMPORAL)))))


def query_domains(queries: DataFrame) -> DataFrame:
    """domains: `name:score` for each domain with a keyword."""
    scores = F.array(*(F.struct(F.lit(d).alias("d"), contained(low(), k).alias("n")) for d, k in DOMAINS.items()))
    return queries.withColumn("domains", F.transform(F.filter(scores, lambda s: s["n"] > 0), lambda s: F.concat_ws(":", s["d"], s["n"].cast("string"))))


def _chosen(made: list[tuple[Column, Column]], limit: int) -> Column:
    """The values whose condition holds, in order, limit at most."""
    return F.slice(F.array_compact(F.array(*(F.when(ok, v) for ok, v in made))), 1, limit)


def expand_synonyms(queries: DataFrame, limit: int = 5) -> DataFrame:
    own = once(queries, "_words", words(F.col("text")))
    made = [(F.array_contains("_words", t), F.replace(low(), F.lit(t), F.lit(e))) for t, ways in SYNONYMS.items() for e in ways]
    return own.withColumn("synonyms", _chosen(made, limit)).drop("_words")


def expand_domain(queries: DataFrame, limit: int = 5) -> DataFrame:
    """Abbreviations of the detected domains replaced; business and technical where none is detected."""
    own = once(queries, "_domains", F.array_compact(F.array(*(F.when(contained(low(), k) > 0, F.lit(d)) for d, k in DOMAINS.items()))))
    made = []
    for domain, terms in DOMAIN_TERMS.items():
        on = F.array_contains("_domains", domain) | ((F.size("_domains") == 0) & F.lit(domain in ("business", "technical")))
        made += [(on & F.contains(low(), F.lit(t)), F.replace(low(), F.lit(t), F.lit(e))) for t, ways in terms.items() for e in ways]
    return own.withColumn("domain_terms", _chosen(made, limit)).drop("_domains")


def expand_hierarchy(queries: DataFrame, limit: int = 3) -> DataFrame:
    """Children of a parent that is present; the parent of a child that is present without it."""
    made = []
    for parent, children in HIERARCHY.items():
        has = F.contains(low(), F.lit(parent))
        made += [(has, F.concat("text", F.lit(" " + c))) for c in children]
        made.append((~has & (contained(low(), children) > 0), F.concat("text", F.lit(" " + parent))))
    return queries.withColumn("hierarchy", _chosen(made, limit))


def expand_temporal(queries: DataFrame) -> DataFrame:
    """Two variants where recent or current is among the temporal indicators."""
    own = once(query_temporal(queries.drop("temporal")), "_t", F.array_join("temporal", " "))
    two = F.array(F.concat("text", F.lit(" past 3 months")), F.concat("text", F.lit(" year to date")))
    return own.withColumn("temporal_variants", F.when(contained(F.col("_t"), ("recent", "current")) > 0, two).otherwise(F.array().cast("array<string>"))).select(*queries.columns, "temporal_variants")


def expand_semantic(queries: DataFrame, limit: int = 4) -> DataFrame:
    """Reformulations by type, then by intent."""
    return _expand_semantic(classify_queries(queries), limit).select(*queries.columns, "variations")


def _expand_semantic(own: DataFrame, limit: int = 4) -> DataFrame:
    made = [(((F.col("query_type") == k) | (F.col("intent") == k)) & F.contains(low(), F.lit(t)), F.replace("text", F.lit(t), F.lit(e))) for k, t, e in VARIATIONS]
    # a factual question must begin with its phrase
    made = [(ok & F.startswith(low(), F.lit(t)), v) if k == "factual" else (ok, v) for (ok, v), (k, t, _) in zip(made, VARIATIONS)]
    return own.withColumn("variations", _chosen(made, limit))


def expand_queries(queries: DataFrame, limit: int = 8) -> DataFrame:
    """new_terms: words of all expansions that the query lacks, sorted; combined: the query with the first limit of them."""
    return _expand_queries(classify_queries(queries), limit).select(*queries.columns, "new_terms", "combined")


def _expand_queries(own: DataFrame, limit: int = 8) -> DataFrame:
    """expand_queries of classified queries, with all their columns."""
    columns = own.columns
    own = _expand_semantic(expand_hierarchy(expand_domain(expand_synonyms(own))))
    joined = F.lower(F.array_join(F.concat("synonyms", "domain_terms", "hierarchy", "variations"), " "))
    own = once(own, "new_terms", F.array_sort(F.array_except(F.array_distinct(words(joined)), words(F.col("text")))))
    combined = F.when(F.size("new_terms") > 0, F.concat_ws(" ", "text", F.array_join(F.slice("new_terms", 1, limit), " "))).otherwise(F.col("text"))
    return own.withColumn("combined", combined).select(*columns, "new_terms", "combined")


def route_queries(queries: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, agent, affinity, optimized, rank): the agents with affinity above 0.3."""
    routed = classify_queries(queries).select("query_id", F.posexplode(_routes(limit)).alias("pos", "r"))
    return routed.select("query_id", "r.agent", "r.affinity", "r.optimized", (F.col("pos") + 1).alias("rank"))


def _routes(limit: int = 3) -> Column:
    """array<struct<minus, n, agent, affinity, optimized>> of a classified query, the best first."""
    made = []
    for n, (agent, (keys, kinds, intents, hint)) in enumerate(AGENTS.items()):
        hits = F.size(F.array_intersect(F.array_distinct(words(F.col("text"))), F.array(*map(F.lit, keys))))
        score = F.round(F.least(hits * 0.3 + F.col("query_type").isin(kinds).cast("int") * 0.4 + F.col("intent").isin(intents).cast("int") * 0.3, F.lit(1.0)), 6)
        text = F.when(F.contains(low(), F.lit(hint.split()[0])), F.col("text")).otherwise(F.concat(F.lit(f"{hint}: "), "text"))
        made.append(F.struct((-score).alias("minus"), F.lit(n).alias("n"), F.lit(agent).alias("agent"), score.alias("affinity"), text.alias("optimized")))
    return F.slice(F.array_sort(F.filter(F.array(*made), lambda s: s["affinity"] > 0.3)), 1, limit)


def _process(queries: DataFrame) -> DataFrame:
    own = once(classify_queries(queries), "_best", _routes(1))
    return query_domains(query_keywords(_expand_queries(own))).withColumn("agent", F.get("_best", F.lit(0))["agent"]).drop("_best")


#: Texts that a task analyses.
TEXTS = 50_000


def process_query_log(queries: DataFrame) -> DataFrame:
    """Analysis, expansion and best route of each query.

    All of it follows from the text, and logs repeat their texts, so each distinct text is analysed once if there are half as many of them
    as rows or fewer. Rows of common texts stay where they are (join_groups).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit(""))  # a null text is a text of its own
    texts = kept(queries.groupBy("text").agg(F.count("*").alias("n")), "query-texts")
    distinct, total = texts.agg(F.count("*"), F.sum("n")).first()
    if not distinct or 2 * distinct > total:
        return _process(queries)
    # short texts are few bytes and much work, so they are dealt out by their number
    parts = max(queries.sparkSession.sparkContext.defaultParallelism, distinct // TEXTS)
    groups = kept(_process(texts.repartition(parts, "text")).withColumn("_key", key).drop("text"), "query-analyses")
    return join_groups(queries.withColumn("_key", key), groups, "_key", total).drop("_key")


def suggest_queries(prefixes: DataFrame, log: DataFrame, limit: int = 5, latest: int = 100) -> DataFrame:
    """(prefix, suggestion, rank): distinct texts among the latest log rows that contain a prefix of three characters or more, oldest first, then templates."""
    recent = log.orderBy(F.desc("ts"), F.desc("query_id")).limit(latest).groupBy("text").agg(F.min(F.struct("ts", "query_id")).alias("at"))
    p = prefixes.filter(F.length("prefix") >= 3).select("prefix").distinct()
    hits = p.join(F.broadcast(recent), F.contains(F.lower("text"), F.lower("prefix"))).select("prefix", F.col("text").alias("suggestion"), F.lit(0).alias("n"), "at")  # at most latest rows
    low_ = F.lower("prefix")
    how, what = (F.contains(low_, F.lit(t)) for t, _ in SUGGESTIONS)
    templates = F.when(how, F.array(*map(F.lit, SUGGESTIONS[0][1]))).when(what & ~how, F.array(*map(F.lit, SUGGESTIONS[1][1])))
    more = p.select("prefix", F.posexplode(templates).alias("n", "end")).select("prefix", F.concat("prefix", "end").alias("suggestion"), (F.col("n") + 1).alias("n"), F.lit(None).alias("at"))
    w = Window.partitionBy("prefix").orderBy("n", "at")
    return hits.unionByName(more).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("prefix", "suggestion", "rank")


def query_complexity(queries: DataFrame) -> DataFrame:
    """level and level_confidence of each query."""
    own = once(queries, "_w", words(F.col("text")))
    w = F.col("_w")
    density = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)
    asks = F.size(F.filter(w, lambda x: x.isin("what", "how", "why", "when", "where", "who")))
    scores = []
    for name, (keys, patterns, concepts, questions) in LEVELS.items():
        scores.append((name, F.round(contained(low(), keys) * 0.3 + matched(low(), patterns) * 0.4 + (density >= concepts / 10).cast("int") * 0.2 + (asks >= questions).cast("int") * 0.1, 6)))
    return once(own, "_best", best_of(scores)).select(*queries.columns, F.col("_best.name").alias("level"), F.least(-F.col("_best.minus"), F.lit(1.0)).alias("level_confidence"))
