"""Answer-quality scores, alerts and summaries over an interaction table.

An interaction is (id, ts, query, response, docs array<string>). All scores are column expressions, so the same functions serve
batch and streaming tables.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, contained, once, raw_words, share, strip, word_set, words
from .order import numbered
from .skew import join_groups

# The word lists of the rules.
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
HEDGES = ("according to", "based on", "suggests that", "indicates that", "appears to", "seems to", "likely", "possibly", "may be")
ABSOLUTES = ("definitely", "certainly", "absolutely", "without doubt", "always", "never", "all", "none", "every", "completely")
CITATIONS = ("according to the document", "the text states", "as mentioned", "the source indicates", "from the provided information")
CONNECTORS = ("however", "therefore", "furthermore", "moreover", "additionally", "consequently", "meanwhile", "nevertheless", "thus", "hence", "also", "in addition", "for example", "specifically")
SPECIFIC = ("exactly", "precisely", "specifically", "particularly", "in fact", "actually", "definitely", "certainly")
OPPOSED = (("not", "is"), ("never", "always"), ("no", "yes"), ("false", "true"), ("incorrect", "correct"))
ANSWERS = {"what": ("is", "are", "means", "refers to"), "how": ("by", "through", "process", "method"), "why": ("because", "due to", "reason")}
QUESTIONS = ("what", "how", "why", "when", "where", "who", "which")
#: Alert thresholds: (metric, bound, alert when above, level).
THRESHOLDS = (("confidence", 0.7, False, "warning"), ("hallucination_risk", 0.3, True, "critical"), ("grounding", 0.6, False, "warning"), ("overall", 0.7, False, "warning"))
ALERTS_PER_HOUR = 10


@dataclass(frozen=True)
class Parts:
    """What several scores of an interaction use: expressions, or columns that hold them."""

    low: Column
    words: Column
    asked: Column
    content: Column
    content_low: Column
    content_set: Column
    content3_low: Column
    numbers: Column
    content_numbers: Column


def r() -> Column:
    return F.coalesce(F.col("response"), F.lit(""))


def content(top: int) -> Column:
    return F.array_join(F.slice(F.coalesce("docs", F.array().cast("array<string>")), 1, top), " ")


def no_docs() -> Column:
    return F.coalesce(F.size("docs") == 0, F.lit(True)) | F.col("docs").isNull()


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def numbers_of(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))).otherwise(F.array().cast("array<string>"))


def parts() -> Parts:
    c = content(5)
    return Parts(F.lower(r()), words(r()), words(F.col("query")), c, F.lower(c), word_set(c), F.lower(content(3)), numbers_of(r()), numbers_of(c))


def prepared(rows: DataFrame) -> tuple[DataFrame, Parts]:
    """rows with a column for each part, evaluated once a row."""
    made = {f.name: getattr(parts(), f.name) for f in fields(Parts)}
    made |= {"content_low": F.lower("_content"), "content_set": word_set(F.col("_content")), "content_numbers": numbers_of(F.col("_content"))}
    for name, c in made.items():
        rows = once(rows, f"_{name}", c)
    return rows, Parts(**{name: F.col(f"_{name}") for name in made})


def semantic_overlap(x: Parts | None = None) -> Column:
    """Share of the query's words in the response."""
    x = x or parts()
    q = F.array_distinct(x.asked)
    return share(F.size(F.array_intersect(q, x.words)), F.size(q))


def grounding(x: Parts | None = None) -> Column:
    """Share of response words found in the first five documents, with a bonus for shared numbers."""
    x = x or parts()
    own = F.array_distinct(x.words)
    base = share(F.size(F.array_intersect(own, x.content_set)), F.size(own))
    bonus = F.least(F.lit(0.2), F.size(F.array_intersect(x.numbers, x.content_numbers)) * 0.05)
    return F.when(no_docs() | blank(x.content) | (F.size(own) == 0), 0.0).otherwise(F.least(F.lit(1.0), base + bonus))


def completeness(x: Parts | None = None) -> Column:
    x = x or parts()
    n = F.size(x.words)
    length = F.when(n < 5, 0.2).when(n > 300, 0.8).when(n.between(10, 200), 1.0).otherwise(0.7)
    cover = F.lit(1.0)
    for word, good in ANSWERS.items():
        times = F.size(x.asked) - F.size(F.array_remove(x.asked, word))
        cover = cover * F.when((times > 0) & (contained(x.low, good) == 0), F.pow(F.lit(0.8), times)).otherwise(1.0)
    return (length + cover) / 2


def factual_score(x: Parts | None = None) -> Column:
    low = (x or parts()).low
    up = F.least(F.lit(0.2), contained(low, HEDGES) * 0.05) + F.least(F.lit(0.3), contained(low, CITATIONS) * 0.1)
    down = F.when(no_docs(), F.least(F.lit(0.3), contained(low, ABSOLUTES) * 0.1)).otherwise(0.0)
    return clamp(0.5 + up - down)


def variance(xs: Column) -> Column:
    """Sample variance of an array of two numbers or more."""
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)


def dot_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\."), strip), lambda s: s != "")


def coherence(x: Parts | None = None) -> Column:
    x = x or parts()
    w = x.words
    # a sentence is what stands between full stops and has a word
    lengths = F.array_remove(F.transform(F.split(r(), r"\."), lambda s: F.size(raw_words(s)).cast("double")), 0.0)
    n = F.size(lengths)
    even = F.when(n > 1, 1 - F.least(F.lit(1.0), variance(lengths) / 100)).otherwise(0.8)
    distinct = F.array_distinct(w)
    links = F.least(F.lit(1.0), F.size(F.array_intersect(distinct, F.array(*map(F.lit, CONNECTORS)))) / F.greatest(F.lit(1), n - 1))
    mean = (even + links + share(F.size(distinct), F.size(w))) / 3
    return F.when(F.size(w) == 0, 0.0).when(n == 0, 0.1).otherwise(mean)


def unsupported_claims(x: Parts | None = None) -> Column:
    """Mean share of numbers and of proper names that the first five documents lack."""
    x = x or parts()
    names = F.regexp_extract_all(r(), F.lit(NAME), F.lit(0))
    a = share(F.size(F.filter(x.numbers, lambda m: ~F.array_contains(x.content_numbers, m))), F.size(x.numbers))
    b = share(F.size(F.filter(names, lambda m: ~F.contains(x.content_low, F.lower(m)))), F.size(names))
    return F.when(blank(x.content), 0.8).otherwise((a + b) / 2)


def semantic_drift(cosine: Column | None = None) -> Column:
    """1 - cosine of response and sources; 0.5 without a model."""
    return F.lit(0.5) if cosine is None else 1 - F.greatest(F.lit(0.0), cosine)


def ungrounded_specificity(x: Parts | None = None) -> Column:
    x = x or parts()
    own = F.array_distinct(x.words)
    n = contained(x.low, SPECIFIC)
    found = share(F.size(F.array_intersect(own, x.content_set)), F.size(own))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), n * 0.2 * (1 - found)))


def contradictions(x: Parts | None = None, whole_words: bool = False) -> Column:
    x = x or parts()
    has = (lambda t, w: t.rlike(rf"\b{w}\b")) if whole_words else (lambda t, w: F.contains(t, F.lit(w)))
    c, low = x.content3_low, x.low
    total = sum(F.when((has(low, a) & has(c, b)) | (has(low, b) & has(c, a)), 0.1).otherwise(0.0) for a, b in OPPOSED)
    return F.least(F.lit(1.0), total)


def score_interactions(rows: DataFrame) -> DataFrame:
    """rows with every score: confidence weighs 0.75 in all without a similarity model; risk is inverted in overall."""
    own, x = prepared(rows)
    made = {"grounding": grounding(x), "completeness": completeness(x), "factual_score": factual_score(x), "coherence": coherence(x), "unsupported_claims": unsupported_claims(x), "semantic_drift": semantic_drift(), "ungrounded_specificity": ungrounded_specificity(x), "contradictions": contradictions(x), "semantic_overlap": semantic_overlap(x)}
    own = own.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
    confidence = clamp(0.35 * F.col("grounding") + 0.15 * F.col("completeness") + 0.15 * F.col("factual_score") + 0.10 * F.col("coherence"))
    risk = clamp(0.4 * F.col("unsupported_claims") + 0.3 * F.col("semantic_drift") + 0.2 * F.col("ungrounded_specificity") + 0.1 * F.col("contradictions"))
    own = own.withColumns({"confidence": confidence, "hallucination_risk": F.when(no_docs(), 0.8).otherwise(risk)})
    overall = (F.col("confidence") + 1 - F.col("hallucination_risk") + F.col("grounding") + F.col("completeness") + F.col("coherence")) / 5
    return own.withColumn("overall", overall)


def alert_candidates(scored: DataFrame) -> DataFrame:
    """alerts array<struct<metric, level, value>> of each scored row."""
    made = [F.when(F.round(m, 6) > b if above else F.round(m, 6) < b, F.struct(F.lit(m).alias("metric"), F.lit(level).alias("level"), F.col(m).alias("value"))) for m, b, above, level in THRESHOLDS]
    return scored.withColumn("alerts", F.array_compact(F.array(*made)))


def quality_alerts(scored: DataFrame) -> DataFrame:
    """(id, ts, metric, level, value): a row's alerts, as long as fewer than ten came before in its hour."""
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    held = alert_candidates(scored).select("id", "ts", "alerts").filter(F.size("alerts") > 0)
    kept = held.withColumn("_before", F.coalesce(F.sum(F.size("alerts")).over(w), F.lit(0))).filter(F.col("_before") < ALERTS_PER_HOUR)
    return kept.select("id", "ts", F.explode("alerts").alias("a")).select("id", "ts", "a.metric", "a.level", "a.value")


#: Rows of a bucket of the ordered history, and seconds of a bucket of its seconds.
HISTORY_ROWS, HISTORY_SECONDS = 20_000, 21_600


def degradation(scored: DataFrame, minutes: int = 30, rows: int = 100, least: int = 5, drop: float = 0.15, bucket_rows: int = HISTORY_ROWS, bucket_seconds: int = HISTORY_SECONDS) -> DataFrame:
    """(id, ts, recent, n, base, seen, degraded): rows at which the mean of the last minutes (of least rows or more) lies drop below that of the last rows rows.

    One unbroken history in many tasks; rows without a time are left out. Rows have their place in it; a bucket of places carries the last rows of the one before it. Seconds
    are summed first, and a bucket of seconds carries the last minutes of the one before it, so no bucket grows with the traffic.
    """
    slim = scored.filter(F.col("ts").isNotNull()).select("id", "ts", "overall", F.unix_timestamp("ts").alias("second"))
    size, span = max(bucket_rows, rows), max(bucket_seconds, minutes * 60)
    own = numbered(slim, ["ts", "id"]).drop("_n")
    place, over = F.floor(F.col("i") / size), F.col("i") % size >= size - rows + 1
    dealt = own.withColumn("_b", F.explode(F.when(over, F.array(place, place + 1)).otherwise(F.array(place))))
    last = Window.partitionBy("_b").orderBy("i").rowsBetween(1 - rows, 0)
    based = dealt.withColumn("base", F.avg("overall").over(last)).filter(F.col("_b") == place).drop("_b")
    seconds = slim.groupBy("second").agg(F.count("*").alias("c"), F.count("overall").alias("valid"), F.sum("overall").alias("total"))
    time, late = F.floor(F.col("second") / span), F.pmod(F.col("second"), F.lit(span)) >= span - minutes * 60
    carried = seconds.withColumn("_b", F.explode(F.when(late, F.array(time, time + 1)).otherwise(F.array(time))))
    near = Window.partitionBy("_b").orderBy("second").rangeBetween(-minutes * 60, 0)
    recent = carried.withColumn("recent", F.sum("total").over(near) / F.nullif(F.sum("valid").over(near), F.lit(0))).withColumn("_seen", F.sum("c").over(near)).filter(F.col("_b") == time)
    # a second with many rows stays where its rows are
    joined = join_groups(based, recent.select("second", "recent", F.col("_seen"), F.col("c").alias("n")), "second", slim.count())
    out = joined.select("id", "ts", "recent", F.col("_seen").alias("n"), "base", (F.col("i") + 1).alias("seen"))
    return out.withColumn("degraded", (F.col("n") >= least) & (F.col("seen") > rows) & (F.round(F.col("recent") - F.col("base"), 6) < -drop))


def satisfaction(feedback: DataFrame, as_of: str, hours: int = 24, least: int = 10, bound: float = 0.6) -> DataFrame:
    """One row: samples, mean satisfaction and alert over the last hours of feedback (type, rating, ts); none below least samples."""
    value = F.when(F.col("type") == "rating", F.col("rating") / 5).when(F.col("type") == "thumbs_up", 1.0).when(F.col("type") == "thumbs_down", 0.0)
    end = F.lit(as_of).cast("timestamp")
    own = feedback.filter((F.col("ts") <= end) & (F.unix_timestamp(end) - F.unix_timestamp("ts") <= hours * 3600))
    found = own.agg(F.count(value).alias("n"), F.avg(value).alias("satisfaction")).filter(F.col("n") >= least)
    return found.withColumn("alert", F.round("satisfaction", 6) < bound)


def quality_summary(scored: DataFrame, alerts: DataFrame, as_of: str, hours: int) -> DataFrame:
    """One row: mean, deviation, least and most of the scores and alerts by level over the last hours."""
    inside = (F.col("ts") <= F.lit(as_of).cast("timestamp")) & (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("ts") <= hours * 3600)
    stats = [f(m).alias(f"{n}_{m}") for m in ("overall", "confidence", "hallucination_risk") for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    a = scored.filter(inside).agg(F.count("*").alias("n"), *stats)
    b = alerts.filter(inside).agg(F.count("*").alias("alerts"), *(F.count_if(F.col("level") == x).alias(f"alerts_{x}") for x in ("warning", "critical")))
    return a.join(F.broadcast(b))  # one row each


def open_alerts(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    return alerts.join(resolved, ["id", "metric"], "left_anti")


def retention(rows: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """Rows of the hour buckets that are not older than hours."""
    return rows.filter(F.date_trunc("hour", "ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))
