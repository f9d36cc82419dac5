"""Context assembly: search hits of many queries become prompt contexts under token budgets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contained, strip

# Words of the rules, and per complexity the documents, diversity weight and compression.
INDICATORS, VERBS = ("important", "significant", "key", "main", "primary", "critical"), ("shows", "demonstrates", "indicates", "reveals", "proves")
STRATEGIES = {"simple": (3, 0.2, "light"), "moderate": (5, 0.3, "light"), "complex": (8, 0.4, "moderate"), "analytical": (12, 0.5, "moderate")}
BUDGET = 8192 - 500 - 100 - 1000
CUT = "\n\n[Content truncated due to length...]"


def hit_importance(hits: DataFrame, as_of: str) -> DataFrame:
    """importance of hits (relevance, created_at, metadata map): recency within a year and rich metadata add to relevance."""
    days = F.date_diff(F.lit(as_of).cast("date"), F.to_date("created_at"))
    recent = F.coalesce(F.greatest(F.lit(0.0), 1 - days / 365) * 0.1, F.lit(0.0))
    return hits.withColumn("importance", F.col("relevance") + recent + F.when(F.size("metadata") > 3, 0.05).otherwise(0.0))


def key_points(text: Column, n: int | Column = 5) -> Column:
    """The n best sentences of 20 characters or more, the earlier of equal scores first."""
    sentences = F.transform(F.split(text, r"[.!?]+"), strip)
    scored = F.transform(
        sentences,
        lambda s, i: F.struct(
            F.round(-(F.when(F.length(s) > 200, -0.2).otherwise(0.0) + F.when(s.rlike(r"\d+(?:\.\d+)?[%$]?"), 0.3).otherwise(0.0) + (contained(F.lower(s), INDICATORS) + contained(F.lower(s), VERBS)) * 0.1), 6).alias("m"), i.alias("i"), s.alias("s")
        ),
    )
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: F.length(x["s"]) >= 20)), 1, n), lambda x: x["s"])


def summarize(text: Column, ratio: float = 0.3) -> Column:
    """The best key points, a ratio of the sentences of more than 20 characters; the text itself without such sentences."""
    n = F.size(F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: F.length(s) > 20))
    points = key_points(text, F.greatest(F.lit(1), F.floor(n * ratio).cast("int")))
    return F.when(n == 0, text).otherwise(F.concat(F.array_join(points, ". "), F.lit(".")))


def compressed(text: Column, level: str) -> Column:
    return {"none": text, "light": F.regexp_replace(strip(text), r"\s+", " "), "moderate": summarize(text, 0.5), "aggressive": F.array_join(key_points(text, 3), ". ")}[level]


def compress_docs(docs: DataFrame, level: str, target_tokens: int | None = None) -> DataFrame:
    """text compressed by level, then cut to 0.9 of the target's share of its length."""
    own = docs.withColumn("text", compressed(F.col("text"), level))
    if target_tokens is not None and level != "none":
        now = F.floor(F.length("text") / 4)
        own = own.withColumn("text", F.when(now > target_tokens, F.concat(F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") * (target_tokens / now) * 0.9).cast("int")), F.lit("..."))).otherwise(F.col("text")))
    return own.withColumn("token_count", F.floor(F.length("text") / 4))


def _pick(texts: list[str], importance: list[float], most: int, weight: float) -> list[int]:
    if len(texts) <= most:
        return list(range(len(texts)))
    sets = [set(t.lower().split()) for t in texts]
    chosen = [max(range(len(texts)), key=lambda i: importance[i])]
    while len(chosen) < most:

        def value(i: int) -> float:
            far = [1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in chosen if sets[i] and sets[j]]
            return round((1 - weight) * importance[i] + weight * min([1.0, *far]), 9)

        chosen.append(max((i for i in range(len(texts)) if i not in chosen), key=value))
    return chosen


def select_diverse(hits: DataFrame, most: int, weight: float) -> DataFrame:
    """(query_id, doc_id, position): the most important hit, then by importance and distance to the chosen. hits: a top-k list of the caller's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        at = _pick(pdf["text"].tolist(), pdf["importance"].tolist(), most, weight)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].to_numpy()[at], "position": range(1, len(at) + 1)})

    return hits.select("query_id", "doc_id", "rank", "text", "importance").groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, position long")


def context_window(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, position, doc_id, text, token_count, compression): hits (query_id, level, doc_id, rank, text, importance) chosen by the query's complexity and cut to shares of the budget."""

    def points(text: str, n: int) -> list[str]:
        own = [s.strip() for s in re.split(r"[.!?]+", text)]
        score = lambda s: round(-0.2 * (len(s) > 200) + 0.3 * bool(re.search(r"\d", s)) + 0.1 * sum(w in s.lower() for w in INDICATORS + VERBS), 6)
        return sorted((s for s in own if len(s) >= 20), key=lambda s: -score(s))[:n]

    def shorten(text: str, level: str, target: int) -> str:
        if level == "light":
            text = re.sub(r"\s+", " ", text.strip())
        elif level == "moderate":
            n = sum(len(s.strip()) > 20 for s in re.split(r"[.!?]+", text))
            text = ". ".join(points(text, max(1, int(n * 0.5)))) + "." if n else text
        else:
            text = ". ".join(points(text, 3))
        now = len(text) // 4
        return text[: int(len(text) * (target / now) * 0.9)] + "..." if now > target else text

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        most, weight, level = STRATEGIES[pdf["level"].iloc[0]]
        at = _pick(pdf["text"].tolist(), pdf["importance"].tolist(), most, weight)
        own = pdf.iloc[at]
        need = int((own["text"].str.len() // 4).sum())
        if need > budget:
            level = "aggressive" if need > 2 * budget else "moderate"
        total, left, out = own["importance"].sum(), budget, []
        for n, row in enumerate(own.itertuples(), 1):
            if left <= 0:
                break
            part = row.importance / total if total > 0 else 1 / len(own)
            text = shorten(row.text, level, min(int(budget * part), left))
            out.append((row.query_id, n, row.doc_id, text, len(text) // 4, level))
            left -= len(text) // 4
        return pd.DataFrame(out, columns=["query_id", "position", "doc_id", "text", "token_count", "compression"])

    own = hits.select("query_id", "level", "doc_id", "rank", "text", "importance")
    return own.groupBy("query_id").applyInPandas(run, "query_id long, position long, doc_id long, text string, token_count long, compression string")


def format_context(window: DataFrame) -> DataFrame:
    """(query_id, context): numbered documents (position, title, source, relevance, text) in order."""
    head = F.concat(F.format_string("Document %d", "position"), F.when(F.col("title") != "", F.concat(F.lit(": "), "title")).otherwise(""), F.when(F.col("source") != "", F.concat(F.lit(" (Source: "), "source", F.lit(")"))).otherwise(""), F.format_string(" [Relevance: %.2f]", "relevance"))
    lined = window.select("query_id", "position", F.concat(head, F.lit("\n"), "text", F.lit("\n")).alias("part"))
    return lined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda s: s["part"]), "\n").alias("context"))


def context_stats(window: DataFrame) -> DataFrame:
    return window.groupBy("query_id").agg(F.count("*").alias("documents"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"), F.avg("relevance").alias("relevance"))


def truncate_text(text: Column, max_tokens: int) -> Column:
    """Cut to four characters a token, at the last full stop or line end past the middle, and marked."""
    n = max_tokens * 4
    head = F.substring(text, 1, n)
    last = F.length(F.regexp_extract(head, r"(?s)^(.*[.\n])", 1))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.when(last - 1 > n // 2, F.substring(text, F.lit(1), last)).otherwise(head), F.lit(CUT)))


def context_by_chars(hits: DataFrame, most: int = 20_000, each: int = 8000) -> DataFrame:
    """(query_id, context): documents (rank, title, text) in order until the first that would pass most characters."""
    own = hits.withColumn("text", F.when(F.length("text") > each, truncate_text(F.col("text"), each // 4)).otherwise(F.col("text")))
    own = own.withColumn("part", F.concat(F.lit("Document: "), "title", F.lit("\nContent: "), "text"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = own.withColumn("_sum", F.sum(F.length("part")).over(w)).filter(F.col("_sum") <= most)
    return fits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "\n\n").alias("context"))
