"""Score fusion, reranking and reuse of results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.shared import kept
from .ranking import top_k


def minmax_scores(hits: DataFrame, score: str = "score", out: str = "score") -> DataFrame:
    """Scores scaled to [0, 1] per query; unchanged where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.col(score)))


def fuse_weighted(dense: DataFrame, lexical: DataFrame, dense_weight: float = 0.7, lexical_weight: float = 0.3, min_score: float = 0.0) -> DataFrame:
    """(query_id, doc_id, dense_score, lexical_score, combined_score, source, rank) of two lists (query_id, doc_id, score)."""
    total = dense_weight + lexical_weight
    if abs(total - 1) > 0.001:
        dense_weight, lexical_weight = dense_weight / total, lexical_weight / total
    d = minmax_scores(dense).select("query_id", "doc_id", F.col("score").alias("dense_score"))
    x = minmax_scores(lexical).select("query_id", "doc_id", F.col("score").alias("lexical_score"))
    both = d.join(x, ["query_id", "doc_id"], "full_outer")
    source = F.when(F.col("dense_score").isNull(), "lexical").when(F.col("lexical_score").isNull(), "dense").otherwise("hybrid")
    both = both.withColumn("source", source).fillna(0.0, ["dense_score", "lexical_score"])
    scored = both.withColumn("combined_score", dense_weight * F.col("dense_score") + lexical_weight * F.col("lexical_score"))
    kept = scored.filter(F.round("combined_score", 6) >= min_score)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("combined_score", 6)), "doc_id")))


def hybrid_search(dense: DataFrame, lexical: DataFrame, k: int, dense_weight: float = 0.7, lexical_weight: float = 0.3, reranker: Callable | None = None) -> DataFrame:
    """The k best rows a query of two lists, 2 k long if they are to be reranked, fused by weights.

    reranker makes (query_id, doc_id, position) of candidates with score and rank; it gets the queries with more than k rows, and its
    order replaces theirs. The others keep the order of the fused scores.
    """
    fused = fuse_weighted(dense, lexical, dense_weight, lexical_weight)
    if reranker is None:
        return fused.filter(F.col("rank") <= k)
    fused = kept(fused, "fused")
    rows = fused.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    order = reranker(rows.filter(F.col("_n") > k).drop("_n").withColumn("score", F.col("combined_score"))).select("query_id", "doc_id", F.col("position").cast("int").alias("_position"))
    placed = fused.join(order, ["query_id", "doc_id"]).withColumn("rank", F.col("_position")).drop("_position").filter(F.col("rank") <= k)
    return placed.unionByName(rows.filter(F.col("_n") <= k).drop("_n")).select(*fused.columns)


def hybrid_search_result(fused: DataFrame) -> DataFrame:
    return fused.withColumn("distance", 1 - F.col("combined_score"))


def fuse_rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, doc_id, rank from 1)."""
    one = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists])
    fused = one.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")))


def fuse_wsum(lists: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight x score / highest score of the query's list; weights default to equal shares."""
    weights = weights or {m: 1 / len(lists) for m in lists}
    one = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "score", F.lit(m).alias("method"), F.lit(float(weights.get(m, 1 / len(lists)))).alias("weight")) for m, x in lists.items()])
    high = F.max("score").over(Window.partitionBy("query_id", "method"))
    part = one.withColumn("part", F.when(high > 0, F.col("weight") * F.col("score") / high).otherwise(F.lit(0.0)))
    fused = part.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")))


def hybrid_multi(lists: dict[str, DataFrame], k: int, method: str = "rrf") -> DataFrame:
    """Several methods' lists, each cut to 2 k, fused by rrf, weighted or comb_sum (the weighted sum), cut to k."""
    cut = {m: x.filter(F.col("rank") <= 2 * k) for m, x in lists.items()}
    if method == "rrf":
        fused = fuse_rrf(list(cut.values()))
    elif method in ("weighted", "comb_sum"):
        fused = fuse_wsum(cut)
    else:
        raise ValueError(f"unknown fusion method {method}")
    return fused.filter(F.col("rank") <= k)


def pair_rerank(hits: DataFrame, scorer: Callable | None = None, score: str = "combined_score", max_chars: int = 2000) -> DataFrame:
    """Hits (query_id, doc_id, query, text, score) scored anew by scorer(query, text), a pandas_udf; as they are without one."""
    return hits if scorer is None else hits.withColumn(score, scorer(F.col("query"), F.substring("text", 1, max_chars)))


def pairwise_diversity(hits: DataFrame) -> DataFrame:
    """(query_id, a, b, diversity): 1 - cosine of a query's candidates (query_id, doc_id, vec), a top-k list of the caller's."""
    from ..functions.embeddings import cosine

    x, y = (hits.select("query_id", F.col("doc_id").alias(n), F.col("vec").alias(f"v{n}")) for n in ("a", "b"))
    return x.join(y, "query_id").filter("a < b").select("query_id", "a", "b", (1 - cosine(F.col("va"), F.col("vb"))).alias("diversity"))


def mmr(hits: DataFrame, k: int, weight: float = 0.7, slots: int | None = None) -> DataFrame:
    """(query_id, doc_id, position): greedy weight x relevance - (1 - weight) x closeness to the chosen.

    hits: (query_id, doc_id, score, rank, vec), a top-k list of the caller's; a query's candidates meet in one group. With slots, vec
    lists the slots (below slots) of a text's terms, and closeness is that of their counts.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        s = pdf["score"].to_numpy(float)
        relevance = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else s
        v = np.stack([np.asarray(x, float) if slots is None else np.bincount(np.asarray(x, "int64"), minlength=slots).astype(float) for x in pdf["vec"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        near = v @ v.T
        chosen = [int(np.argmax(np.round(relevance, 9)))]  # the first of equal ones, whatever the order of their sums
        while len(chosen) < min(k, len(pdf)):
            rest = [i for i in range(len(pdf)) if i not in chosen]
            values = [round(weight * relevance[i] - (1 - weight) * near[i, chosen].max(), 9) for i in rest]
            chosen.append(rest[int(np.argmax(values))])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].to_numpy()[chosen], "position": np.arange(1, len(chosen) + 1)})

    own = hits.select("query_id", "doc_id", "score", "rank", "vec")
    return own.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, position long")


def rerank(hits: DataFrame, k: int, scorer: Callable | None = None, use_mmr: bool = True, slots: int | None = None) -> DataFrame:
    scored = pair_rerank(hits, scorer, "score")
    return mmr(scored, k, slots=slots) if use_mmr else top_k(scored, k).select("query_id", "doc_id", F.col("rank").cast("long").alias("position"))


def memo_key(query: str = "text", k: str = "k", salt: str = "") -> F.Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), F.col(k).cast("string"), F.lit(salt)), 256)


def memo_search(queries: DataFrame, memo: DataFrame, as_of: str, ttl_seconds: int = 3600, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, text, k) with a stored result (memo: key, created_at, hits) young enough, and those to compute."""
    keyed = queries.withColumn("key", F.when(F.length("text") >= 10, memo_key(salt=salt)))
    fresh = memo.filter(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at") < ttl_seconds)
    return keyed.join(fresh, "key"), keyed.join(fresh, "key", "left_anti")


def memo_rerank(pairs: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (query, doc_id, model) with a stored score, and those to score."""
    keyed = pairs.withColumn("query_hash", F.sha2(F.lower(F.trim("query")), 256))
    on = ["query_hash", "doc_id", "model"]
    return keyed.join(memo.select(*on, "score"), on), keyed.join(memo, on, "left_anti")


#: Slots of hashed terms.
SLOTS = 1000


def keyword_slots(text: Column, slots: int = SLOTS) -> Column:
    """The slot of each term of a text."""
    return F.transform(words(text), lambda t: F.pmod(F.hash(t), F.lit(slots)))


def keyword_vector(docs: DataFrame, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, w): hashed term frequencies."""
    terms = docs.select("doc_id", F.explode(words(F.col(text))).alias("term"))
    return terms.groupBy("doc_id", F.pmod(F.hash("term"), F.lit(slots)).alias("slot")).agg(F.count("*").cast("double").alias("w"))
