"""BM25 over a whole corpus for a table of queries.

Postings are keyed by term; only the terms of the queries are kept of them, so that common terms no query asks for are not
shuffled. Scores add up by (query, document), pre-aggregated on each side of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, words
from .ranking import BROADCAST_ROWS, top_k

#: Okapi constants: fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("tokens", words(F.col(text)))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, dl), of the given terms only if there are any; blank documents have no posting."""
    t = once(docs, "tokens", words(F.col("text"))).select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        t = t.join(terms, "term", "left_semi")
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents with words and their mean length."""
    sizes = tokenize(docs).select(F.size("tokens").alias("dl")).filter("dl > 0")
    return sizes.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def term_idf(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf is EPSILON times the mean idf of all terms."""
    df = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


Index = tuple[DataFrame, DataFrame, DataFrame]


def bm25_index(docs: DataFrame) -> Index:
    """Postings, terms with idf, and the one-row statistics."""
    stats = corpus_stats(docs)
    return postings(docs), term_idf(docs, stats), stats


def bm25_scores(docs: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """(query_id, doc_id, score) with score above 0; queries: (query_id, text). Repeated query words count again.

    Without a stored index, documents' words meet the queries' terms before they are grouped, and document frequencies are counts
    by term, so that no posting of another term is shuffled.
    """
    asked = tokenize(queries).select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    # a common term has a large share of the postings, so they stay where they are if the queries' terms are few
    side = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda df: df)
    if index is None:
        stats = corpus_stats(docs)
        index = postings(docs, side(asked.select("term").distinct())), term_idf(docs, stats), stats
    post, terms, stats = index
    weighted = post.join(side(side(asked).join(terms, "term")), "term").join(F.broadcast(stats))
    tf = F.col("tf")
    part = F.col("qn") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return weighted.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).filter(F.round("score", 6) > 0)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 5, index: Index | None = None) -> DataFrame:
    return top_k(bm25_scores(docs, queries, index), k)


def lexical_lookup(hits: DataFrame, docs: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Hits with columns of their documents, joined after the top-k."""
    return hits.join(docs.select("doc_id", *columns), "doc_id")


def index_from_store(docs: DataFrame) -> Index:
    """An index of stored documents' whole texts."""
    return bm25_index(docs)
