"""Top-k per query with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(hits: DataFrame, k: int | Column, score: str = "score", key: str = "query_id", tie: str = "doc_id", rank: str = "rank", digits: int = 6) -> DataFrame:
    """The k best rows of each key by rounded score, ties by the tie column; rank from 1. Spark limits each group before its shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score, digits)), F.col(tie))
    return hits.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


#: Rows of a few short columns that may be broadcast.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it counts at most that many rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
