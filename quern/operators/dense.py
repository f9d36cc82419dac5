"""Exact and approximate nearest neighbours, late interaction and sparse products.

knn multiplies blocks: the queries of a block are sent to every task (a block holds at most QUERY_BYTES), each Arrow batch of the
corpus is multiplied with it in tiles of at most TILE scores, and only k rows a query are held by a task and leave it. More queries mean
more blocks, never a larger broadcast or a larger matrix of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embeddings import doubles, norm, unit
from ..sources.shared import kept
from .ranking import small_side, top_k

#: Bytes of query embeddings that are sent to the tasks at a time.
QUERY_BYTES = 16 << 20
#: Scores that a task computes at a time.
TILE = 1 << 20


def tiles(n: int, width: int, tile: int) -> list[tuple[int, int]]:
    """Ranges of n rows of which each has at most tile numbers, one row at least."""
    step = max(1, tile // max(width, 1))
    return [(i, min(i + step, n)) for i in range(0, n, step)]


def _matrix(embeddings, dimensions: int) -> np.ndarray:
    return np.array([np.zeros(dimensions) if v is None else np.asarray(v, float) for v in embeddings]).reshape(-1, dimensions)


class Best:
    """The k best documents of each of some queries so far, by score rounded to 6 places, ties by id. k rows a query are held."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.doc, self.least = k, np.full((n, k), -np.inf), np.zeros((n, k), "int64"), np.full(n, -np.inf)

    def add(self, first: int, docs: np.ndarray, s: np.ndarray, ids: np.ndarray | None = None) -> None:
        """Scores s of documents for the queries from place first on; ids: the queries' own, which no document of that id is a hit of."""
        start, width = 0, s.shape[1]
        if np.isneginf(self.least[first : first + len(s)]).any():
            width = 8 * self.k  # a few documents make a threshold, so that not all of the others are sorted
        while start < s.shape[1]:
            self._add(first, docs[start : start + width], s[:, start : start + width], ids)
            start, width = start + width, 2 * width

    def _add(self, first: int, docs: np.ndarray, s: np.ndarray, ids: np.ndarray | None) -> None:
        # rounding moves a score by less than 1e-6: what cannot reach the k-th is not rounded, sorted or kept
        row, col = np.nonzero(s >= self.least[first : first + len(s), None] - 1e-6)
        score, doc = s[row, col], docs[col]
        fit = np.isfinite(score)
        if ids is not None:
            fit &= doc != ids[first + row]
        row, score, doc = row[fit], score[fit], doc[fit]
        if not len(row):
            return
        some, at = np.unique(row, return_inverse=True)
        held = self.score[first + some]
        old_row, old_col = np.nonzero(np.isfinite(held))
        at = np.concatenate((old_row, at))
        score = np.concatenate((held[old_row, old_col], score))
        doc = np.concatenate((self.doc[first + some][old_row, old_col], doc))
        order = np.lexsort((doc, -np.round(score, 6), at))
        at, score, doc = at[order], score[order], doc[order]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        top = place < self.k
        at, score, doc, place = first + some[at[top]], score[top], doc[top], place[top]
        self.score[at, place], self.doc[at, place] = score, doc
        full = place == self.k - 1
        self.least[at[full]] = np.round(score[full], 6)

    def frames(self, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        """(query_id, doc_id, score) of all queries, in bounded pieces."""
        step = max(1, TILE // (16 * max(self.k, 1)))
        for i in range(0, len(ids), step):
            row, col = np.nonzero(np.isfinite(self.score[i : i + step]))
            if len(row):
                yield pd.DataFrame({"query_id": ids[i + row], "doc_id": self.doc[i + row, col], "score": self.score[i + row, col]})


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): corpus (doc_id, vec), queries (query_id, vec). A zero embedding has cosine 0."""
    spark = corpus.sparkSession
    first = queries.filter(F.col("vec").isNotNull()).select(F.size("vec").alias("d")).head()
    if first is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    dimensions, tile = first.d, TILE
    blocks = max(1, -(-queries.count() * dimensions * 8 // QUERY_BYTES))

    def search(block: int) -> DataFrame:
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.select("query_id", "vec").collect()  # at most about QUERY_BYTES
        q = _matrix([r.vec for r in rows], dimensions)
        if metric == "cosine":
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], "int64"), q))

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            best = Best(len(ids), k)
            for pdf in batches:
                if not len(pdf):
                    continue
                own, x = pdf["doc_id"].to_numpy(), _matrix(pdf["vec"], dimensions)
                if metric == "cosine":
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for a, b in tiles(len(ids), len(own), tile):
                    best.add(a, own, q[a:b] @ x.T, ids if exclude_self else None)
            yield from best.frames(ids)

        return corpus.select("doc_id", "vec").mapInPandas(multiply, "query_id long, doc_id long, score double")

    found = reduce(DataFrame.unionByName, map(search, range(blocks)))
    return top_k(found, k)


def knn_cosine(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """knn with distance = 1 - cosine."""
    return knn(corpus, queries, k, "cosine", exclude_self).withColumn("distance", 1 - F.col("score"))


def with_relevance(hits: DataFrame, column: str = "relevance") -> DataFrame:
    """1 - distance within [0, 1]; 0.5 where the distance is null."""
    return hits.withColumn(column, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance"))), F.lit(0.5)))


def dense_scores(hits: DataFrame) -> DataFrame:
    """dense_score = max(0, 1 - distance), rank from 0."""
    return hits.withColumn("dense_score", F.greatest(F.lit(0.0), 1 - F.col("distance"))).withColumn("rank", F.col("rank") - 1)


def knn_checked(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """knn_relevance for queries with text; limits outside 1 to 100 are refused."""
    if not 1 <= k <= 100:
        raise ValueError("limit must be from 1 to 100")
    return with_relevance(knn_cosine(corpus, queries.filter(F.trim("text") != ""), k))


def metadata_filter_search(corpus: DataFrame, queries: DataFrame, k: int, where: str, min_relevance: float = 0.0) -> DataFrame:
    """Top-k among the rows that meet a predicate, then those of at least min_relevance."""
    return with_relevance(knn_cosine(corpus.filter(where), queries, k)).filter(F.round("relevance", 6) >= min_relevance)


def normalize_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, unit(F.col(vec)))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(doc_id, vec): the unit mean of the unmasked token embeddings (doc_id, pos, vec, mask)."""
    parts = tokens.filter("mask").select("doc_id", F.posexplode("vec").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg("x").alias("x"))
    return normalize_vectors(parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec")))


#: Tokens that late interaction masks: fixed values.
PUNCTUATION = (".", ",", "!", "?", ";", ":")


def mask_punct(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.filter(~F.col(token).isin(*PUNCTUATION))


#: Token rows beyond which a document is not brought together in one task.
LONG_TOKENS = 100_000


class _Tokens:
    """The unit token embeddings of a batch by document, and the best cosine of query tokens among the tokens of each document."""

    def __init__(self, pdf: pd.DataFrame, dimensions: int):
        self.docs, at = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        x = _matrix(pdf["vec"], dimensions)[order]
        self.x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        self.starts = np.searchsorted(at[order], np.arange(len(self.docs)))

    def maxima(self, q: np.ndarray, tile: int) -> np.ndarray:
        out = np.empty((len(q), len(self.docs)))
        for a, b in tiles(len(q), len(self.x), tile):  # a query of very many tokens is no larger matrix of cosines
            out[a:b] = np.maximum.reduceat(q[a:b] @ self.x.T, self.starts, axis=1)
        return out


def query_tiles(starts: np.ndarray, n: int, width: int, tile: int) -> list[tuple[int, int]]:
    """Ranges of whole queries, that begin at starts of n token rows, with at most tile scores against width token rows; one query at least."""
    room, out, first = max(1, tile // max(width, 1)), [], 0
    ends = np.append(starts[1:], n)
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + room, side="right")))
        out.append((first, last))
        first = last
    return out


def maxsim(doc_tokens: DataFrame, query_tokens: DataFrame, k: int, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """Sum over query tokens of the best cosine among a document's tokens. Both tables: (id, pos, vec) with unit embeddings made here.

    Token rows are brought together by document, once for all queries; a task reads them in that order and holds the maxima of one
    unfinished document and k rows a query, in tiles of about TILE cosines. Queries go to the tasks in blocks of whole queries. A document of more than
    long_tokens rows stays where it is instead: each batch leaves its maxima of the query tokens, which are then joined. There are at
    most a long_tokens-th of the rows of those. Rows without doc_id count for no document.
    """
    spark = doc_tokens.sparkSession
    asked = query_tokens.select("query_id", "pos", doubles(F.col("vec")).alias("vec"))
    size = asked.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0
    blocks, tile = max(1, -(-size * 8 // QUERY_BYTES)), TILE
    tokens = doc_tokens.select("doc_id", "vec").filter(F.col("doc_id").isNotNull())
    lengthy = tokens.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > long_tokens).select("doc_id")
    any_long = bool(lengthy.head(1))
    usual = tokens.join(lengthy, "doc_id", "left_anti") if any_long else tokens
    ordered = usual.repartition("doc_id").sortWithinPartitions("doc_id")

    def search(block: int) -> list[DataFrame]:
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.orderBy("query_id", "pos").collect()  # at most about QUERY_BYTES
        q = np.array([r.vec for r in rows], float).reshape(len(rows), -1 if rows else 1)
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            asked_ids, starts = np.unique(ids, return_index=True)  # rows are in the order of their queries
            ends, best = np.append(starts[1:], len(ids)), Best(len(asked_ids), k)
            last, open_top = None, np.empty(len(ids))  # the maxima of the document that may go on in the next batch
            for pdf in batches:
                if not len(ids) or not len(pdf):
                    continue
                own = _Tokens(pdf, q.shape[1])
                docs, goes_on = own.docs, last is not None and own.docs[0] == last
                if last is not None and not goes_on:
                    best.add(0, np.array([last]), np.add.reduceat(open_top, starts)[:, None])
                for a, b in query_tiles(starts, len(ids), len(own.x), tile):
                    rows = slice(starts[a], ends[b - 1])
                    top = own.maxima(q[rows], tile)
                    if goes_on:
                        top[:, 0] = np.maximum(top[:, 0], open_top[rows])
                    open_top[rows] = top[:, -1]
                    if len(docs) > 1:
                        best.add(a, docs[:-1], np.add.reduceat(top[:, :-1], starts[a:b] - starts[a], axis=0))
                last = docs[-1]
            if last is not None:
                best.add(0, np.array([last]), np.add.reduceat(open_top, starts)[:, None])
            yield from best.frames(asked_ids)

        def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for pdf in batches:
                if not len(ids) or not len(pdf):
                    continue
                own = _Tokens(pdf, q.shape[1])
                docs = own.docs
                for a, b in tiles(len(ids), len(own.x), tile):
                    token, top = np.arange(a, b), own.maxima(q[a:b], tile)
                    yield pd.DataFrame({"query_id": np.repeat(ids[a:b], len(docs)), "token": np.repeat(token, len(docs)), "doc_id": np.tile(docs, b - a), "best": top.ravel()})

        found = [ordered.mapInPandas(whole, "query_id long, doc_id long, score double")]
        if any_long:
            parts = tokens.join(lengthy, "doc_id", "left_semi").mapInPandas(pieces, "query_id long, token long, doc_id long, best double")
            joined = parts.groupBy("query_id", "token", "doc_id").agg(F.max("best").alias("best"))
            found.append(joined.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score")))
        return found

    return top_k(reduce(DataFrame.unionByName, (df for block in range(blocks) for df in search(block))), k)


def sparse_encode(weights: DataFrame, pooling: str = "max", alpha: float = 0.0) -> DataFrame:
    """(doc_id, term, w) from token weights (doc_id, term, w): log(1 + relu(w)) pooled, those up to alpha dropped."""
    pool = {"max": F.max, "sum": F.sum, "mean": F.avg}[pooling]
    return weights.groupBy("doc_id", "term").agg(pool(F.log1p(F.greatest(F.col("w"), F.lit(0.0)))).alias("w")).filter(F.col("w") > alpha)


#: Rows (query, term) that are sent to the tasks at a time.
ASKED_ROWS = 200_000


def sparse_dot(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dot products of sparse embeddings (id, term, w); pairs without a common term are absent.

    No row is made for a pair: a document's terms come together once, queries go to the tasks in blocks of whole queries, and a task keeps
    k rows a query. Where all weights are above 0, block maxima bound the products (quern.operators.blockmax), and what cannot be among the
    k best is not computed; else products add up in tiles of about TILE cells.
    """
    from . import blockmax

    spark = docs.sparkSession
    asked = kept(queries.select("query_id", "term", F.col("w").cast("double").alias("w")).filter(F.col("query_id").isNotNull() & F.col("term").isNotNull() & F.col("w").isNotNull()), "sparse-queries")
    blocks, tile = max(1, -(-asked.count() // ASKED_ROWS)), TILE
    wanted = docs.filter(F.col("doc_id").isNotNull() & F.col("w").isNotNull()).join(small_side(asked.select("term").distinct()), "term", "left_semi")
    whole = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("term", F.col("w").cast("double").alias("w"))).alias("own")).select("doc_id", F.col("own.term").alias("terms"), F.col("own.w").alias("w"))
    if (asked.agg(F.min("w")).first()[0] or 0) > 0:
        index = blockmax.build_weighted(whole.withColumnRenamed("terms", "tokens"))
        if index.least > 0:
            return blockmax.search_weighted(index, asked, k)
    if blocks > 1:
        whole = kept(whole, "sparse-documents")

    def search(block: int) -> DataFrame:
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.toArrow().combine_chunks()  # at most about ASKED_ROWS
        ids, query = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
        names = pc.unique(rows.column("term"))
        code = pc.index_in(rows.column("term"), names).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(names) + 1))
        held = spark.sparkContext.broadcast((ids, names, starts, query[order], rows.column("w").to_numpy()[order]))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, names, starts, query, qw = held.value
            best, room = Best(len(ids), k), max(1, tile // max(1, len(ids)))
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                docs, lists = batch.column("doc_id").to_numpy(), batch.column("terms")
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(lists.flatten(), names), -1).to_numpy(zero_copy_only=False).astype("int64")
                w, ends = batch.column("w").flatten().to_numpy(), np.append(0, np.cumsum(size))
                for a in range(0, len(docs), room):
                    b = min(a + room, len(docs))
                    own = slice(ends[a], ends[b])
                    fit = code[own] >= 0
                    term, weight, doc = code[own][fit], w[own][fit], np.repeat(np.arange(b - a), size[a:b])[fit]
                    n = starts[term + 1] - starts[term]
                    score, met = np.zeros(len(ids) * (b - a)), np.zeros(len(ids) * (b - a), bool)
                    for c, d in runs(n, tile):  # very common terms of very many queries come a part at a time
                        at = np.arange(n[c:d].sum()) + np.repeat(starts[term[c:d]] - np.cumsum(n[c:d]) + n[c:d], n[c:d])
                        cell = query[at] * (b - a) + np.repeat(doc[c:d], n[c:d])
                        score += np.bincount(cell, qw[at] * np.repeat(weight[c:d], n[c:d]), len(score))
                        met[cell] = True
                    best.add(0, docs[a:b], np.where(met, score, -np.inf).reshape(len(ids), b - a))
            for frame in best.frames(ids):
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        return whole.mapInArrow(multiply, "query_id long, doc_id long, score double")

    return top_k(reduce(DataFrame.unionByName, map(search, range(blocks))), k)


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of sizes with a sum of about limit, one at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield first, last
        first = last


def knn_ann(corpus: DataFrame, queries: DataFrame, k: int, refine: int | None = None, exclude_self: bool = False) -> DataFrame:
    """Approximate knn_cosine by inverted lists of product codes (quern.operators.ivf): few rows a query are read in full."""
    from . import ivf

    return ivf.search(ivf.build(corpus, k), corpus, queries, k, refine, exclude_self)


def pair_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """distance = 1 - cosine of two embedding columns."""
    from ..functions.embeddings import cosine

    return df.withColumn("distance", 1 - cosine(F.col(a), F.col(b)))


__all__ = ["dense_scores", "knn", "knn_ann", "knn_checked", "knn_cosine", "mask_punct", "maxsim", "mean_pool", "metadata_filter_search", "norm", "normalize_vectors", "pair_distance", "sparse_dot", "sparse_encode", "with_relevance"]
