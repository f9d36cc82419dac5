"""Approximate nearest neighbours: inverted lists of product codes, asymmetric tables, and an exact look at the survivors.

A row is kept in the list of its nearest centre as one byte for each run of dimensions: the code of what is left after the centre.
A query reads the codes of the lists that it probes. Its tables hold the product of each of its runs with each centroid, so a code's
score is the centre's product and one table entry a byte; the best REFINE rows a query survive, and only they are read in full.

Codes stay where they are. Queries come to them in blocks of at most QUERY_BYTES, one copy a block, and a block reads only lists that
one of its queries probes (a pushed filter; the table is sorted by list, and a large list lies in several partitions). What leaves a
batch is a query's best rows of the batch. How many lists are probed is measured on the sample: as many as hold COVER of the true
neighbours there. Sample, lists and queries of a block have fixed bounds; codes grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clusters import codebooks, encode, kmeans, nearest, tables
from ..functions.embeddings import dot, unit
from ..sources.shared import kept
from .ranking import small_side, top_k

#: Bytes of query embeddings sent to the tasks at a time, rows of the sample, most lists, and the share of neighbours that probes must hold.
QUERY_BYTES, SAMPLE_ROWS, MOST_LISTS, COVER = 4 << 20, 20_000, 4096, 0.97
#: Sample rows that ask when probes are measured.
TRIAL_ROWS = 500
#: Queries whose tables a task holds at a time.
TABLE_ROWS = 512


@dataclass
class InvertedFile:
    """codes: (list, doc_id, code), stored; rows: their number. centres and books are small arrays of the driver."""

    codes: DataFrame
    rows: int
    centres: np.ndarray
    books: list[np.ndarray]
    probes: int


def _unit_rows(embeddings) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in embeddings])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, cover: float = COVER) -> int:
    """The least number of nearest lists that hold a share of the sample's true neighbours. The full table is denser, so fewer would do."""
    asked = sample[:: max(1, len(sample) // TRIAL_ROWS)][:TRIAL_ROWS]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // TRIAL_ROWS))[:TRIAL_ROWS]] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, nearest(sample, centres)[near], axis=1)
    return int(np.quantile(ranks, cover, method="higher")) + 1


def build(corpus: DataFrame, k: int, lists: int | None = None, parts: int | None = None) -> InvertedFile | None:
    """The inverted file of corpus (doc_id, vec); None without an embedding. Rows without an embedding are left out."""
    embeddings = corpus.filter(F.col("vec").isNotNull()).select("doc_id", "vec")
    rows = embeddings.count()
    if not rows:
        return None
    sample = _unit_rows(r.vec for r in embeddings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect())
    centres = kmeans(sample, lists or min(MOST_LISTS, max(16, math.isqrt(rows) // 4)))
    books = codebooks(sample - centres[nearest(sample, centres)], parts or max(1, sample.shape[1] // 4))
    held = corpus.sparkSession.sparkContext.broadcast((centres, books))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = held.value
        for batch in batches:
            if batch.num_rows:
                x = _unit_rows(batch.column("vec").to_pylist())
                at = nearest(x, centres)
                codes = encode(x - centres[at], books)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("doc_id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "doc_id", "code"])

    coded = embeddings.mapInArrow(assign, f"list int, doc_id {embeddings.schema['doc_id'].dataType.simpleString()}, code binary")
    stored = kept(coded.repartitionByRange("list", "doc_id").sortWithinPartitions("list"), "inverted-lists")
    return InvertedFile(stored, rows, centres, books, probes_needed(sample, centres, k))


def survivors(index: InvertedFile, queries: DataFrame, refine: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the best rows of each query by their codes. queries: (query_id, vec)."""
    spark, parts = queries.sparkSession, len(index.books)
    asked = queries.filter(F.col("vec").isNotNull()).select("query_id", "vec")
    blocks = max(1, -(-asked.count() * index.centres.shape[1] * 8 // QUERY_BYTES))
    kind = index.codes.schema["doc_id"].dataType.simpleString()

    def search(block: int) -> DataFrame:
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.collect()  # at most about QUERY_BYTES
        if not rows:
            return spark.createDataFrame([], f"query_id long, doc_id {kind}, score double")
        q = _unit_rows(r.vec for r in rows)
        centre = q @ index.centres.T
        probed = np.argsort(-centre, axis=1, kind="stable")[:, : index.probes]
        of = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), q, centre, of, index.books))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, centre, of, books = held.value
            for batch in batches:
                lists = batch.column("list").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), "uint8").reshape(-1, parts)
                own = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for c in np.unique(lists):
                    at, all_ = np.flatnonzero(lists == c), of[int(c)]
                    for first in range(0, len(all_), TABLE_ROWS):
                        who = all_[first : first + TABLE_ROWS]
                        s = np.repeat(centre[who, c][:, None], len(at), axis=1)
                        for table, code in zip(tables(q[who], books), codes[at].T):
                            s += table[:, code]
                        if exclude_self:
                            s[ids[who][:, None] == own[at][None, :]] = -np.inf
                        best = np.lexsort((np.broadcast_to(own[at], s.shape), -np.round(s, 6)), axis=1)[:, :refine]
                        row = np.repeat(np.arange(len(who)), best.shape[1])
                        found = s[row, best.ravel()]
                        ok = np.isfinite(found)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[who][row][ok]), pa.array(own[at][best.ravel()][ok]), pa.array(found[ok])], names=["query_id", "doc_id", "score"])

        # lists that no query of the block probes are not read
        return index.codes.filter(F.col("list").isin(sorted(of))).mapInArrow(score, f"query_id long, doc_id {kind}, score double")

    return top_k(reduce(DataFrame.unionByName, map(search, range(blocks))), refine)


def refine_rows(rows: int, k: int) -> int:
    """Survivors a query: 20 for each row asked for, but no more than a twentieth of the rows, and 2 at least."""
    return max(2 * k, min(20 * k, rows // 20))


def search(index: InvertedFile | None, corpus: DataFrame, queries: DataFrame, k: int, refine: int | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of the survivors by their exact cosine. A zero embedding has cosine 0."""
    if index is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    found = survivors(index, queries, refine or refine_rows(index.rows, k), exclude_self).select("query_id", "doc_id")
    found = kept(found, "survivors")
    # few survivors go to the rows; many meet them by id
    full = corpus.select("doc_id", "vec").join(small_side(found), "doc_id")
    asked = queries.select("query_id", unit(F.col("vec")).alias("_asked"))
    return top_k(full.join(asked, "query_id").select("query_id", "doc_id", dot(unit(F.col("vec")), F.col("_asked")).alias("score")), k)
