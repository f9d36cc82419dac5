"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

The statistics are exact counts over the whole text. Trees are grown level by level on binned statistics with logistic loss;
where a statistic has a monotonic direction, a split against it is refused and the children's values are bounded by the middle
of the two, so the score never rises with, say, the share of symbols. For scoring all trees lie in five flat arrays, and every
document walks all of them at once, a level a step.

Training takes a bounded sample of labelled documents, TRAIN_DOCS by hash order; a fourth of the labels is held out.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; texts of any length are counted whole;
without labels of both kinds the trees give a constant; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes
from .quality import held_out

SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:"
TRAIN_DOCS, TREES, DEPTH, BINS, SHRINKAGE, L2, LEAST_WEIGHT = 20_000, 40, 4, 32, 0.2, 1.0, 2.0
KEEP_SCORE = 0.5
#: Statistics that the trees see, with the direction in which each may move the score (0: free).
STATISTICS = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1,
    "digit_share": 0, "stop_share": 0, "distinct_share": 0, "words_per_line": 0, "shout_share": -1, "next_repeat_share": -1,
}


def repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words in windows of size words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    c = np.array([codes.setdefault(w, len(codes)) for w in words], np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ (c[i : i + n] + np.uint64(i + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[size : size + n] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(raw: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and STATISTICS in order."""
    words = raw.split()
    lines = raw.split(b"\n")
    n = len(words)
    if raw.isascii():
        chars = sum(map(len, words))
    else:
        chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(b" \t\n\x0b\x0c\r"))
        else:
            seen.add(line)
    repeats = repeat_words(words)
    size, least = max(1, len(raw)), max(1, n)
    gone = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    stats = (np.log1p(n), min(chars / least, 40.0), min(symbols / least, 5.0), repeats / least, again / len(lines), gone(UPPER), gone(DIGITS), gone(STOPS), len(set(words)) / least, min(n / len(lines), 200.0), gone(b"!?"), sum(map(bytes.__eq__, words, words[1:])) / least)
    return (n, chars, symbols, again, repeats), stats


class Trees:
    """Boosted trees as flat arrays: statistic, cut, left and right child and value of each node; roots by tree."""

    def __init__(self, directions: list[int]):
        self.directions, self.base = directions, 0.0
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            self.base = 30.0
            return self.flat()
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        if len(set(y.tolist())) < 2:
            return self.flat()
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(binned, edges, p - y, p * (1 - p))
        return self.flat()

    def _node(self, value: float) -> int:
        me = len(self.value)
        for a, v in ((self.feature, 0), (self.cut, np.inf), (self.left, me), (self.right, me), (self.value, value)):
            a.append(v)
        return me

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        weight = lambda a, b: -a / (b + L2)
        worth = lambda a, b, w: -(a * w + 0.5 * (b + L2) * w * w)
        root = self._node(float(weight(g.sum(), h.sum())) * SHRINKAGE)
        self.roots.append(root)
        at = np.full(len(g), root)
        level = {root: (-np.inf, np.inf)}
        for _ in range(DEPTH):
            nodes = list(level)
            where = np.full(len(self.value), -1)
            where[nodes] = np.arange(len(nodes))
            slot = where[at]
            ok = slot >= 0
            best = [(1e-3, None)] * len(nodes)
            for f, direction in enumerate(self.directions):
                code = slot[ok] * BINS + binned[ok, f]
                hg, hh = (np.bincount(code, z[ok], len(nodes) * BINS).reshape(-1, BINS) for z in (g, h))
                lg, lh = np.cumsum(hg, axis=1)[:, :-1], np.cumsum(hh, axis=1)[:, :-1]
                tg, th = hg.sum(axis=1)[:, None], hh.sum(axis=1)[:, None]
                low, high = (np.array([level[k][i] for k in nodes])[:, None] for i in (0, 1))
                wl, wr, w = (np.clip(weight(a, b), low, high) for a, b in ((lg, lh), (tg - lg, th - lh), (tg, th)))
                gain = worth(lg, lh, wl) + worth(tg - lg, th - lh, wr) - worth(tg, th, w)
                gain[(lh < LEAST_WEIGHT) | (th - lh < LEAST_WEIGHT) | (direction * (wr - wl) < 0)] = -np.inf
                for k in range(len(nodes)):
                    b = int(np.argmax(gain[k]))
                    if gain[k, b] > best[k][0] and b < len(edges[f]):
                        best[k] = (gain[k, b], (f, b, float(wl[k, b]), float(wr[k, b])))
            new = {}
            for k, (_, split) in zip(nodes, best):
                if split is None:
                    continue
                f, b, wl, wr = split
                low, high = level[k]
                middle = (wl + wr) / 2
                self.feature[k], self.cut[k] = f, float(edges[f][b])
                self.left[k], self.right[k] = self._node(wl * SHRINKAGE), self._node(wr * SHRINKAGE)
                d = self.directions[f]
                new[self.left[k]] = (low, min(high, middle)) if d > 0 else (max(low, middle), high) if d < 0 else (low, high)
                new[self.right[k]] = (max(low, middle), high) if d > 0 else (low, min(high, middle)) if d < 0 else (low, high)
                mine = at == k
                at[mine] = np.where(binned[mine, f] <= b, self.left[k], self.right[k])
            level = new
            if not level:
                break
        return np.array(self.value)[at]

    def flat(self) -> Trees:
        for name, kind in (("feature", np.int64), ("cut", float), ("left", np.int64), ("right", np.int64), ("value", float), ("roots", np.int64)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each row."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.repeat(self.roots[None], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, COUNTS and an array of STATISTICS for each document."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_raw"):
            found = [counts(raw) for raw in batch.column("_raw").to_pylist()]
            own = {c: batch.column(c) for c in keep} | {n: pa.array([f[0][i] for f in found], pa.int64()) for i, n in enumerate(COUNTS)}
            yield pa.RecordBatch.from_pydict(own | {"stats": pa.array([list(map(float, f[1])) for f in found], pa.list_(pa.float64()))})

    return docs.select(*keep, text_bytes().alias("_raw")).mapInArrow(measure, f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}, stats array<double>")


def train_trees(docs: DataFrame, labels: DataFrame, docs_limit: int = TRAIN_DOCS) -> Trees:
    """Trees from a bounded sample of the labelled documents that aren't held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    picked = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_limit)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # of repeated ids the least text
    rows = sorted(document_statistics(sample, ("doc_id", "y")).select("doc_id", "y", "stats").collect(), key=lambda r: r.doc_id)  # at most docs_limit
    x = np.array([r.stats for r in rows], float).reshape(-1, len(STATISTICS))
    return Trees(list(STATISTICS.values())).fit(x, np.array([r.y for r in rows], float))


def judge_quality(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",), threshold: float = KEEP_SCORE) -> DataFrame:
    """keep columns, COUNTS, base_failed, score and kept."""
    held = docs.sparkSession.sparkContext.broadcast(trees)
    measured = document_statistics(docs, keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields if f.name != "stats")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").flatten(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "stats"), pa.array(held.value.score(x), pa.float64())], names=[*(n for n in batch.schema.names if n != "stats"), "score"])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = measured.mapInArrow(score, f"{schema}, score double")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_quality(docs, train_trees(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL: dict[str, str] = {}
