"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded as frequencies of character classes and of their
pairs with a few word statistics. The model learns, from document labels alone, a hidden layer, gated attention weights
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))) and a logistic score of the weighted passage representation sum a_k h_k.

Training takes a bounded sample of labelled documents, TRAIN_DOCS by hash order, and scoring every document, both with every
passage. The sample's encoded passages stand in a file of the driver and are read a batch of documents at a time. doc_id, lang, source and labels are never inputs of a score.

Defined cases: a null or empty text is one passage without characters and gets a score like any other; a text of any length is
scored whole, a slice of passages at a time; equal texts get equal scores; without labels of both kinds every score is their
mean, or 1 if there are none; an empty table gives an empty table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, slices, stored, table, text_bytes

PASSAGE_WORDS, TRAIN_DOCS = 64, 4000
HIDDEN, ATTENTION, EPOCHS, RATE = 24, 12, 40, 0.01
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    """A class of each byte: lower, upper, digit, blank, light and heavy punctuation, symbols, lead and other bytes of UTF-8."""
    c = np.full(256, 9, np.int64)
    for i in range(256):
        ch = chr(i)
        if i >= 192:
            c[i] = 7
        elif i >= 128:
            c[i] = 8
        elif ch.islower():
            c[i] = 0
        elif ch.isupper():
            c[i] = 1
        elif ch.isdigit():
            c[i] = 2
        elif ch.isspace():
            c[i] = 3
        elif ch in ".,;:'":
            c[i] = 4
        elif ch in "!?\"()-":
            c[i] = 5
        elif ch in "#*$%&|<>@=+_/\\~^{}[]":
            c[i] = 6
    return c


CLASS = _classes()
N_CLASSES = 10
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 4


def passages(raw: bytes) -> tuple[list[bytes], list[tuple[float, ...]]]:
    """The passages of a text and of each: distinct words and direct repeats as shares, mean word length, words."""
    words = raw.split()
    texts, stats = [], []
    for i in range(0, max(1, len(words)), PASSAGE_WORDS):
        own = words[i : i + PASSAGE_WORDS]
        text = b" ".join(own)
        n = max(1, len(own))
        texts.append(text)
        stats.append((len(set(own)) / n, sum(map(bytes.__eq__, own, own[1:])) / n, min(len(text) / n, 40) / 10, n / PASSAGE_WORDS))
    return texts, stats


def encode(texts: list[bytes], stats: list[tuple[float, ...]]) -> np.ndarray:
    """A row of N_FEATURES for each passage."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    c = CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(n), sizes)
    single = np.bincount(owner * N_CLASSES + c, minlength=n * N_CLASSES).reshape(n, -1)
    inside = owner[1:] == owner[:-1]
    at = (owner[1:] * N_CLASSES + c[:-1]) * N_CLASSES + c[1:]
    pairs = np.bincount(at[inside], minlength=n * N_CLASSES**2).reshape(n, -1)
    total = np.maximum(sizes, 1)[:, None]
    return np.concatenate((np.sqrt(single / total), np.sqrt(pairs / total), np.array(stats).reshape(n, 4)), axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated attention over bags; bag holds the bag of each row and rows of a bag are adjacent."""

    def __init__(self, features: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, 1 / np.sqrt(features), (features, HIDDEN)), "c": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
            "w": r.normal(0, 0.3, ATTENTION), "o": r.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
        }
        self.mean, self.scale, self.constant = np.zeros(features, np.float32), np.ones(features, np.float32), None

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """h and the unnormalised log attention of each passage: all that a document's score needs of it."""
        h = np.tanh(((x - self.mean) / self.scale) @ self.p["W"] + self.p["c"])
        return h, (np.tanh(h @ self.p["V"]) * _sigmoid(h @ self.p["U"])) @ self.p["w"]

    def bags(self, h: np.ndarray, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each bag."""
        a = np.exp(e)  # |e| is at most the sum of |w|
        z = np.add.reduceat(a[:, None] * h, starts) / np.add.reduceat(a, starts)[:, None]
        return _sigmoid(z @ self.p["o"] + self.p["b"])

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, seed: int = 7) -> AttentionModel:
        lots = [slice(i, i + 8192) for i in range(0, len(x), 8192)]
        self.mean = sum(x[s].sum(axis=0, dtype=float) for s in lots) / len(x)
        self.scale = np.sqrt(sum(((x[s] - self.mean) ** 2).sum(axis=0) for s in lots) / len(x)) + 1e-3
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 1.0
            return self
        ends = np.append(starts[1:], len(x))
        r, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(order), 128):
                pick = order[i : i + 128]
                rows = np.concatenate([np.arange(starts[j], ends[j]) for j in pick])
                n = ends[pick] - starts[pick]
                bag, at = np.repeat(np.arange(len(pick)), n), np.cumsum(n) - n
                xb = (x[rows] - self.mean) / self.scale
                h = np.tanh(xb @ p["W"] + p["c"])
                tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
                a = np.exp((tv * su) @ p["w"])
                a /= np.add.reduceat(a, at)[bag]
                z = np.add.reduceat(a[:, None] * h, at)
                d = (_sigmoid(z @ p["o"] + p["b"]) - y[pick]) / len(pick)
                dz = d[:, None] * p["o"]
                da = (dz[bag] * h).sum(axis=1)
                de = a * (da - np.add.reduceat(a * da, at)[bag])
                dg = de[:, None] * p["w"]
                dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
                dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
                dx = dh * (1 - h**2)
                g = {"o": z.T @ d, "b": np.array([d.sum()]), "w": (tv * su).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": xb.T @ dx + 1e-4 * p["W"], "c": dx.sum(axis=0)}
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """A fourth of the documents, whose labels no model sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", docs_limit: int = TRAIN_DOCS) -> AttentionModel:
    """A model from a bounded sample of the labelled documents that aren't held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    picked = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_limit)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"), F.min("y").alias("y"))  # of repeated ids the least text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw"):
            found = []
            for raw in batch.column("raw").to_pylist():
                texts, stats = passages(raw)
                found.append(b"".join(encode(texts[i : i + 4096], stats[i : i + 4096]).tobytes() for i in range(0, len(texts), 4096)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array(found, pa.binary())})

    bags = stored(sample.mapInArrow(cut, "doc_id long, y double, x binary"), "quality-bags").sort("doc_id")
    model, sizes, y = AttentionModel(N_FEATURES), [], []
    with tempfile.TemporaryFile() as file:
        for r in bags.toLocalIterator():  # at most docs_limit, a partition at a time
            file.write(r.x)
            sizes.append(len(r.x) // (4 * N_FEATURES))
            y.append(r.y)
        if not y:
            model.constant = 1.0
            return model
        file.flush()
        return model.fit(np.memmap(file, np.float32, "r").reshape(-1, N_FEATURES), np.cumsum(sizes) - sizes, np.array(y))


def score_quality(docs: DataFrame, model: AttentionModel, column: str = "score") -> DataFrame:
    """All columns of docs and a score from 0 to 1, in place of a column so named."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    raw_name = free_name(docs, "_raw")
    columns = [c for c in docs.columns if c.lower() != column.lower()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches, raw_name, 1 << 20):
            if own.constant is not None:
                scores = np.full(batch.num_rows, own.constant)
            else:
                hs, es, counts = [], [], []
                texts, stats = [], []
                for raw in batch.column(raw_name).to_pylist():
                    t, s = passages(raw)
                    counts.append(len(t))
                    texts += t
                    stats += s
                for i in range(0, len(texts), 4096):
                    h, e = own.parts(encode(texts[i : i + 4096], stats[i : i + 4096]))
                    hs.append(h)
                    es.append(e)
                scores = own.bags(np.concatenate(hs), np.concatenate(es), np.cumsum(counts) - counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], names=[*columns, column])

    return docs.select(*(F.col(f"`{c}`") for c in columns), text_bytes().alias(raw_name)).mapInArrow(score, f"{schema}, `{column}` double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that the classifier rejects."""
    own = free_name(docs, "_score")
    return score_quality(docs, train(docs, labels), own).filter(F.col(own) >= threshold).drop(own)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
