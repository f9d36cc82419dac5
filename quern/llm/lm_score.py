"""LM scoring by cross-entropy difference: a target and a background bigram model over one vocabulary.

The vocabulary is every word of all documents. Both models are bigram models smoothed towards their unigrams (Dirichlet):
p(w | v) = (c(v, w) + M p(w)) / (c(v) + M) with p(w) = (c(w) + 1) / (T + V). The background has every document, its counts
scaled to the target's T tokens, so that both models are of one size and are smoothed alike. A document is scored by models that
have not seen it: its own counts are taken out of the background, and out of the target if it belongs to it. The score is the
mean over its tokens of the background loss less the target loss: the higher, the more it is like the target. It is no test
against 0, since counts of a sample are rougher than scaled counts and lose a little on every document.

Counts cover all documents and grow with them, so no task holds a whole model. The COMMON commonest words at most (those above the
count at which that many are left, in steps of a 64th of a doubling) have small ids, and their counts are broadcast; every other
word goes by its 64-bit hash and bigrams by a 64-bit mix of both words, so two share counts with a chance of pairs over 2^64. A
task sends each shard the bigrams of a lot of documents with the documents that hold them, packed. A bigram is dealt to a shard by
itself if its second word is common, else by that word, which then has all its counts in one shard: none of these words has more
than about a COMMON-th of all tokens. A shard, of about SHARD_TOKENS tokens, adds up its counts, takes each document's own out and
returns sums of loss differences by document. The few bigrams that would fill a large part of a shard and hold a HEAVY-th of all
tokens are counted beforehand (at most HEAVY of them) and scored where they stand. Only the common words and those bigrams are
broadcast; neither bound changes a score.

Defined cases: a null text, or one without words, has 0 tokens and score 0; words are split at white space, A-Z lower-cased;
without target documents every score is 0; rows with the same doc_id are scored each, and are the target's if their doc_id is; a
null doc_id stays null and is never the target's; empty tables give empty tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, text_bytes

COMMON, SHARD_TOKENS, HEAVY = 65_534, 500_000, 20_000
#: M: what a context's unigrams weigh in tokens. Held-out AUC on good documents of sf0.1 is 0.80 at 200, 0.83 at 2,000 and 0.86 at 20,000.
SMOOTHING = 10_000.0
#: Tokens and documents of a lot, which a task gathers before it sends them on.
FLUSH_TOKENS, FLUSH_DOCS = 500_000, 16_000
#: Target documents are marked by a broadcast of their ids only up to this number.
BROADCAST_IDS = 2_000_000
#: Set in the ids of words that aren't common.
RARE = 1 << 63
NO_ID = -(1 << 63)


class Ids(dict):
    """word -> 1.. of the common words, a hash of any other."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word) | RARE


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Model:
    """The common words with both their counts, and the sizes of both models; the id after the last is the start of a text."""

    def __init__(self, rows: list[tuple[bytes, int, int]], totals: tuple[int, int, int, int], words: int, smoothing: float):
        self.ids = Ids({w: i + 1 for i, (w, _, _) in enumerate(rows)})
        self.start, self.tokens, self.smoothing = len(rows) + 1, totals[0], smoothing
        self.scale, self.size = totals[1] / max(1, totals[0]), totals[1] + words + 1
        self.counts = np.zeros((2, self.start + 1))
        self.counts[:, 1 : self.start] = np.array([r[1:] for r in rows], float).reshape(-1, 2).T
        self.counts[:, self.start] = totals[2:]

    def context(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What a word adds to the gain of a bigram that it begins, from its counts without the document's."""
        return np.log(self.scale * n + self.smoothing) - np.log(t + self.smoothing)

    def gain(self, n: np.ndarray, t: np.ndarray, own_n: np.ndarray, own_t: np.ndarray) -> np.ndarray:
        """log p_target - log p_background of bigrams but for their first word's part, from their counts and their second word's."""
        m = self.smoothing / self.size
        return np.log(t + m * (own_t + 1)) - np.log(self.scale * n + m * (self.scale * own_n + 1))

    def word_ids(self, raw: bytes) -> np.ndarray:
        return np.array([self.ids[w] for w in raw.lower().split()], np.uint64)


def packed(x: np.ndarray) -> bytes:
    """Counts in the least bytes that hold them all."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{max(1, len(raw) // max(1, n))}")


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, raw, target): target holds doc_ids."""
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct().withColumn("_t", F.lit(True))
    if target.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    return own.join(ids, "doc_id", "left").select("doc_id", "raw", F.coalesce("_t", F.lit(False)).alias("target"))


def unigram_models(texts: DataFrame, smoothing: float) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(every: Counter, own: Counter, docs: int, own_docs: int):
            words = list(every)
            total, total_own = sum(every.values()), sum(own.values())
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([*words, None], pa.binary()),
                    "n": pa.array([*every.values(), total], pa.int64()),
                    "t": pa.array([*(own[w] for w in words), total_own], pa.int64()),
                    "docs": pa.array([0] * len(words) + [docs], pa.int64()),
                    "own_docs": pa.array([0] * len(words) + [own_docs], pa.int64()),
                }
            )

        every, own, docs, own_docs = Counter(), Counter(), 0, 0
        for batch in slices(batches, "raw"):
            for raw, mine in zip(batch.column("raw").to_pylist(), batch.column("target").to_pylist()):
                words = raw.lower().split()
                every.update(words)
                docs += bool(words)
                if mine:
                    own.update(words)
                    own_docs += bool(words)
            if len(every) > 300_000:
                yield from flush(every, own, docs, own_docs)
                every, own, docs, own_docs = Counter(), Counter(), 0, 0
        yield from flush(every, own, docs, own_docs)

    counted = texts.select("raw", "target").mapInArrow(count, "word binary, n long, t long, docs long, own_docs long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("docs").alias("docs"), F.sum("own_docs").alias("own_docs")), "words")
    totals = words.filter(F.col("word").isNull()).first()
    own = words.filter(F.col("word").isNotNull()).withColumn("step", F.floor(F.log2("n") * 64))
    left, least = COMMON, None
    steps = sorted(own.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True)  # a few thousand
    for row in steps:
        left -= row.words
        if left < 0:
            break
        least = row.step
    top = [] if least is None else sorted(own.filter(F.col("step") >= least).select("word", "n", "t").collect(), key=lambda r: (-r.n, bytes(r.word)))  # at most COMMON
    return Model([(bytes(r.word), r.n, r.t) for r in top], (totals.n, totals.t, totals.docs, totals.own_docs) if totals else (0, 0, 0, 0), sum(row.words for row in steps), smoothing)


def heavy_bigrams(texts: DataFrame, held, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in order, and both counts of the bigrams that occur bound times or more: only words as frequent can make one."""
    model = held.value
    if not (model.counts[0, 1:] >= bound).sum():
        return np.zeros(0, np.uint32), np.zeros((2, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        frequent = np.append(model.counts[0] >= bound, False)
        found = Counter(), Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"code": pa.array(list(found[0]), pa.int64()), "n": pa.array(list(found[0].values()), pa.int64()), "t": pa.array([found[1][c] for c in found[0]], pa.int64())})

        for batch in slices(batches, "raw"):
            for mine in (False, True):
                own = [model.word_ids(raw) for raw, m in zip(batch.column("raw").to_pylist(), batch.column("target").to_pylist()) if m == mine]
                for ids in own:
                    w = np.append(np.uint64(model.start), np.minimum(ids, np.uint64(model.start + 1))).astype(np.int64)
                    at = np.flatnonzero(frequent[w[1:]] & frequent[w[:-1]])
                    codes, n = np.unique(w[at] << 16 | w[at + 1], return_counts=True)
                    for k in range(1 + mine):
                        for c, x in zip(codes.tolist(), n.tolist()):
                            found[k][c] += x
            if len(found[0]) > 300_000:
                yield flush()
                found[0].clear()
                found[1].clear()
        yield flush()

    sums = texts.select("raw", "target").mapInArrow(count, "code long, n long, t long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rows = sorted(sums.filter(F.col("n") >= bound).collect())  # at most HEAVY
    return np.array([r.code for r in rows], np.uint32), np.array([(r.n, r.t) for r in rows], float).reshape(-1, 2).T


PARTS = ("names", "words", "place", "own", "word")


def sent_lots(texts: DataFrame, held, heavy, shards: int) -> DataFrame:
    """(shard, lot, names, words, place, own, word, sizes, sums): what each shard has to score, and a row for each lot.

    names: bigrams, both words common (32 bits, words is null) or with a hash (64 bits, words has the second); place: 4 times the
    document's place in its lot, 2 more in the target, 1 more if the bigram ends it; own, word: the document's counts of the
    bigram and of its second word. A lot's own row has doc_ids, sizes and the sums of what needs no shard.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (codes, heavy_counts), task = held.value, heavy.value, TaskContext.get().partitionId()

        def flush(docs, parts, flags, lot):
            sizes = np.array([len(p) for p in parts])
            w = np.concatenate(parts)
            flags = np.array(flags, np.int64)
            owner = np.repeat(np.arange(len(parts)), sizes)
            first = np.append(True, owner[1:] != owner[:-1])[: len(w)]
            last = np.append(owner[1:] != owner[:-1], True)[: len(w)]
            local = pd.factorize(w)[0].astype(np.int64)
            group = pd.factorize(owner * (len(w) + 1) + local)[0].astype(np.int64)
            word = np.bincount(group)[group] if len(w) else group  # the document's count of each token's word
            before, own_before, local_before = (np.where(first, s, np.roll(x, 1)) for x, s in ((w, w.dtype.type(model.start)), (word, 1), (local, len(w))))
            rare_before = before >= np.uint64(RARE)
            at = np.where(rare_before, 0, before).astype(np.int64)
            part = model.context(model.counts[0][at] - own_before, model.counts[1][at] - flags[owner] * own_before)
            sums = np.bincount(owner, np.where(rare_before, 0, part), len(docs))
            # one row for each bigram of a document
            pair = pd.factorize(group * (len(w) + 1) + local_before)[0]
            own = np.bincount(pair)
            ends = np.bincount(pair, last).astype(np.int64)
            pick = np.zeros(len(own), np.int64)
            pick[pair[::-1]] = np.arange(len(pair))[::-1]
            w, before, owner, word = w[pick], before[pick], owner[pick], word[pick]
            both = (w < np.uint64(RARE)) & (before < np.uint64(RARE))
            code = np.where(both, before << np.uint64(16) | w, 0).astype(np.uint32)
            if len(codes):
                spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                here = both & (codes[spot] == code)
                spot, c, f, i = spot[here], own[here], flags[owner[here]], w[here].astype(np.int64)
                gain = model.gain(heavy_counts[0][spot] - c, heavy_counts[1][spot] - f * c, model.counts[0][i] - word[here], model.counts[1][i] - f * word[here])
                sums += np.bincount(owner[here], c * gain, len(docs))
                w, before, owner, word, own, ends, both, code = (x[~here] for x in (w, before, owner, word, own, ends, both, code))
            place = (owner * 4 + flags[owner] * 2 + ends).astype(np.uint16)
            rows = []
            for kind in (True, False):
                k = both == kind
                with np.errstate(over="ignore"):
                    names = code[k] if kind else mixed(mixed(before[k]) + w[k])
                shard = (mixed(np.where(w[k] >= np.uint64(RARE), w[k], names.astype(np.uint64))) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((names, shard))
                shard, names, words, p, o, c = (x[order] for x in (shard, names, w[k], place[k], own[k], word[k]))
                starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
                for a, b in zip(starts, np.append(starts[1:], len(shard))):
                    rows.append((int(shard[a]), names[a:b].tobytes(), None if kind else words[a:b].tobytes(), p[a:b].tobytes(), packed(o[a:b]), packed(c[a:b]), None, None))
            rows.append(((task + lot) % shards, np.array(docs, np.int64).tobytes(), None, None, None, None, sizes.astype(np.int64).tobytes(), sums.tobytes()))
            columns = {c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate((*PARTS, "sizes", "sums"), 1)}
            yield pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int64()), "lot": pa.array([task << 32 | lot] * len(rows), pa.int64())} | columns)

        docs, parts, flags, size, lot = [], [], [], 0, 0
        for batch in slices(batches, "raw"):
            for doc, raw, mine in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "target"))):
                docs.append(NO_ID if doc is None else doc)
                parts.append(model.word_ids(raw))
                flags.append(mine)
                size += len(parts[-1])
                if size >= FLUSH_TOKENS or len(docs) == FLUSH_DOCS:
                    yield from flush(docs, parts, flags, lot)
                    docs, parts, flags, size, lot = [], [], [], 0, lot + 1
        if docs:
            yield from flush(docs, parts, flags, lot)

    return texts.mapInArrow(send, "shard long, lot long, " + ", ".join(f"{c} binary" for c in (*PARTS, "sizes", "sums")))


def shard_sums(model: Model, rows: pd.DataFrame, kind: bool, lots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bigrams of one kind in a shard: 2^14 times the lot plus the document's place, and its sum of loss differences."""
    names = [np.frombuffer(x, np.uint32 if kind else np.uint64) for x in rows["names"]]
    counts = [len(x) for x in names]
    own, word = (np.concatenate([unpacked(x, n) for x, n in zip(rows[c], counts)]).astype(np.int64) for c in ("own", "word"))
    place = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["place"]]).astype(np.int64)
    names = np.concatenate(names)
    w = (names & np.uint32(65535)).astype(np.uint64) if kind else np.concatenate([np.frombuffer(x, np.uint64) for x in rows["words"]])
    flag, doc = place >> 1 & 1, np.repeat(lots, counts) << 14 | place >> 2
    at = pd.factorize(names)[0]
    n, t = np.bincount(at, own)[at] - own, np.bincount(at, own * flag)[at] - own * flag
    rare = w >= np.uint64(RARE)
    uni = model.counts[:, np.where(rare, 0, w).astype(np.int64)]
    if rare.any():
        by = pd.factorize(w[rare])[0]
        uni[:, rare] = [np.bincount(by, x[rare])[by] for x in (own, own * flag)]
    uni -= word, word * flag
    sums = own * model.gain(n, t, *uni) + np.where(rare, (own - (place & 1)) * model.context(*uni), 0)
    return doc, sums


def score_documents(docs: DataFrame, target: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(doc_id, n_tokens, score) for each document; target holds the doc_ids of the target's documents."""
    spark = docs.sparkSession
    texts = marked(docs, target)
    model = unigram_models(texts, smoothing)
    shards = max(4, -(-model.tokens // SHARD_TOKENS))
    held = spark.sparkContext.broadcast(model)
    heavy = spark.sparkContext.broadcast(heavy_bigrams(texts, held, max(2, SHARD_TOKENS // 4, model.tokens // HEAVY)))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["sizes"].notna()
        out = list(zip(*(pdf[whole][c] for c in ("lot", "names", "sizes", "sums"))))
        codes, lots = pd.factorize(pdf["lot"])
        found = []
        for kind in (True, False):
            k = (~whole & (pdf["words"].isna() == kind)).to_numpy()
            if k.any():
                found.append(shard_sums(held.value, pdf[k], kind, codes[k].astype(np.int64)))
        if found:
            owner, sums = (np.concatenate(x) for x in zip(*found))
            owner, at = np.unique(owner, return_inverse=True)
            sums = np.bincount(at, sums).astype(np.float32)
            starts = np.flatnonzero(np.append(True, owner[1:] >> 14 != owner[:-1] >> 14))
            for a, b in zip(starts, np.append(starts[1:], len(owner))):
                out.append((lots[owner[a] >> 14], (owner[a:b] & 16383).astype(np.uint16).tobytes(), None, sums[a:b].tobytes()))
        return pd.DataFrame(out, columns=["lot", "owner", "sizes", "sums"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf[pdf["sizes"].notna()].iloc[0]
        ids, sizes, total = np.frombuffer(whole["owner"], np.int64), np.frombuffer(whole["sizes"], np.int64), np.frombuffer(whole["sums"], float).copy()
        for owner, sums in zip(*(pdf[pdf["sizes"].isna()][c] for c in ("owner", "sums"))):
            total[np.frombuffer(owner, np.uint16)] += np.frombuffer(sums, np.float32)
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), ids == NO_ID), "n_tokens": sizes, "score": total / np.maximum(sizes, 1)})

    asked = sent_lots(texts, held, heavy, shards).repartition(shards, "shard")
    answers = asked.groupBy("shard").applyInPandas(answer, "lot long, owner binary, sizes binary, sums binary")
    return answers.groupBy("lot").applyInPandas(gather, "doc_id long, n_tokens long, score double").withColumn("score", F.round("score", 6))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return score_documents(table(spark, sf_dir, "documents"), good)


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
SQL: dict[str, str] = {}
