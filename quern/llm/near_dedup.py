"""MinHash near-dedup with DartMinHash signatures.

Every word shingle of a text is a weighted element: weight w is a region of w unit cells. Darts fall on the cells by a Poisson
process that the element's hash alone decides, so equal elements get equal darts in every document. A dart has a coordinate and
a rank; each coordinate keeps its earliest dart. Ranks are thrown in unit steps up to a bound that fills all coordinates (about
k ln k darts a document however many elements it has), further for the few documents that need it. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

1. One pass gives each document a fingerprint of its elements, band keys and a short signature. Equal fingerprints are copies;
   the least doc_id stands for them from here on.
2. Representatives with a band key in common meet in buckets. In a few rounds each bucket's leader (another one each round) is
   paired with the members that are not yet of its class. Pairs are checked by signature, then exactly by their shingles, and
   classes are joined. A bucket of n near copies costs about n pairs a round, not n squared.
3. What stays apart in a bucket after the rounds is compared in full, in blocks: the members outside the bucket's largest class
   with all members of other classes. A block holds a bounded number of members with their shingles; a row is two blocks, whose
   exact similarities are one matrix product, and only links that join classes leave it. So every pair that shares a bucket is
   compared or already of one class, and no row is made for a pair.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^6)^32 = 6e-5, and less above. The signature check drops a
pair at 0.8 with probability below 1e-9; the blocks drop none.

Defined cases: a null text, or one without words, is a class of its own; a text of fewer words than a shingle is one shingle;
words are split at white space and A-Z lower-cased; an element's weight is the number of times that the text has it, or 1 with
weighted=False; rows with the same doc_id are one document, for which any of their texts may stand if they differ; a null doc_id
has a null class and its rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, free_name, slices, stored, table, text_bytes

BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Rounds of leaders before the rest of a bucket is compared in full.
ROUNDS = 3
#: Members of a block and bytes of their shingles, about, and the shingles that a matrix product takes at a time.
BLOCK_MEMBERS, BLOCK_BYTES, BLOCK_COLUMNS = 256, 2 << 20, 1 << 14
#: Words that a worker remembers the hashes of.
REMEMBERED = 500_000
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Darts of a unit cell by 16 bits of its hash: a Poisson law of mean 1.
DARTS = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod(np.maximum(1, np.arange(12)), dtype=float)), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)
NEVER = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Hashes()


def shingles(raw: bytes, size: int = 5) -> np.ndarray:
    """Hashes of the word shingles in order; one of all words if there are fewer than size, none without words."""
    words = raw.lower().split()
    if len(_words) > REMEMBERED:
        _words.clear()
    h = np.array([_words[w] for w in words], np.uint64)
    n = max(min(len(h), 1), len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = (out ^ h[i : i + n]) * GOLD + (out >> np.uint64(29))
    return mixed(out)


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate: a row for each document, elements being unit cells with their document."""
    out = np.full(n_docs * k, NEVER, np.uint64)
    weight = np.bincount(owner, minlength=n_docs)
    low = np.zeros(n_docs, np.int64)
    high = np.ceil(k * (np.log(k) + 4) / np.maximum(weight, 1)).astype(np.int64)
    todo = weight > 0
    with np.errstate(over="ignore"):
        while todo.any():
            pick = todo[owner]
            e, d = elements[pick], owner[pick]
            steps = (high - low)[d]
            cell = np.repeat(np.arange(len(e)), steps)
            rank = np.arange(len(cell)) - np.repeat(np.cumsum(steps) - steps, steps) + low[d][cell]
            h = mixed(e[cell] + (rank + 1).astype(np.uint64) * GOLD)
            n = DARTS[(h & np.uint64(65535)).astype(np.int64)]
            dart = np.repeat(np.arange(len(h)), n)
            nth = np.arange(len(dart)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            fall = mixed(h[dart] + (nth + 1).astype(np.uint64) * MIX2)
            value = (rank[dart].astype(np.uint64) << np.uint64(44)) | (fall >> np.uint64(20))
            np.minimum.at(out, d[cell[dart]] * k + ((fall & np.uint64(0xFFFFF)) % np.uint64(k)).astype(np.int64), value)
            low, high = high, high * 2
            todo &= (out.reshape(n_docs, k) == NEVER).any(axis=1)
    return out.reshape(n_docs, k)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each document and band."""
    bands = signatures.reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * MIX1, bands.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mixed(key * GOLD + bands[:, :, i])
    return key


def signature_table(docs: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(doc_id, print, bands, short): of each document with words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw", 1 << 20):
            ids, prints, cells = [], [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
                own, counts = np.unique(shingles(raw, words), return_counts=True)
                if len(own):
                    if weighted:
                        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        own = np.unique(mixed(np.repeat(own, counts) + nth.astype(np.uint64) * MIX1))
                    ids.append(doc)
                    cells.append(own)
                    prints.append(xxhash.xxh3_128_digest(own.tobytes()))
            if ids:
                with np.errstate(over="ignore"):
                    s = dart_signatures(np.concatenate(cells), np.repeat(np.arange(len(ids)), [len(c) for c in cells]), len(ids))
                    keys = band_keys(s)
                    short = (mixed(s) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "print": pa.array(prints, pa.binary()),
                        "bands": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                        "short": pa.array([x.tobytes() for x in short], pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).mapInArrow(sign, "doc_id long, print binary, bands array<long>, short binary")


def shingle_table(docs: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(id, cells): the sorted unit cells of each document as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "raw"):
                cells = []
                for raw in batch.column("raw").to_pylist():
                    own, counts = np.unique(shingles(raw, words), return_counts=True)
                    if weighted:
                        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        own = np.unique(mixed(np.repeat(own, counts) + nth.astype(np.uint64) * MIX1))
                    cells.append(own.tobytes())
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cells": pa.array(cells, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("raw")).mapInArrow(cut, "id long, cells binary")


def agreeing(pairs: DataFrame, shorts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose short signatures do not rule the threshold out."""
    least = int((threshold - 0.18) * COORDINATES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("x", "y"))
                yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    x, y = (shorts.select(F.col("id").alias(i), F.col("short").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def similar(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least that exact similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                small, large = sorted((len(x), len(y)))
                both = 0
                if small >= threshold * large:
                    z = np.concatenate((x, y))
                    z.sort(kind="stable")
                    both = int((z[1:] == z[:-1]).sum())
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    x, y = (cells.select(F.col("id").alias(i), F.col("cells").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def bucket_blocks(held: DataFrame, shorts: DataFrame, cells: DataFrame, total: int) -> DataFrame:
    """(key, outside, block, others, mains, m): the members of each bucket of more than two members and one class, in blocks.

    held: (key, id, class). outside: not of the bucket's largest class. m: array<struct<id, class, bands, cells>>. others and mains: into how
    many blocks the bucket's members outside its largest class and those of it are dealt.
    """
    sized = held.join(cells.select("id", F.length("cells").cast("long").alias("b")), "id")
    most = sized.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("b").alias("b")).groupBy("key")
    most = most.agg(F.max(F.struct("n", "class", "b")).alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("classes")).filter("classes > 1 and n > 2")
    outside = F.col("class") != F.col("main.class")

    def blocks(members: Column, size: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(size / BLOCK_BYTES), F.lit(1))

    most = most.withColumns(
        {
            "all": F.col("n"),
            "others": blocks(F.col("n") - F.col("main.n"), F.col("b") - F.col("main.b")),
            "mains": blocks(F.col("main.n"), F.col("main.b")),
        }
    )
    number = F.when(outside, F.col("others")).otherwise(F.col("mains"))
    block = F.pmod(F.xxhash64("id", F.lit(97)), number).alias("block")
    known = by_group(held, stored(most, "most"), "key", total).withColumnRenamed("all", "n")
    dealt = known.select("key", "id", "class", outside.alias("outside"), block, "others", "mains")
    full = dealt.join(shorts.select("id", "bands"), "id").join(cells, "id")
    return full.groupBy("key", "outside", "block", "others", "mains").agg(F.collect_list(F.struct("id", "class", "bands", "cells")).alias("m"))


def shared_cells(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each of x shares with each of y, all of them sorted without repeats."""
    out = np.zeros((len(x), len(y)), np.float32)
    columns = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)

    def held(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        found = np.zeros((len(sets), len(part)), np.float32)
        for row, own in zip(found, sets):
            own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
            at = np.searchsorted(part, own)
            row[at[part[at] == own]] = 1
        return found

    for i in range(0, len(columns), BLOCK_COLUMNS):
        part = columns[i : i + BLOCK_COLUMNS]
        out += held(x, part) @ held(y, part).T
    return out


def block_links(held: DataFrame, shorts: DataFrame, cells: DataFrame, threshold: float, total: int) -> DataFrame:
    """(a, b): links at that exact similarity which join the classes of each bucket. held: (key, id, class), total rows.

    A pair is compared in the first bucket that it shares. Of two blocks, links that others already imply are left out.
    """
    blocks = stored(bucket_blocks(held, shorts, cells, total), "blocks")

    def members(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        ids, classes = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "class"))
        return ids, classes, rows.field("bands").flatten().to_numpy().reshape(len(ids), -1), [np.frombuffer(c, np.uint64) for c in rows.field("cells").to_pylist()]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                key = batch.column("key")[i].as_py()
                (ids, classes, bands, own), (ids2, classes2, bands2, own2) = (members(batch.column(c)[i].values) for c in ("m", "m2"))
                todo = classes[:, None] != classes2
                if batch.column("same")[i].as_py():
                    todo &= ids[:, None] < ids2
                for n in range(int((bands[0] == key).argmax())):  # a key has its band's number in it, so all hold it at one place
                    todo &= bands[:, n][:, None] != bands2[:, n]
                rows, columns = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
                if not len(rows):
                    continue
                x, y = [own[r] for r in rows], [own2[c] for c in columns]
                both = shared_cells(x, y)
                total = np.array([len(c) for c in x])[:, None] + np.array([len(c) for c in y])
                hits = np.argwhere((both >= threshold * (total - both) - 1e-6) & todo[np.ix_(rows, columns)])
                root: dict[int, int] = {}

                def top(c: int, root: dict[int, int] = root) -> int:
                    while root.get(c, c) != c:
                        root[c] = root.get(root[c], root[c])
                        c = root[c]
                    return c

                for r, c in hits:
                    p, q = top(int(classes[rows[r]])), top(int(classes2[columns[c]]))
                    if p != q:
                        root[p] = q
                        ends.append((int(ids[rows[r]]), int(ids2[columns[c]])))
            if ends:
                yield pa.RecordBatch.from_pydict({"a": pa.array([min(e) for e in ends], pa.int64()), "b": pa.array([max(e) for e in ends], pa.int64())})

    # either side of a bucket is dealt to about as many groups as a group has blocks, and two groups meet under a key of their own
    rows, columns = F.floor(F.sqrt("others")), F.floor(F.sqrt(F.col("others") + F.col("mains")))
    each = F.when(F.col("outside"), F.col("block")).otherwise(F.col("others") + F.col("block"))
    left = blocks.filter("outside").select("key", F.pmod("block", rows).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)).alias("q"), F.col("block").alias("_block"), "m")
    right = blocks.select("key", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("p"), F.pmod(each, columns).alias("q"), "outside", "block", F.col("m").alias("m2"))
    met = left.join(right, ["key", "p", "q"]).filter(~F.col("outside") | (F.col("_block") <= F.col("block")))
    return met.select("key", "m", "m2", (F.col("outside") & (F.col("_block") == F.col("block"))).alias("same")).mapInArrow(link, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the least id that each node of the undirected edges (a, b) is joined to.

    Every round links each node to the least class among its neighbours', takes its whole class along, and then jumps along the links;
    the number of rounds is about the logarithm of the longest path. Nodes with many edges and large classes fill no task.
    """
    links = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = stored(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class"), F.count("*").alias("n")), "labels")
    total = links.count()
    while True:
        near = by_group(links, label.withColumnRenamed("id", "b"), "b", total).groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        lower = stored(label.join(near, "id").select("id", "class", "n", F.least("class", "near").alias("to")), "labels")
        moved = stored(lower.groupBy("class").agg(F.min("to").alias("root"), F.count("*").alias("n")).filter("root < class"), "moved")
        if not moved.head(1):
            return label.select("id", "class")
        heads = moved.groupBy(F.col("root").alias("at")).agg(F.count("*").alias("n"))
        further = moved.select(F.col("class").alias("at"), F.col("root").alias("further")).join(heads, "at")
        jumped = stored(by_group(moved.withColumn("at", F.col("root")), further, "at", total, "left").select("class", F.least("root", "further").alias("root"), "n"), "moved")
        # n of a node goes under another name while its class has one of its own
        named = lower.select("id", "class", F.col("n").alias("degree"))
        label = stored(by_group(named, jumped, "class", total, "left").select("id", F.coalesce("root", "class").alias("class"), F.col("degree").alias("n")), "labels")


def joined_classes(label: DataFrame, found: DataFrame) -> DataFrame:
    """label (id, class) after the links found (a, b) have joined classes; a node without a class is its own."""
    a, b = (label.select(F.col("id").alias(c), F.col("class").alias(f"_{c}")) for c in ("a", "b"))
    linked = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moves = components(linked.filter("a <> b").distinct()).select(F.col("id").alias("class"), F.col("class").alias("root"))
    met = found.select(F.col("a").alias("id")).union(found.select("b")).distinct().join(label, "id", "left_anti")
    nodes = stored(label.select("id", "class").union(met.select("id", F.col("id").alias("class"))), "labels")
    groups = nodes.groupBy("class").agg(F.count("*").alias("n")).join(moves, "class")
    return stored(by_group(nodes, groups, "class", nodes.count(), "left").select("id", F.coalesce("root", "class").alias("class")), "labels")


def near_duplicate_classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, weighted: bool = True) -> DataFrame:
    """(doc_id, class_id): one row for each doc_id, class_id the least doc_id of its class."""
    spark = docs.sparkSession
    known_ids = docs.filter(F.col("doc_id").isNotNull())
    signs = stored(signature_table(known_ids, words, weighted), "signatures")
    copies = stored(signs.groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).filter("n > 1"), "copies")
    each = by_group(signs.select("doc_id", "print"), copies, "print", signs.count(), "left")
    member = stored(each.groupBy("doc_id").agg(F.min(F.coalesce("id", "doc_id")).alias("id")), "members")
    first = member.filter(F.col("doc_id") == F.col("id")).select("id")
    reps = signs.join(first, signs.doc_id == first.id).dropDuplicates(["id"])
    spread = reps.select("id", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(spread.join(shared, "key").select("key", "id"), "buckets")
    total = buckets.count()
    met = buckets.select("id").distinct()
    shorts = stored(reps.join(met, "id", "left_semi").select("id", "short", "bands"), "shorts")
    candidates = known_ids.withColumn("_id", F.col("doc_id").cast("long")).join(met.withColumnRenamed("id", "_id"), "_id", "left_semi").dropDuplicates(["_id"])
    cells = stored(shingle_table(candidates, words, weighted), "shingles")

    tried = spark.createDataFrame([], "a long, b long")
    label = spark.createDataFrame([], "id long, class long")
    for turn in range(ROUNDS + 1):
        known = label.withColumnRenamed("class", "_class")
        held = buckets.join(known, "id", "left").select("key", "id", F.coalesce("_class", "id").alias("class"))
        order = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        ends = held.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "class")).alias("lead"), F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).filter("low <> high")
        if turn < ROUNDS:
            led = by_group(held, stored(ends.select("key", "lead", "n"), "ends"), "key", total)
            pairs = led.filter(F.col("class") != F.col("lead.class")).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
        else:
            found = stored(block_links(held, shorts, cells, threshold, total), "edges")
            if found.head(1):
                label = joined_classes(label, found)
            break
        new = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if not new.head(1):
            if turn:
                continue
            break
        found = stored(similar(agreeing(new, shorts, threshold), cells, threshold), "edges")
        tried = tried.union(new)
        if found.head(1):
            label = joined_classes(label, found)
    # a representative is the least doc_id of its copies, so the least representative is the least doc_id of the class
    joined = member.join(label, "id", "left").select("doc_id", F.coalesce("class", "id").alias("class_id"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(joined, "doc_id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document, the least doc_id, of each class of near duplicates; rows without a doc_id stay."""
    other = free_name(docs, "_gone")
    classes = near_duplicate_classes(docs.select("doc_id", "text"), words, threshold)
    gone = classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(other))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(other), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
SQL: dict[str, str] = {}
