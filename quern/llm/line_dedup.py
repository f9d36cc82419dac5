"""Line dedup: two Bloom filters for once-seen and twice-seen hashes; only suspected repeats shuffle.

1. Every task hashes the keys of its documents' lines to filter positions and sends those, by filter chunk, to the task that
   keeps the chunk. A position that one document sets is in the once filter, one that two set is in the twice filter as well.
2. Tasks probe their lines against the twice filter. A key that it lacks is in one document only; the others are suspects.
3. Suspects alone are shuffled, counted exactly by their whole text, and the largest doc_id of each repeated key chosen.
4. The lines that a document loses are joined to it by doc_id, and its text is written without them.

The twice filter is the only broadcast. Its size follows the input, and while it has at most max_bits it is broadcast. Beyond
that the filters stay in shards of SHARD_BITS by hash: a lot of documents sends each shard its hashes, once a lot with the first
document that has it, and gets the twice-seen ones back; a hash that two documents of one lot have needs no answer. Documents then
give the lines of their suspected hashes. Either way the filter only decides what is confirmed, never another result.

Defined cases: a null or empty text is one empty line; keys shorter than min_chars code points never count; a key that one
document repeats counts once for it, and rows with the same doc_id count as one document; a null doc_id counts for no document
and its rows lose no line; an empty table gives an empty table; further columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, free_name, slices, stored, table, text_bytes

BLANKS = b" \t\n\x0b\x0c\r"
#: Positions of a key, bits of a chunk of the filters, and the smallest filter and the largest that is broadcast (128 MB).
PROBES, CHUNK_BITS, MIN_BITS, MAX_BITS = 3, 1 << 20, 1 << 20, 1 << 30
#: Bits of a shard's filters, which a task holds whole.
SHARD_BITS = 1 << 22
#: Keys that a task gathers before it sends their positions on.
FLUSH_KEYS = 200_000
#: Bytes of lost lines that a partition may hold, about, for them to meet their documents in a hash table.
HASH_BYTES = 32 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars)


def document_keys(raw: bytes, chars: int) -> set[bytes]:
    """The keys of a text's lines that can count."""
    return {k for k in map(line_key, raw.split(b"\n")) if long_enough(k, chars)}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES filter positions of each 64-bit hash, one row a hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def hashed(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def filter_bits(text_bytes_seen: int) -> int:
    """About a bit for each eight bytes of text: a power of two from MIN_BITS."""
    return max(MIN_BITS, 1 << (max(1, text_bytes_seen // 8) - 1).bit_length())


def twice_filter(docs: DataFrame, bits: int, chars: int) -> np.ndarray:
    """The twice-seen filter over all documents, as packed bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            seen, counts = np.unique(positions(np.concatenate(parts), bits).ravel(), return_counts=True)
            chunk = (seen // CHUNK_BITS).astype(np.int32)
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            at = (seen % CHUNK_BITS).astype(np.uint32)
            again = counts > 1
            starts = np.concatenate(([0], cuts))
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(chunk[starts], pa.int32()),
                    "once": pa.array([x.tobytes() for x in np.split(at, cuts)], pa.binary()),
                    "twice": pa.array([x[y].tobytes() for x, y in zip(np.split(at, cuts), np.split(again, cuts))], pa.binary()),
                }
            )

        parts, held = [], 0
        for batch in slices(batches, "raw"):
            for raw in batch.column("raw").to_pylist():
                if keys := document_keys(raw, chars):
                    parts.append(hashed(keys))
                    held += len(keys)
            if held >= FLUSH_KEYS:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                o, t = kept.setdefault(chunk, (np.zeros(CHUNK_BITS, bool), np.zeros(CHUNK_BITS, bool)))
                at = np.frombuffer(once, np.uint32)
                t[at] |= o[at]
                o[at] = True
                t[np.frombuffer(twice, np.uint32)] = True
        for chunk, (_, t) in kept.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "bits": pa.array([np.packbits(t).tobytes()], pa.binary())})

    parts = docs.select(text_bytes().alias("raw")).mapInArrow(send, "chunk int, once binary, twice binary")
    merged = parts.repartition(max(1, min(bits // CHUNK_BITS, 64)), "chunk").mapInArrow(merge, "chunk int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most bits / 8 bytes in all
        out[row.chunk * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def suspects(docs: DataFrame, bits: int, chars: int) -> DataFrame:
    """(doc_id, key) of each line key that the twice filter holds, once a document."""
    held = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, chars))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = held.value
        for batch in slices(batches, "raw"):
            keys, owners = [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
                own = document_keys(raw, chars)
                keys += own
                owners += [doc] * len(own)
            if keys:
                at = positions(hashed(keys), bits)
                hit = ((seen[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([owners[i] for i in np.flatnonzero(hit)], pa.int64()), "key": pa.array([keys[i] for i in np.flatnonzero(hit)], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).mapInArrow(probe, "doc_id long, key binary")


def sharded_suspects(docs: DataFrame, shards: int, chars: int) -> DataFrame:
    """What suspects() gives, with filters in shards by hash and no broadcast."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, parts, lot):
            hashes, owners = np.concatenate(parts), np.repeat(np.array(ids, np.int64), [len(p) for p in parts])
            own, first, at, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            again = counts[at] > 1
            shard = ((own >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(shard[order]) > 0))
            rows = [(int(shard[x[0]]), False, owners[first[x]].tobytes(), own[x].tobytes(), (counts[x] > 1).tobytes()) for x in np.split(order, starts[1:])]
            rows.append((lot % shards, True, owners[again].tobytes(), hashes[again].tobytes(), b""))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("shard", pa.int64()), ("known", pa.bool_()), ("docs", pa.binary()), ("hashes", pa.binary()), ("twice", pa.binary())))})

        ids, parts, held, lot = [], [], 0, TaskContext.get().partitionId()
        for batch in slices(batches, "raw"):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
                if keys := document_keys(raw, chars):
                    ids.append(doc)
                    parts.append(hashed(keys))
                    held += len(keys)
            if held >= FLUSH_KEYS:
                yield from flush(ids, parts, lot)
                ids, parts, held, lot = [], [], 0, lot + 1
        if held:
            yield from flush(ids, parts, lot)

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        known, asked = pdf[pdf["known"]], pdf[~pdf["known"]]
        docs, hashes = [np.frombuffer(b"".join(known["docs"]), np.int64)], [np.frombuffer(b"".join(known["hashes"]), np.uint64)]
        if len(asked):
            d, h, t = (np.frombuffer(b"".join(asked[c]), kind) for c, kind in (("docs", np.int64), ("hashes", np.uint64), ("twice", bool)))
            at = positions(h, SHARD_BITS)
            once, twice = np.zeros(SHARD_BITS, bool), np.bincount(at.ravel().astype(np.int64), minlength=SHARD_BITS) > 1
            once[at[t].ravel()] = True  # two documents of one lot
            twice |= once
            hit = twice[at].all(axis=1) & ~t
            docs.append(d[hit])
            hashes.append(h[hit])
        return pd.DataFrame({"doc_id": np.concatenate(docs), "hash": np.concatenate(hashes).view(np.int64)})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw"):
            ids, keys = [], []
            for doc, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "hashes"))):
                own = list(document_keys(raw, chars))
                hit = np.isin(hashed(own).view(np.int64), np.array(wanted, np.int64))
                keys += [own[i] for i in np.flatnonzero(hit)]
                ids += [doc] * int(hit.sum())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).filter(F.col("doc_id").isNotNull())
    sent = texts.mapInArrow(send, "shard long, known boolean, docs binary, hashes binary, twice binary")
    found = sent.repartition(shards, "shard").groupBy("shard").applyInPandas(probe, "doc_id long, hash long")
    asked = found.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))  # a document's own lines
    return texts.join(asked, "doc_id").mapInArrow(lines, "doc_id long, key binary")


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """(doc_id, drop): the keys whose lines that document loses; documents that lose none are absent. And a bound of its keys' bytes."""
    bits = filter_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    found = stored(suspects(docs, bits, min_chars) if bits <= max_bits else sharded_suspects(docs, max(4, bits // SHARD_BITS), min_chars), "line-suspects")
    counted = found.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keep"))
    repeated = stored(counted.filter(F.col("n") >= min_docs), "repeated-lines")
    total, size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    lost = by_group(found, repeated, "key", total).filter(F.col("doc_id") != F.col("keep")).select("doc_id", "key")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop")), size


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hashes_only: bool = False, max_bits: int = MAX_BITS) -> DataFrame:
    """All columns of docs with text rewritten, and n_lines and n_dropped (in place of columns so named); hashes_only: doc_id, the counts
    and kept_sha256."""
    doc, lost_keys = free_name(docs, "_doc"), free_name(docs, "_drop")
    drops, size = repeated_lines(docs, min_chars, min_docs, max_bits)
    drops = drops.select(F.col("doc_id").alias(doc), F.col("drop").alias(lost_keys))
    # a hash join leaves the texts unsorted; where a partition of the lost lines may be large, Spark sorts and spills instead
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drops = drops.hint("shuffle_hash" if size <= parts * HASH_BYTES else "merge")
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    taken = docs.select("doc_id", "text") if hashes_only else docs.select(*(F.col(f"`{c}`") for c in columns))
    joined = taken.join(drops, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc).withColumn("text", text_bytes())
    fields = [f for f in docs.schema.fields if f.name in (("doc_id",) if hashes_only else columns)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines long, n_dropped long" + ", kept_sha256 string" * hashes_only

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, before, lost = [], [], []
            for raw, drop in zip(batch.column("text").to_pylist(), batch.column(lost_keys).to_pylist()):
                lines = raw.split(b"\n")
                before.append(len(lines))
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if line_key(x) not in gone]
                    lost.append(len(lines) - len(kept))
                    raw = b"\n".join(kept)
                else:
                    lost.append(0)
                texts.append(hashlib.sha256(raw).hexdigest() if hashes_only else raw.decode("utf-8", "replace"))
            own = {f.name: batch.column(f.name) for f in fields if f.name != "text"}
            if hashes_only:
                own |= {"n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(lost, pa.int64()), "kept_sha256": pa.array(texts, pa.string())}
            else:
                own = {f.name: own.get(f.name, pa.array(texts, pa.string()) if f.name == "text" else None) for f in fields} | {"n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_pydict(own)

    return joined.mapInArrow(rewrite, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), hashes_only=True)


OP4_SQL = r"""
with lines as (
  select doc_id, line, ord, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as ord
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
repeated as (
  select key, max(doc_id) as keep from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select l.doc_id, l.line, l.ord, r.key is not null and l.doc_id <> r.keep as lost from lines l left join repeated r on l.key = r.key)
select doc_id, count(*) as n_lines, cast(sum(case when lost then 1 else 0 end) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by ord) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL = {"op4_line_dedup": OP4_SQL}
