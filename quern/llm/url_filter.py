"""URL filter: a sorted array of 64-bit digests, memory-mapped, probed by vectorised binary search, confirmed by whole strings.

A blocklist is a table of entries `host` or `host/path-prefix`, of any size. Spark sorts its xxhash64 digests by range: a shard is a
run of digests that share their first bits, of about SHARD_BYTES, and one file in the shared folder with the sorted digests, the
offsets and the strings of its entries in the same order. Tasks map the shards which their urls' digests fall in; neither they nor
the driver read the list. A url is probed by every suffix of its host and every directory prefix of its path, as far as the longest
entry goes; equal digests are confirmed against the stored string, so a collision never blocks a url. Urls are not shuffled.

Rules come before the method: the longest rule whose host is the url's or above it, and whose path starts the url's path.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule, and is allowed; an empty blocklist allows
everything that no rule blocks, and null and repeated entries count as none and one; urls of any length are probed in time that
grows with the longest entry; repeated rows give repeated rows; an empty table gives an empty table; columns of the table which are
named like one of the five added ones (in any case of letters) are replaced, all others pass through.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, slices, table, written

#: Host and path of a url.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Parts from which the default blocklist is built by rule: names of two parts in each domain, and folders named after a part.
FIRST = ("ads", "adult", "best", "casino", "cheap", "free", "hot", "online", "spam")
SECOND = ("bets", "casino", "farm", "loans", "pills", "track", "win", "x")
DOMAINS = ("com", "net", "org", "example.com", "example.net", "example.org")
#: Bytes of a shard, about; and the seed of Spark's xxhash64.
SHARD_BYTES, SEED = 16 << 20, 42
ADDED = ("host", "path", "rule", "verdict", "blocked")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest comes last and wins
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def probe_keys(host: bytes, path: bytes, longest: int) -> list[bytes]:
    """The entries of at most longest bytes that would block a url: each suffix of its host, alone and with each directory prefix of its path."""
    if not host:
        return []
    end = host[-longest:] if longest else b""
    hosts = [end[i + 1 :] for i, c in enumerate(end) if c == 46] + ([host] if len(host) <= longest else [])
    ends = [path[: i + 1] for i, c in enumerate(path[:longest]) if c == 47] + ([path] if path and len(path) <= longest and path[-1:] != b"/" else [])
    return hosts + [h + p for h in hosts for p in ends if len(h) + len(p) <= longest]


def digests(keys: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for binary values."""
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys)).view(np.int64)


def packed(own: np.ndarray, entries: list[bytes]) -> bytes:
    """A shard: its number of entries, their ascending digests, the offsets of their strings, and the strings."""
    offsets = np.concatenate(([0], np.cumsum([len(e) for e in entries], dtype=np.int64)))
    return b"".join((np.array([len(entries)], np.int64).tobytes(), own.astype(np.int64).tobytes(), offsets.astype(np.int64).tobytes(), *entries))


def write_shards(entries: DataFrame, folder: str, bits: int) -> list[int]:
    """One file in folder for each shard that has entries; their numbers."""
    ranged = entries.withColumn("digest", F.xxhash64("entry"))
    ranged = ranged.withColumn("shard", F.shiftrightunsigned("digest", 64 - bits).cast("int") if bits else F.lit(0))
    ranged = ranged.repartition(1 << bits, "shard").sortWithinPartitions("shard", "digest", "entry")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)

        def close(shard: int, runs: list[pa.RecordBatch]) -> int:
            own = pa.Table.from_batches(runs)
            name = f"{root}/{shard}"
            attempt = f"{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(attempt) as out:
                out.write(packed(own["digest"].to_numpy(), own["entry"].to_pylist()))
            files.move(attempt, name)  # attempts of one task write the same
            return shard

        shard, runs, done = -1, [], []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(starts, starts[1:]):
                if j > i and numbers[i] != shard:
                    done += [close(shard, runs)] if runs else []
                    shard, runs = int(numbers[i]), []
                if j > i:
                    runs.append(batch.slice(i, j - i))
        done += [close(shard, runs)] if runs else []
        yield pa.RecordBatch.from_pydict({"shard": pa.array(done, pa.int32())})

    return sorted({r.shard for r in ranged.mapInArrow(write, "shard int").collect()})  # one number for SHARD_BYTES of entries


class UrlIndex:
    """The shards of a list, each mapped by a task when it is first asked."""

    def __init__(self, folder: str, shards: list[int], bits: int, longest: int, shipped: bool = False):
        self.folder, self.shards, self.bits, self.longest, self.shipped, self.mapped = folder, set(shards), bits, longest, shipped, {}

    def shard(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if number not in self.mapped:
            path = SparkFiles.get(f"{os.path.basename(self.folder)}/{number}") if self.shipped else f"{pa.fs.FileSystem.from_uri(self.folder)[1]}/{number}"
            data = np.memmap(path, np.uint8, "r")
            at = 8 + 8 * int(data[:8].view(np.int64)[0])
            self.mapped[number] = data[8:at].view(np.int64), data[at : 2 * at].view(np.int64), data[2 * at :]
        return self.mapped[number]

    def contains(self, keys: list[bytes]) -> np.ndarray:
        found, own = np.zeros(len(keys), bool), digests(keys)
        numbers = (own.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        order = np.lexsort((own, numbers))
        for run in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
            if not len(run) or int(numbers[run[0]]) not in self.shards:
                continue
            stored, offsets, strings = self.shard(int(numbers[run[0]]))
            low, high = np.searchsorted(stored, own[run], "left"), np.searchsorted(stored, own[run], "right")
            for n in np.flatnonzero(high > low):  # digest matches alone are compared as strings
                found[run[n]] = any(strings[offsets[j] : offsets[j + 1]].tobytes() == keys[run[n]] for j in range(low[n], high[n]))
        return found


def build_index(blocklist: DataFrame, shard_bytes: int = SHARD_BYTES) -> UrlIndex:
    """The index of a table of entries, in the shared folder. Tasks map it there; where that folder is no file system of theirs, Spark's
    own file shipping brings the shards from it to each executor, which maps its copy."""
    spark = blocklist.sparkSession
    entries = blocklist.select(F.col("entry").cast("binary").alias("entry")).filter(F.col("entry").isNotNull())
    size, longest = entries.agg(F.coalesce(F.sum(F.octet_length("entry") + 16), F.lit(0)), F.coalesce(F.max(F.octet_length("entry")), F.lit(0))).first()
    bits = max(0, int(size) // shard_bytes).bit_length()
    folder = written(f"{shared_folder(spark)}/quern/url-index-{uuid.uuid4().hex}")
    index = UrlIndex(folder, write_shards(entries.distinct(), folder, bits) if longest else [], bits, longest)
    if index.shards and not isinstance(pa.fs.FileSystem.from_uri(folder)[0], pa.fs.LocalFileSystem):
        spark.sparkContext.addFile(folder, recursive=True)
        index.shipped = True
    return index


def default_blocklist(spark: SparkSession) -> DataFrame:
    """(entry): `first-second.domain` hosts and `domain/part/` folders; most of them occur in no table of pages."""
    listed = lambda values: F.explode(F.array(*map(F.lit, values)))
    domains = spark.range(1).select(listed(DOMAINS).alias("d"))
    hosts = domains.select("d", listed(FIRST).alias("a")).select("d", "a", listed(SECOND).alias("b")).select(F.concat("a", F.lit("-"), "b", F.lit("."), "d").alias("entry"))
    return hosts.union(domains.select("d", listed(sorted({*FIRST, *SECOND})).alias("p")).select(F.concat("d", F.lit("/"), "p", F.lit("/")).alias("entry")))


def filter_urls(pages: DataFrame, blocklist: DataFrame, rules=RULES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of pages, and host, path, rule, verdict and blocked (the method's own answer)."""
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    parsed = pages.select(*(F.col(f"`{c}`") for c in kept), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    index = build_index(blocklist, shard_bytes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "path", 1 << 20):
            hosts, paths = (pa.compute.cast(batch.column(c), pa.binary()).to_pylist() for c in ("host", "path"))
            keys = [probe_keys(h, p, index.longest) for h, p in zip(hosts, paths)]
            hit = index.contains([k for own in keys for k in own])
            ends = np.cumsum([len(own) for own in keys], dtype=np.int64)
            total = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], ends)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(total) > 0)], names=[*batch.schema.names, "blocked"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema.fields)
    judged = parsed.mapInArrow(probe, f"{schema}, blocked boolean")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), default_blocklist(spark)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = rf"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
domains as (select unnest({list(DOMAINS)}) as d),
blocked as (
  select a || '-' || b || '.' || d as host, '' as start from domains, (select unnest({list(FIRST)}) as a), (select unnest({list(SECOND)}) as b)
  union all select d, '/' || p || '/' from domains, (select unnest({sorted({*FIRST, *SECOND})}) as p)),
ruled as (
  select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                 when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                 when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                 when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from parts)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when exists (select 1 from blocked s where (r.host = s.host or ends_with(r.host, '.' || s.host)) and starts_with(r.path, s.start)) then 'block'
            else 'allow' end as verdict
from ruled r
"""

QUERIES = {"op1_url_filter": op1_url_filter}
SQL = {"op1_url_filter": OP1_SQL}
