"""Merkle dataset manifest: a postorder append log of node digests, and proofs read from it by closed-form positions.

A row's leaf is the SHA-256 of its fields, computed by DataFrame functions next to the text; only digests and ids go further. Leaves
are ranked within their tree (one a language) by a range partition: each partition numbers its own sorted rows, and a small table
of partition counts gives what stands before them, so that no language, however large, is sorted in one task.

Trees are built in tiers. A block is an aligned run of 2 ** LEVELS leaves; its builder writes the block's nodes in completion order,
a node right after the last leaf below it, as one segment of the log. The blocks' last digests are the leaves of the next tier, until
one block is left; the trees' roots then are the leaves of one more tree. A node of level k over leaf m and those before it, within
its tree or its segment, is the (2 m - popcount(m) + k)-th digest of the postorder: subtree sizes give the place, so no index is kept.

Proofs are read from the top tier down: a segment joined to the path of its own root gives every leaf's siblings by their positions,
and passes the paths on to the tier below. A row meets one segment; work and shuffle are linear in the rows.

Defined cases: null fields are hashed as `-`; a null language is a tree of its own and comes first; rows without a doc_id come first
in their tree and are not tampered with; rows with the same doc_id in a language follow each other by leaf digest (equal rows have
equal leaves and a proof each); long texts are hashed whole; an empty table gives an empty table; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Levels of a block: 256 leaves, 511 digests of 32 bytes in a segment.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of the table of partition counts up to which it is broadcast (about 6 MB); it is joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
#: Every seventh row by the hash of its id is tampered with in the query.
TAMPERED = 7
#: A path has an entry a level: the sibling and whether it is the left one, or ALONE.
PATH = "array<struct<digest:binary,left:boolean>>"
PATH_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("left", pa.bool_())]))
ALONE = {"digest": None, "left": False}


def encoded(value: Column) -> Column:
    """A field as it enters a leaf: `-`, or its length in bytes and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


def tampered_leaf() -> Column:
    """The leaf with n_chars one higher, where the id's hash says so; else null. Decimals, since the largest long has no next one."""
    other = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, leaf(other))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, other): a slim row for each document, with its leaf and its tampered one."""
    return docs.select(F.col("lang").alias("tree"), "doc_id", leaf([F.col(c) for c in FIELDS]).alias("digest"), tampered_leaf().alias("other"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, the rank within the tree from 0, and n, the tree's rows. Ties are told apart by place, so equal rows split too."""
    placed = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    by = ["tree", *order, "salt"]
    at = stored(placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt").withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", 33)
    counts = at.groupBy(part.alias("part"), F.col("tree").alias("of")).agg(F.count("*").alias("c"), F.min("at").alias("low"))
    tree = Window.partitionBy("of")
    before = F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    counts = stored(counts.select("part", "of", (before - F.col("low")).alias("shift"), F.sum("c").over(tree).alias("n")), "merkle-counts")
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    joined = at.join(counts, (part == F.col("part")) & F.col("tree").eqNullSafe(F.col("of")))
    return joined.withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "of", "shift")


def position(level: int, i: int, n: int) -> int:
    """The place, from 0, of node i of a level in the postorder of a tree of n leaves."""
    last = min((i + 1) << level, n) - 1
    return 2 * last - last.bit_count() + level


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def append_nodes(digests: list[bytes], levels: int) -> bytes:
    """The digests of an aligned block in completion order. Nodes that wait for a sibling are kept on a stack, one a level at most."""
    log, waiting, end = [], [], len(digests) - 1
    for j, digest in enumerate(digests):
        log.append(digest)
        waiting.append(digest)
        for level in range(1, levels + 1):
            if (j + 1) & ((1 << level) - 1) and j != end:
                break
            # node j >> level of this level is complete; it has one child where its run was the last, of one
            both = ((j >> (level - 1)) & 1) == 1
            right = waiting.pop()
            digest = hashlib.sha256((waiting.pop().hex() if both else "").encode() + right.hex().encode()).digest()
            log.append(digest)
            waiting.append(digest)
    return b"".join(log)


def siblings(log: bytes, j: int, m: int, levels: int) -> list[dict]:
    """What stands beside leaf j's path in a segment of m leaves, level by level; ALONE where a run has one node."""
    out = []
    for level in range(levels):
        beside = (j >> level) ^ 1
        if beside << level < m:
            at = position(level, beside, m) * 32
            out.append({"digest": log[at : at + 32], "left": beside < j >> level})
        else:
            out.append(ALONE)
    return out


def write_segments(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        logs = [append_nodes([x["digest"] for x in block], min(levels, height(n))) for block, n in zip(batch.column("leaves").to_pylist(), batch.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.binary())], names=[*batch.schema.names, "log"])


def tiers(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The log's segments tier by tier, (tree, block, n, leaves, log), and (tree, digest) of the roots.

    nodes: (tree, i, n, digest, and what a leaf carries). leaves: array<struct<i, ...>> of a block, by rank.
    """
    out = []
    while True:
        carried = [c for c in nodes.columns if c not in ("tree", "n", "i")]
        blocks = nodes.groupBy("tree", F.shiftright("i", levels).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", *carried))).alias("leaves"))
        schema = blocks.schema.simpleString()[7:-1] + ",log:binary"
        out.append(stored(blocks.mapInArrow(lambda b: write_segments(b, levels), schema), "merkle-log"))
        top = out[-1].select("tree", F.col("block").alias("i"), "n", F.expr("substring(log, -32)").alias("digest"))
        if not out[-1].filter(F.col("n") > 1 << levels).head(1):
            return out, top.select("tree", "digest")
        # trees of one block are done; they go up as they are, which adds no node
        nodes = top.withColumn("n", F.shiftright(F.col("n") - 1, levels) + 1)


def read_proofs(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of each segment: (tree, leaf, path, root), the path up to the top and the top's digest."""
    for batch in batches:
        for row in batch.to_pylist():
            m, up = len(row["leaves"]), min(levels, height(row["n"]))
            paths = [siblings(row["log"], j, m, up) + row["path"] for j in range(m)]
            fields = [
                pa.array([row["tree"]] * m, pa.string()),
                pa.array(row["leaves"], batch.schema.field("leaves").type.value_type),
                pa.array(paths, PATH_TYPE),
                pa.array([row["tree_root"]] * m, pa.binary()),
                pa.array([row["root"]] * m, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(fields, names=["tree", "leaf", "path", "tree_root", "root"])


def extract(segments: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(leaf, path, tree_root, root) of every leaf of the lowest tier. above: (tree, path, tree_root, root), a row a tree."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(segments):
        own = above.withColumnsRenamed({"tree": "_tree", "block": "_block"})
        met = tier.join(own, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")
        kind = tier.schema["leaves"].dataType.elementType.simpleString()
        found = met.mapInArrow(lambda b: read_proofs(b, levels), f"tree string, leaf {kind}, path {PATH}, tree_root binary, root binary")
        above = found.select("tree", F.col("leaf.i").alias("block"), "path", "tree_root", "root") if tier is not segments[0] else found
    return above


def manifest(docs: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The log of all trees, the log of the tree over them, and (tree, digest) of its root (no row for no documents)."""
    below, roots = tiers(ranked(leaves(docs), ["doc_id", "digest"]), levels)
    order = roots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest")
    over, root = tiers(ranked(order, ["name"]), levels)
    return below, over, root


def log_entries(segments: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, position, level, digest): the append log of each tree, every node at its place in the tree's postorder."""

    def numbered(batches: Iterator[pa.RecordBatch], tier: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                m, n, first, below = len(row["leaves"]), row["total"], row["block"] << levels, tier * levels
                for level in range(tier > 0, min(levels, height(row["n"])) + 1):
                    for k in range((m - 1 >> level) + 1):
                        at = position(level, k, m) * 32
                        rows.append((row["tree"], position(level + below, (first >> level) + k, n), level + below, row["log"][at : at + 32].hex()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["tree", "position", "level", "digest"])

    totals = segments[0].groupBy("tree").agg(F.first("n").alias("total")).withColumnRenamed("tree", "_tree")
    out = None
    for tier, rows in enumerate(segments):
        # a tree of one block is carried through the higher tiers without a node of its own
        met = rows.join(totals, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        own = met.mapInArrow(lambda b, t=tier: numbered(b, t), "tree string, position long, level int, digest string")
        out = own if out is None else out.union(own)
    return out


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, other, path, subroot, root) of every document: binary digests, and siblings from the leaf to the root."""
    below, over, root = manifest(docs, levels)
    top = root.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("tree_root"), F.col("digest").alias("root"))
    above = extract(over, top, levels).select(F.col("leaf.name").alias("tree"), "path", F.col("leaf.digest").alias("tree_root"), "root")
    found = extract(below, above, levels)
    return found.select("leaf.doc_id", F.col("leaf.digest").alias("leaf"), F.col("leaf.other").alias("other"), "path", F.col("tree_root").alias("subroot"), "root")


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(start: Column, path: Column) -> Column:
    """The root, as text, that a leaf's text and its path give."""
    step = lambda acc, x: F.sha2(F.when(x["digest"].isNull(), acc).when(x["left"], F.concat(text_of(x["digest"]), acc)).otherwise(F.concat(acc, text_of(x["digest"]))), 256)
    return F.aggregate(path, start, step)


def checked(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each document's leaf, roots and proof as text, and whether the leaf, tampered with where tampered_leaf() says, folds to the root."""
    found = proofs(docs, levels)
    proof = F.sha2(F.array_join(F.transform(F.filter("path", lambda x: x["digest"].isNotNull()), lambda x: text_of(x["digest"])), ""), 256)
    root = text_of(F.col("root"))
    folded = found.select(
        "doc_id",
        text_of(F.col("leaf")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        proof.alias("proof_sha256"),
        fold(text_of(F.coalesce("other", "leaf")), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "documents"))


#: CRC-32 of a text in SQL: the table of 256 remainders by its rule, then a step a byte.
CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"


def crc32_sql(text: str, remainders: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a text's UTF-8 bytes; remainders: an expression for CRC_TABLE."""
    octets = f"list_transform(range(strlen({text})), lambda octet: ('0x' || substr(hex({text}), 2 * octet + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, {remainders}[(xor(c, b) & 255) + 1])), 4294967295)"


def _encoded_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


OP12_SQL = f"""
with recursive crc as (select {CRC_TABLE} as t),
leaves as (
  select row_number() over () as row_id, lang, doc_id, leaf, case when {crc32_sql("doc_id::varchar", "t")} % {TAMPERED} = 0 then other end as other
  from (select *, sha256({" || ".join(map(_encoded_sql, FIELDS))}) as leaf,
               sha256({" || ".join(_encoded_sql("(n_chars::hugeint + 1)" if c == "n_chars" else c) for c in FIELDS)}) as other from documents), crc),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, row_id) - 1 as i, count(*) over (partition by lang) as n from leaves),
tree as (
  select lang, 0 as k, i, n, leaf as h from placed
  union all
  select lang, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by lang, k, i // 2, n),
subroots as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1),
over_tree as (
  select 0 as k, i, n, subroot as h from subroots
  union all
  select k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from over_tree where n > 1 group by k, i // 2, n),
steps as (
  select p.row_id, 0 as part, a.k, t.h, t.i < (p.i >> a.k) as is_left
  from placed p join (select distinct lang, k, n as m from tree) a on p.lang is not distinct from a.lang and a.m > 1
       left join tree t on t.lang is not distinct from p.lang and t.k = a.k and t.i = xor(p.i >> a.k, 1)
  union all
  select p.row_id, 1, a.k, t.h, t.i < (s.i >> a.k)
  from placed p join subroots s on p.lang is not distinct from s.lang join (select distinct k, n as m from over_tree) a on a.m > 1
       left join over_tree t on t.k = a.k and t.i = xor(s.i >> a.k, 1)),
paths as (
  select row_id, list({{'h': h, 'l': is_left}} order by part, k) as path from steps group by row_id),
folds as (
  select p.*, s.subroot, coalesce(q.path, []) as path, 1 as depth, coalesce(p.other, p.leaf) as folded
  from placed p join subroots s on p.lang is not distinct from s.lang left join paths q using (row_id)
  union all
  select * exclude (depth, folded), depth + 1,
         sha256(case when path[depth].h is null then folded when path[depth].l then path[depth].h || folded else folded || path[depth].h end)
  from folds where depth <= len(path))
select doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(list_transform(path, lambda x: x.h), lambda x: x is not null), '')) as proof_sha256,
       folded as folded_root, folded = root as verified
from folds, (select h as root from over_tree where n = 1) r
where depth = len(path) + 1
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {"op12_merkle_manifest": OP12_SQL}
