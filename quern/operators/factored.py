"""The graph of documents that share entities, kept as classes instead of pairs.

Documents are alike to the graph if they hold the same shared forms with the same confidence and types, are early in the same forms, have
as many entities and the same relation words. Such documents are one class, named by its least doc_id: what links two of its members
to others is computed once. The graph is three tables, linear in the mentions: members (doc_id, class), classes with their forms and
size, and the classes of each form. Links between classes are made for the classes that a job asks for; document pairs only where a
caller asks for them.

Two documents are linked if they share a form. The newer one (higher doc_id) gives the strength and type of the link, so two classes
have a strength and a type for either order. A class of one document is not linked to itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .graph import RELATIONS, SEQUENCE, says, type_of
from .order import numbered
from .ranking import small_side
from .skew import join_groups

#: Classes of one form that a block of the join by form holds, about; documents of a form that are early.
BLOCK, EARLY = 256, 3
#: Members of a class in one array; an id above all others.
CHUNK, HIGHEST = 256, (1 << 63) - 1


@dataclass
class FactoredGraph:
    """members: (doc_id, class). classes: (class, size, n, sequence, relation, forms). forms: (canonical, class, confidence, types, early)."""

    members: DataFrame
    classes: DataFrame
    forms: DataFrame


def factor(entities: DataFrame, docs: DataFrame) -> FactoredGraph:
    """The graph of merged entities (doc_id, entity_type, canonical, confidence) and documents (doc_id, text), stored.

    Documents without a form that another one has are in no class. A form is early for its first three documents.
    """
    own = kept(entities.groupBy("doc_id", "canonical").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("entity_type")).alias("types")), "graph-forms")
    first = own.select("canonical", "doc_id").withColumn("seen", F.row_number().over(Window.partitionBy("canonical").orderBy("doc_id"))).filter(F.col("seen") <= EARLY)
    third = first.groupBy("canonical").agg(F.max("doc_id").alias("third"))
    shared = own.groupBy("canonical").agg(F.count("*").alias("n")).filter("n > 1").join(third, "canonical")
    held = join_groups(own, shared, "canonical", own.count()).withColumn("early", F.col("doc_id") <= F.col("third"))
    sets = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("canonical", "confidence", "types", "early"))).alias("forms"))
    sizes = entities.groupBy("doc_id").agg(F.count("*").alias("n"))
    words = docs.select("doc_id", F.lower("text").alias("_t"))
    relation = F.coalesce(*(F.when(says(F.col("_t"), ws), F.lit(name)) for name, ws in RELATIONS), F.lit(""))
    told = words.select("doc_id", F.coalesce(says(F.col("_t"), SEQUENCE), F.lit(False)).alias("sequence"), relation.alias("relation"))
    alike = sets.join(sizes, "doc_id").join(told, "doc_id")
    alike = kept(alike.withColumn("sign", F.sha2(F.to_json(F.struct("forms", "n", "sequence", "relation")), 256)), "graph-documents")
    named = alike.groupBy("sign").agg(F.min("doc_id").alias("class"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in ("n", "sequence", "relation", "forms")))
    classes = kept(named, "graph-classes")
    names = classes.select("sign", "class", F.col("size").alias("n"))
    members = kept(join_groups(alike.select("doc_id", "sign"), names, "sign", alike.count()).select("doc_id", "class"), "graph-members")
    return FactoredGraph(members, classes.drop("sign"), classes.select("class", F.inline("forms")))


def class_links(graph: FactoredGraph, asked: DataFrame | None = None) -> DataFrame:
    """Linked classes (a, b, shared, links, strength, type, back, back_type), of classes asked for (class), or of all with a <= b.

    strength and type hold if a's document is the newer one, back and back_type if b's is. links: the document pairs of the two classes.
    Classes of one form are dealt to blocks, and two blocks meet under one key, so that no task holds a common form whole.
    """
    blocks = graph.forms.groupBy("canonical").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = graph.forms.join(blocks, "canonical").withColumn("block", F.pmod(F.xxhash64("class"), "blocks")).withColumn("every", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    side = lambda name, own, other: [F.col("class").alias(name), F.struct("confidence", "types", "early").alias(f"of_{name}"), F.col("block").alias(own), F.explode("every").alias(other)]
    left = dealt if asked is None else dealt.join(small_side(asked.select("class").distinct()), "class", "left_semi")
    met = left.select("canonical", *side("a", "i", "j")).join(dealt.select("canonical", *side("b", "j", "i")), ["canonical", "i", "j"])
    if asked is None:
        met = met.filter(F.col("a") <= F.col("b"))
    of = lambda x: [F.avg(f"of_{x}.confidence").alias(f"c_{x}"), F.count_if(F.col(f"of_{x}.early")).alias(f"rare_{x}"), F.array_distinct(F.flatten(F.collect_list(f"of_{x}.types"))).alias(f"types_{x}")]
    pairs = met.groupBy("a", "b").agg(F.sort_array(F.collect_list("canonical")).alias("shared"), *of("a"), *of("b"))
    facts = graph.classes.select("class", F.struct("size", "n", "sequence", "relation").alias("fact"))
    pairs = pairs.join(facts.select(F.col("class").alias("a"), F.col("fact").alias("fact_a")), "a").join(facts.select(F.col("class").alias("b"), F.col("fact").alias("fact_b")), "b")
    pairs = pairs.filter((F.col("a") != F.col("b")) | (F.col("fact_a.size") > 1))
    links = F.when(F.col("a") == F.col("b"), (F.col("fact_a.size") * (F.col("fact_a.size") - 1) / 2).cast("long")).otherwise(F.col("fact_a.size") * F.col("fact_b.size"))
    strength = lambda x: _strength(F.size("shared"), F.col(f"c_{x}"), F.col(f"rare_{x}"), F.col("fact_a.n"), F.col("fact_b.n"))
    kind = lambda x: type_of(F.col(f"types_{x}"), F.col(f"fact_{x}.sequence"), F.col(f"fact_{x}.relation"))
    return pairs.select("a", "b", "shared", links.alias("links"), strength("a").alias("strength"), kind("a").alias("type"), strength("b").alias("back"), kind("b").alias("back_type"))


def _strength(shared: Column, confidence: Column, rare: Column, n: Column, other_n: Column) -> Column:
    total = F.least(shared * 0.2, F.lit(0.8)) + confidence * 0.2 + F.least(rare * 0.1, F.lit(0.3))
    return F.round(F.least(F.lit(1.0), F.when(F.least(n, other_n) / F.greatest(n, other_n) < 0.3, total * 0.8).otherwise(total)), 6)


def doc_pairs(graph: FactoredGraph, links: DataFrame) -> DataFrame:
    """(src, dst, strength, type, shared): the document pairs of some class links, the newer document first. As many rows as pairs."""
    side = lambda name, doc: graph.members.select(F.col("class").alias(name), F.col("doc_id").alias(doc))
    pairs = links.join(side("a", "x"), "a").join(side("b", "y"), "b").filter((F.col("a") != F.col("b")) | (F.col("x") > F.col("y"))).filter(F.col("x") != F.col("y"))
    newer = F.col("x") > F.col("y")
    pick = lambda one, two: F.when(newer, F.col(one)).otherwise(F.col(two))
    return pairs.select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst"), pick("strength", "back").alias("strength"), pick("type", "back_type").alias("type"), "shared")


def degrees(graph: FactoredGraph, links: DataFrame) -> DataFrame:
    """(class, size, n): the documents that each document of a class is linked to. links: of all classes."""
    sizes = graph.classes.select("class", "size")
    both = links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(links.filter(F.col("a") != F.col("b")).select("b", "a"))
    counted = both.join(sizes.select(F.col("class").alias("other"), F.col("size").alias("s")), "other").groupBy("class").agg(F.sum(F.when(F.col("other") == F.col("class"), F.col("s") - 1).otherwise(F.col("s"))).alias("n"))
    return sizes.join(counted, "class", "left").fillna(0, ["n"])


def _chunks(rows: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """Documents (keys, doc_id) as sorted arrays (keys, ids, before, after, next) of CHUNK, or k if that is more: the id before an array, the first of the next one, and k of its."""
    chunks = numbered(rows.select(*keys, "doc_id"), ["doc_id"], keys).groupBy(*keys, F.floor(F.col("i") / max(CHUNK, k)).alias("chunk")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    w = Window.partitionBy(*keys).orderBy("chunk")  # a CHUNK-th of the documents
    beside = {"before": F.lag(F.element_at("ids", -1)).over(w), "after": F.lead(F.element_at("ids", 1)).over(w), "next": F.coalesce(F.lead(F.slice("ids", 1, k)).over(w), F.array().cast("array<long>"))}
    return kept(chunks.withColumns(beside).drop("chunk"), "graph-chunks")


def _held(rows: DataFrame, chunks: DataFrame, keys: tuple[str, ...], fits: Column) -> DataFrame:
    """rows with the columns of the one chunk of their keys that fits."""
    own = small_side(chunks.select(*(F.col(c).alias(f"_{c}") for c in keys), "ids", "before", "after", "next"), 5000)
    return rows.join(own, reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_{c}") for c in keys)) & fits).drop(*(f"_{c}" for c in keys))


def _from(rows: DataFrame, chunks: DataFrame, keys: tuple[str, ...], at: Column, most: Column, k: int) -> DataFrame:
    """rows with found: the first k documents of their keys from at to most. Rows whose keys have none from at on drop out."""
    met = _held(rows, chunks, keys, (F.element_at("ids", -1) >= at) & F.coalesce(F.col("before") < at, F.lit(True)))
    return met.withColumn("found", F.slice(F.filter(F.concat("ids", "next"), lambda x: (x >= at) & (x <= most)), 1, k)).drop("ids", "before", "after", "next")


def _tight(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """runs (class, lo, hi, first, last) with lo and hi at members; those without a member drop out. first, last: of the class, dropped."""
    loose = (F.col("lo") > F.col("first")) | (F.col("hi") < F.col("last"))
    exact = runs.filter(~loose).drop("first", "last")
    up = _from(runs.filter(loose).drop("first", "last"), chunks, ("class",), F.col("lo"), F.col("hi"), 1).filter(F.size("found") > 0).withColumn("lo", F.col("found")[0]).drop("found")
    down = _held(up, chunks, ("class",), (F.element_at("ids", 1) <= F.col("hi")) & F.coalesce(F.col("after") > F.col("hi"), F.lit(True)))
    down = down.withColumn("hi", F.array_max(F.filter("ids", lambda x: x <= F.col("hi")))).drop("ids", "before", "after", "next")
    return exact.unionByName(down)


def uncovered(ranges: list[tuple[int, int]], cut: tuple[int, int]) -> list[tuple[int, int]]:
    """What a cut (lo, hi) leaves of ranges, ends included."""
    lo, hi = cut
    return [(x, y) for a, b in ranges for x, y in ((a, min(b, lo - 1)), (max(a, hi + 1), b)) if x <= y]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a query and class with first and last document, what was reached (sides: strength p up to id h and from id l on) and seen: the runs of ids by their best strength.

    h and l are ids of documents that the query reached before or of other classes, so they need not be left out. rest: whether more may be reached.
    """
    for pdf in batches:
        out = []
        for query, name, first, last, sides, seen in zip(pdf["query_id"], pdf["class"], pdf["first"], pdf["last"], pdf["sides"], pdf["seen"]):
            left, own = [(first, last)], []
            for r in seen if seen is not None else ():
                left = uncovered(left, (r["lo"], r["hi"]))
            for r in sorted(sides, key=lambda r: -r["p"]):
                before = left
                for cut in ((first, r["h"]), (r["l"], last)):
                    if cut[0] <= cut[1]:
                        left = uncovered(left, cut)
                gone = before
                for x in left:
                    gone = uncovered(gone, x)
                own += [(query, name, first, last, lo, hi, r["p"]) for lo, hi in gone]
            out += [(*r, bool(left)) for r in own]
        yield pd.DataFrame(out, columns=["query_id", "class", "first", "last", "lo", "hi", "strength", "rest"])


def multi_hop(graph: FactoredGraph, starts: DataFrame, targets: DataFrame | None = None, hops: int = 3, least: float = 0.1, top: int = 5, asked: DataFrame | None = None) -> DataFrame:
    """As graph.multi_hop, on the factored graph, for ids that are whole numbers. With asked (query_id, name), targets are (name, doc_id) instead.

    A query reaches the members of a class in runs: from one id to another all have one strength, since a link differs only by which
    document is the newer one. So a hop keeps runs of a query and class, never a row for a query and document; classes that a query
    has reached whole are left out of later hops, and a query that has reached all of them is done. The top documents come from the
    first members of runs, and only those get a path, from their end back to the start.
    """
    key, chunks = ("class",), _chunks(graph.members, ("class",), top)
    spans = chunks.groupBy("class").agg(F.min(F.element_at("ids", 1)).alias("first"), F.max(F.element_at("ids", -1)).alias("last"))
    classes, pair = graph.classes.count(), ["query_id", "class"]
    level = kept(starts.join(graph.members, "doc_id").select("query_id", "class", F.col("doc_id").cast("long").alias("lo"), F.col("doc_id").cast("long").alias("hi"), F.lit(1.0).alias("strength")).distinct(), "graph-frontier")
    levels, ways, front, seen, closed = [level], [None], level, level.select(*pair, "lo", "hi"), None
    for hop in range(1, hops + 1):
        links = kept(class_links(graph, front).select("a", "b", F.col("strength").alias("s"), "type", "back", "back_type"), "graph-links")
        step = front.join(links, F.col("class") == F.col("a")).select("query_id", F.col("b").alias("class"), "lo", "hi", "strength", "s", "back")
        if closed is not None:
            step = step.join(closed, pair, "left_anti")
        side = lambda s, h, l: F.struct(_product(s).alias("p"), h.alias("h"), l.alias("l"))  # noqa: E731, E741
        both = F.array(side("s", F.col("hi"), F.lit(HIGHEST)), side("back", F.lit(-HIGHEST), F.col("lo")))
        sides = step.select(*pair, F.inline(both)).filter(F.col("p") > least).groupBy(*pair, "p").agg(F.max("h").alias("h"), F.min("l").alias("l"))
        reach = sides.groupBy(*pair).agg(F.collect_list(F.struct("p", "h", "l")).alias("sides"))
        reach = reach.join(seen.groupBy(*pair).agg(F.collect_list(F.struct("lo", "hi")).alias("seen")), pair, "left").join(small_side(spans), "class")
        plain = F.col("seen").isNull() & (F.size("sides") == 1) & (F.col("sides")[0]["h"] >= F.col("sides")[0]["l"])
        reach = kept(reach.withColumn("plain", plain), "graph-reach")
        runs = reach.filter("plain").select(*pair, "first", "last", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("sides")[0]["p"].alias("strength"), F.lit(False).alias("rest"))
        kind = dict(reach.dtypes)
        parted = reach.filter("not plain").select(*pair, "first", "last", "sides", "seen").mapInPandas(_runs, f"query_id {kind['query_id']}, class {kind['class']}, first {kind['first']}, last {kind['last']}, lo long, hi long, strength double, rest boolean")
        runs = kept(runs.unionByName(parted), "graph-runs")
        level = kept(_tight(runs.drop("rest"), chunks), "graph-frontier")
        levels.append(level)
        ways.append(links)
        whole = runs.filter("not rest").select(*pair).distinct()
        closed = whole if closed is None else closed.union(whole)
        seen = seen.union(runs.select(*pair, "lo", "hi"))
        front = level.join(closed.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") == classes), "query_id", "left_anti")
        if hop < hops and not front.head(1):
            break
    found = reduce(DataFrame.unionByName, (x.withColumn("hops", F.lit(hop)) for hop, x in enumerate(levels) if hop))
    best = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("strength"), *order)) <= top
    if targets is None:  # a run has a member, its lo: what comes after top runs comes after top documents
        each, by = found.withColumn("fits", best(["query_id"], "lo")).filter("fits"), ["query_id"]
    else:
        if asked is None:
            asked, targets = targets.select("query_id", F.col("query_id").alias("name")).distinct(), targets.withColumnRenamed("query_id", "name")
        targets = targets.select("name", "doc_id").distinct().join(graph.members, "doc_id")
        key, chunks_of = ("name", "class"), _chunks(targets, ("name", "class"), top)
        each, by = found.join(asked.select("query_id", "name").distinct(), "query_id"), ["query_id", "name"]
    each = _from(each, chunks if targets is None else chunks_of, key, F.col("lo"), F.col("hi"), top).filter(F.size("found") > 0)
    each = each.withColumn("fits", best(by, F.col("found")[0])).filter("fits").select("query_id", "class", "strength", "hops", F.explode("found").alias("end")).dropDuplicates(["query_id", "end"])
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("strength"), "end"))).filter(F.col("rank") <= top)
    paths = ranked.withColumns({"at": F.col("end"), "p": F.col("strength"), "left": F.col("hops"), "path": F.array("end"), "types": F.array().cast("array<string>")})
    for hop in range(len(levels) - 1, 0, -1):
        paths = kept(paths, "graph-paths")
        paths = paths.filter(F.col("left") < hop).unionByName(_parents(paths.filter(F.col("left") == hop), ways[hop], levels[hop - 1], chunks, hop))
    return paths.select("query_id", "end", "path", "types", "strength", "hops", "rank")


def _product(s: str) -> Column:
    return F.round(F.col("strength") * F.col(s), 9)


def _parents(paths: DataFrame, links: DataFrame, level: DataFrame, chunks: DataFrame, hop: int) -> DataFrame:
    """paths with a document more in front: the least one of the level before that gives the strength p at the document at."""
    held = level.select("query_id", F.col("class").alias("a"), "lo", "hi", F.col("strength").alias("v"))
    met = paths.withColumnRenamed("strength", "total").join(links, F.col("class") == F.col("b")).drop("class", "b").join(held, ["query_id", "a"]).withColumnRenamed("v", "strength")
    newer, older = (_product("s") == F.col("p")) & (F.col("hi") > F.col("at")), (_product("back") == F.col("p")) & (F.col("lo") < F.col("at"))
    met = met.filter(newer | older).withColumn("direct", older | (F.col("lo") > F.col("at"))).withColumnRenamed("a", "class")
    between = _from(met.filter("not direct"), chunks, ("class",), F.col("at") + 1, F.col("hi"), 1).withColumn("parent", F.col("found")[0]).drop("found")
    tried = met.filter("direct").withColumn("parent", F.col("lo")).unionByName(between)
    kind = F.when(F.col("parent") > F.col("at"), F.col("type")).otherwise(F.col("back_type"))
    row = F.struct("class", F.col("total").alias("strength"), "hops", "rank", F.col("parent").alias("at"), F.col("strength").alias("p"), F.concat(F.array("parent"), "path").alias("path"), F.concat(F.array(kind), "types").alias("types"))
    return tried.groupBy("query_id", "end").agg(F.min_by(row, "parent").alias("r")).select("query_id", "end", "r.*", F.lit(hop - 1).alias("left"))


def neighborhood(graph: FactoredGraph, starts: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Classes (query_id, class) within radius of starts (query_id, doc_id), and the class links among them (query_id, a, b, links).

    A start's own class is one hop away from it, all of its members alike, so whole classes are reached; a start in no class, or
    alone in its class and form, reaches nothing but itself.
    """
    nodes = kept(starts.join(graph.members, "doc_id").select("query_id", "class").distinct(), "graph-ring")
    front = nodes
    for _ in range(radius):
        links = class_links(graph, front).select("a", "b")
        near = front.join(links, F.col("class") == F.col("a")).select("query_id", F.col("b").alias("class")).distinct()
        front = kept(near.join(nodes, ["query_id", "class"], "left_anti"), "graph-ring")
        nodes = nodes.union(front)
    links = class_links(graph, nodes).filter(F.col("a") <= F.col("b")).select("a", "b", "links")
    inside = nodes.withColumnRenamed("class", "a").join(links, "a").join(nodes.withColumnRenamed("class", "b"), ["query_id", "b"], "left_semi")
    return nodes, inside.select("query_id", "a", "b", "links")


def neighbour_counts(graph: FactoredGraph, hit: DataFrame) -> DataFrame:
    """(name, neighbours): documents linked to a document of the name. hit: (name, doc_id), distinct.

    Of a class, all members are linked to a hit document but for the hit itself, where no other hit is linked to the class.
    """
    held = kept(hit.join(graph.members, "doc_id").groupBy("name", "class").agg(F.count("*").alias("hits")), "graph-hits")
    links = class_links(graph, held).select("a", "b")
    near = held.join(links, F.col("class") == F.col("a")).groupBy("name", F.col("b").alias("class")).agg(F.sum("hits").alias("linked"))
    near = near.join(held, ["name", "class"], "left").join(graph.classes.select("class", "size"), "class")
    own = F.when(F.col("linked") == 1, F.coalesce("hits", F.lit(0))).otherwise(0)
    return near.groupBy("name").agg(F.sum(F.col("size") - own).alias("neighbours"))
