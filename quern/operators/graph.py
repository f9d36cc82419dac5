"""Entities of documents and the graph of documents that share them.

Extraction needs match positions of many patterns, so it is one Arrow batch function; all else is joins and grouping. Links between
documents are kept and searched in classes (quern.operators.factored); the searches here take a caller's own table of edges. Level
joins write each frontier out, so lineage stays short and survives lost executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ranking import small_side

# Patterns and words of the rules.
PATTERNS = {
    "person": (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", r"\b(?:Mr|Mrs|Ms|Dr|CEO|CTO|CFO|President|Director)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    "organization": (r"\b[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*\s+(?:Inc|Corp|LLC|Ltd|Company|Corporation|Group|Associates)\b", r"\b(?:Department|Division|Team|Unit)\s+of\s+[A-Z][a-z]+\b"),
    "location": (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}\b", r"\b(?:in|at|from|to)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"),
    "date": (r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b(?:Q[1-4]|[Qq]uarter\s*[1-4])\s*\d{4}\b"),
    "money": (r"\$[\d,]+(?:\.\d{2})?\b", r"\b\d+(?:\.\d+)?\s*(?:million|billion|thousand|M|B|K)\s*(?:dollars?|USD)?\b"),
    "metric": (r"\b(?:KPI|ROI|EBITDA|P&L|revenue|profit|margin|growth|efficiency|productivity)\b", r"\b\d+(?:\.\d+)?%\b", r"\b\d+(?:\.\d+)?\s*(?:users?|customers?|employees?|sales?)\b"),
    "product": (r"\b[A-Z][a-zA-Z]*\s*(?:v?\d+(?:\.\d+)*|Version\s*\d+)\b", r"\b(?:software|platform|system|tool|application|service)\s+[A-Z][a-z]+\b"),
    "technology": (r"\b(?:API|REST|GraphQL|JSON|XML|HTTP|HTTPS|SQL|NoSQL|AI|ML|blockchain)\b", r"\b[A-Z][a-z]+(?:JS|Script|DB|SQL)\b"),
    "process": (r"\b(?:workflow|process|procedure|method|approach|strategy|framework)\s+[a-z]+\b", r"\b[A-Z][a-z]+\s+(?:process|workflow|procedure|method)\b"),
}
ALIASES = {
    "ceo": ("chief executive officer", "chief executive", "ceo"), "cto": ("chief technology officer", "chief technical officer", "cto"), "cfo": ("chief financial officer", "cfo"),
    "roi": ("return on investment", "roi", "return"), "kpi": ("key performance indicator", "performance indicator", "kpi"), "api": ("application programming interface", "programming interface", "api"),
}
RELATIONS = (("causal", ("because", "due to", "resulted in", "caused", "led to", "impact")), ("hierarchical", ("part of", "belongs to", "under", "division of", "department")), ("reference", ("see", "refer to", "mentioned in", "according to", "as stated in")))
SEQUENCE = ("before", "after", "following", "previous", "next")


def extract_entities(docs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, entity_type, text, position, context, confidence) of each match; case-insensitive as a rule."""
    rules = [(kind, re.compile(p, 0 if case_sensitive else re.IGNORECASE)) for kind, ps in PATTERNS.items() for p in ps]
    title, legal = re.compile(r"(?:mr|mrs|ms|dr|ceo|director|manager|president)\s*\.?\s*$"), re.compile(r"\b(?:inc|corp|llc|ltd|company|corporation)\b")

    def confidence(kind: str, own: str, text: str, low: str, start: int, end: int) -> float:
        c = 0.5
        if kind == "person" and title.search(low[max(0, start - 40) : start]):
            c += 0.3
        elif kind == "organization" and legal.search(own.lower()):
            c += 0.2
        elif kind == "metric" and re.search(r"\d", text[max(0, start - 100) : end + 100]):
            c += 0.2
        if len(own) < 4:
            c -= 0.1
        n = low.count(own.lower())
        return min(c + (min(0.2, n * 0.05) if n > 1 else 0), 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                text = text or ""
                low = text.lower()
                for kind, rule in rules:
                    for m in rule.finditer(text):
                        own = m.group().strip()
                        if len(own) < 2 or own.lower() in ("the", "and", "or", "but"):
                            continue
                        c = confidence(kind, own, text, low, m.start(), m.end())
                        if c > 0.3:
                            out.append((doc, kind, own, m.start(), text[max(0, m.start() - 50) : m.end() + 50], round(c, 6)))
            yield pd.DataFrame(out, columns=["doc_id", "entity_type", "text", "position", "context", "confidence"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, entity_type string, text string, position long, context string, confidence double")


def entity_canonical(kind: Column, text: Column) -> Column:
    person = F.initcap(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?i)^(?:Mr|Mrs|Ms|Dr)\.?\s*", "")), r"\s+", " "))
    org = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\b(Corporation|Corp)\b", "Corp"), r"(?i)\b(Incorporated|Inc)\b", "Inc"))
    quarter = F.regexp_extract(text, r"^[Qq]?([1-4])\s*(\d{4})", 1)
    date = F.when(quarter != "", F.concat(F.lit("Q"), quarter, F.lit(" "), F.regexp_extract(text, r"^[Qq]?([1-4])\s*(\d{4})", 2))).otherwise(F.trim(text))
    plain = F.translate(text, ",", "")
    money = F.when(plain.contains("K"), F.replace(plain, F.lit("K"), F.lit("000"))).when(plain.contains("M"), F.replace(plain, F.lit("M"), F.lit("000000"))).when(plain.contains("B"), F.replace(plain, F.lit("B"), F.lit("000000000"))).otherwise(plain)
    return F.when(kind == "person", person).when(kind == "organization", org).when(kind == "date", date).when(kind == "money", money).when(kind == "metric", F.trim(F.lower(text))).otherwise(F.trim(text))


def entity_aliases(kind: Column, canonical: Column) -> Column:
    """Known aliases; initials and first name of a person; the acronym of an organisation."""
    low = F.lower(canonical)
    known = F.array().cast("array<string>")
    for key, names in ALIASES.items():
        known = F.when((low == key) | low.isin(*names), F.array(*map(F.lit, names))).otherwise(known)
    parts = F.split(canonical, r"\s+")
    initials = F.array_join(F.transform(parts, lambda w: F.upper(F.substring(w, 1, 1))), "")
    person = F.array(F.array_join(F.transform(parts, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " "), F.element_at(parts, 1))
    more = F.when((kind == "person") & (F.size(parts) >= 2), person).when((kind == "organization") & (F.size(parts) >= 2), F.array(initials)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(known, more))


def merge_entities(found: DataFrame) -> DataFrame:
    """(doc_id, entity_type, canonical, confidence, aliases, mentions): a document's mentions joined by lower-cased canonical form and type."""
    own = found.withColumn("canonical", entity_canonical(F.col("entity_type"), F.col("text")))
    one = own.groupBy("doc_id", "entity_type", F.lower("canonical").alias("folded")).agg(F.min_by("canonical", F.struct("position", "canonical")).alias("canonical"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))
    return one.withColumn("aliases", entity_aliases(F.col("entity_type"), F.col("canonical"))).drop("folded")


def entity_index(entities: DataFrame) -> DataFrame:
    """(canonical, entity_type, documents, mentions)."""
    return entities.groupBy("canonical", "entity_type").agg(F.countDistinct("doc_id").alias("documents"), F.sum("mentions").alias("mentions"))


def doc_edges(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst, strength, type, shared): the newer document (higher doc_id) to each older one that shares a canonical form.

    As many rows as such pairs of documents: quern.operators.factored keeps and searches the same graph without them. An entity is rare
    if at most three documents had it when the newer one came. A link's strength is 0.2 at least.
    """
    from .factored import class_links, doc_pairs, factor

    graph = factor(entities, docs)
    return doc_pairs(graph, class_links(graph))


def says(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of some words."""
    return F.greatest(*(F.contains(text, F.lit(w)).cast("int") for w in words)) == 1


def type_of(types: Column, sequence: Column, relation: Column) -> Column:
    """A link's type: the first rule that holds. sequence, relation: what the newer document's words say, relation empty if nothing."""
    out = F.when(F.array_contains(types, "date") & sequence, "temporal").when(relation != "", relation)
    return out.when(F.array_contains(types, "person") & F.array_contains(types, "organization"), "coreference").otherwise("semantic")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "strength", "type").union(edges.select("dst", "src", "strength", "type"))


def multi_hop(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None, hops: int = 3, least: float = 0.1, top: int = 5) -> DataFrame:
    """(query_id, end, path, types, strength, hops): per query from starts (query_id, doc_id) to targets (query_id, doc_id), or to all documents.

    A node is reached by the fewest hops, then the highest product of strengths, then the smallest parent.
    """
    links = both_ways(edges)
    front = starts.select("query_id", F.col("doc_id").alias("end"), F.array("doc_id").alias("path"), F.array().cast("array<string>").alias("types"), F.lit(1.0).alias("strength"), F.lit(0).alias("hops"))
    seen, found = front.select("query_id", "end"), None
    for hop in range(1, hops + 1):
        step = front.join(links.select(F.col("src").alias("end"), "dst", F.col("strength").alias("s"), "type"), "end")
        step = step.withColumn("p", F.round(F.col("strength") * F.col("s"), 9)).filter(F.col("p") > least)
        step = step.join(seen.withColumnRenamed("end", "dst"), ["query_id", "dst"], "left_anti")
        best = step.groupBy("query_id", "dst").agg(F.min_by(F.struct("path", "types", "type", "p"), F.struct((-F.col("p")).alias("m"), "end", "type")).alias("b"))
        front = kept(best.select("query_id", F.col("dst").alias("end"), F.concat("b.path", F.array("dst")).alias("path"), F.concat("b.types", F.array("b.type")).alias("types"), F.col("b.p").alias("strength"), F.lit(hop).alias("hops")), "frontier")
        seen = seen.union(front.select("query_id", "end"))
        found = front if found is None else found.union(front)
    hits = found if targets is None else found.join(targets.select("query_id", F.col("doc_id").alias("end")).distinct(), ["query_id", "end"], "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("strength"), "end")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


#: Sentences of a path by relation.
SENTENCES = {"temporal": "comes before or after", "causal": "causes or follows from", "hierarchical": "is part of or holds", "reference": "refers to", "coreference": "names the same as", "semantic": "is related to"}


def reasoning_chain(paths: DataFrame) -> DataFrame:
    phrase = F.create_map(*(F.lit(x) for kv in SENTENCES.items() for x in kv))
    steps = F.transform("types", lambda t, i: F.concat_ws(" ", F.lit("Document"), F.element_at("path", i + 1).cast("string"), phrase[t], F.lit("document"), F.element_at("path", i + 2).cast("string")))
    return paths.withColumn("chain", steps)


def neighborhood(edges: DataFrame, starts: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, doc_id) within radius of starts (query_id, doc_id), and the edges among them."""
    links = both_ways(edges).select("src", "dst").distinct()
    nodes = starts.select("query_id", "doc_id").distinct()
    front = nodes
    for _ in range(radius):
        near = front.join(links, F.col("doc_id") == F.col("src")).select("query_id", F.col("dst").alias("doc_id")).distinct()
        front = kept(near.join(nodes, ["query_id", "doc_id"], "left_anti"), "ring")
        nodes = nodes.union(front)
    inside = nodes.select("query_id", F.col("doc_id").alias("src")).join(edges, "src").join(nodes.withColumnRenamed("doc_id", "dst"), ["query_id", "dst"], "left_semi")
    return nodes, inside


def graph_stats(entities: DataFrame, edges: DataFrame, ends: DataFrame, top: int = 5) -> DataFrame:
    """One row: documents, entities, edges, mean entities a document, the highest degrees of ends (d, n), and the commonest entities.

    edges: one row with the column edges.
    """
    ends = ends.orderBy(F.desc("n"), "d").limit(top)
    names = entities.groupBy("canonical").agg(F.countDistinct("doc_id").alias("n")).orderBy(F.desc("n"), "canonical").limit(2 * top)
    listed = lambda df, c, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), c))), lambda s: F.concat_ws(":", s[c].cast("string"), (-s["m"]).cast("string"))).alias(name))
    one = entities.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("canonical", "entity_type").alias("entities"), (F.count("*") / F.countDistinct("doc_id")).alias("per_document"))
    return one.join(F.broadcast(edges)).join(F.broadcast(listed(ends, "d", "degrees"))).join(F.broadcast(listed(names, "canonical", "common")))


def related_entities(entities: DataFrame, names: DataFrame, top: int = 10) -> DataFrame:
    """(name, canonical, n): the entities that share most documents with each name (name)."""
    docs_of = names.join(entities.select(F.col("canonical").alias("name"), "doc_id").distinct(), "name")
    near = docs_of.join(entities.select("doc_id", "canonical").distinct(), "doc_id").filter(F.col("canonical") != F.col("name"))
    counted = near.groupBy("name", "canonical").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "canonical"))).filter(F.col("rank") <= top)


def called(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(name, doc_id): documents that hold a name (name) as canonical form or alias."""
    every = entities.select("doc_id", F.col("canonical").alias("name")).union(entities.select("doc_id", F.explode("aliases").alias("name")))
    return names.join(every, "name").select("name", "doc_id").distinct()


def entity_insights(entities: DataFrame, hit: DataFrame, near: DataFrame, names: DataFrame) -> DataFrame:
    """(name, documents, neighbours, related): documents of a name (hit: called()), documents linked to them (near: name, neighbours), and related entities."""
    related = related_entities(entities, names).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), lambda s: s["canonical"]).alias("related"))
    return hit.groupBy("name").agg(F.count("*").alias("documents")).join(near, "name", "left").join(related, "name", "left").fillna(0, ["neighbours"])


def follow_up(paths: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, question, confidence, rank): a question for each relation of the three best paths, and one that compares two."""
    best = paths.filter(F.col("rank") <= 3)
    each = best.select("query_id", "strength", "rank", F.posexplode("types").alias("n", "t"), "path")
    ask = each.select("query_id", F.concat(F.lit("How does document "), F.element_at("path", F.col("n") + 1).cast("string"), F.lit(" relate ("), "t", F.lit(") to document "), F.element_at("path", F.col("n") + 2).cast("string"), F.lit("?")).alias("question"), F.round(F.col("strength") * 0.8, 6).alias("confidence"))
    two = best.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("end")).alias("ends")).filter("n > 1")
    compare = two.select("query_id", F.concat(F.lit("How do documents "), F.col("ends")[0].cast("string"), F.lit(" and "), F.col("ends")[1].cast("string"), F.lit(" compare?")).alias("question"), F.lit(0.6).alias("confidence"))
    every = ask.union(compare).groupBy("query_id", "question").agg(F.max("confidence").alias("confidence"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "question"))).filter(F.col("rank") <= top)


def multi_hop_batch(search, entities: DataFrame, hits: DataFrame, query_entities: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, doc_id, distance): documents on paths from each query's three best hits to documents of its entities (query_id, name).

    search: a function of starts (query_id, doc_id), asked (query_id, name) and targets (name, doc_id), which are not joined to a row
    for a query and document.
    """
    asked = query_entities.select("query_id", "name").distinct()
    targets = entities.select(F.col("canonical").alias("name"), "doc_id").join(small_side(asked.select("name").distinct()), "name", "left_semi").distinct()
    paths = search(hits.filter(F.col("rank") <= 3).select("query_id", "doc_id"), asked, targets)
    on = paths.select("query_id", F.posexplode("path").alias("distance", "doc_id")).groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))
    return on.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))).filter(F.col("rank") <= limit)
