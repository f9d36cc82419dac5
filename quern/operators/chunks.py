"""Chunking: a document row becomes chunk rows by expressions alone, without a shuffle. A token is four characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_after, once, strip

SENTENCE_END = r"[.!?]+\s+"
PARAGRAPH_END = r"\n\s*\n"
SECTION_START = r"(?m)(?=^#{1,6}\s)"


def count_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def offsets(segments: Column) -> Column:
    """0 and the end of each segment."""
    return F.aggregate(segments, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.length(s))))


def sentence_segments(c: Column) -> Column:
    return cut_after(c, SENTENCE_END)


def paragraph_segments(c: Column) -> Column:
    return cut_after(c, PARAGRAPH_END)


def sentence_bounds(c: Column) -> Column:
    return offsets(sentence_segments(c))


def paragraph_bounds(c: Column) -> Column:
    return offsets(paragraph_segments(c))


def section_bounds(c: Column) -> Column:
    """Offsets before Markdown headings, with 0 and the end."""
    return offsets(F.filter(F.split(c, SECTION_START), lambda x: x != ""))


def packed(segments: Column, text: Column, kind: str, max_tokens: int, min_tokens: int) -> Column:
    """array<struct<content, char_start, char_end, token_count, chunk_type>>: segments packed while they fit; short packs vanish."""
    schema = "array<struct<s:int,e:int>>"
    fold = F.aggregate(
        segments,
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.array().cast(schema).alias("out")),
        lambda a, x: F.when(F.floor((a["e"] + F.length(x) - a["s"]) / 4) <= max_tokens, F.struct(a["s"].alias("s"), (a["e"] + F.length(x)).alias("e"), a["out"].alias("out"))).otherwise(
            F.struct(a["e"].alias("s"), (a["e"] + F.length(x)).alias("e"), F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))),
    )
    made = F.transform(
        fold,
        lambda p: F.struct(strip(F.substring(text, p["s"] + 1, p["e"] - p["s"])).alias("content"), p["s"].alias("char_start"), p["e"].alias("char_end"), F.floor((p["e"] - p["s"]) / 4).cast("int").alias("token_count"), F.lit(kind).alias("chunk_type")),
    )
    return F.filter(made, lambda p: (p["content"] != "") & (p["token_count"] >= min_tokens))


def fixed(text: Column, size: int = 512, overlap: int = 50, min_tokens: int = 50, overlap_mode: str = "double") -> Column:
    """Windows of size tokens every size - overlap; from the second on they begin overlap earlier still, unless overlap_mode is single."""
    n = F.floor(F.length(text) / 4).cast("int")
    back = overlap if overlap_mode == "double" else 0
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    bounds = F.transform(starts, lambda i: F.struct(F.when(i > 0, F.greatest(F.lit(0), i - back)).otherwise(0).alias("s"), F.least(n, i + size).alias("e")))
    kept = F.filter(bounds, lambda b: b["e"] - b["s"] >= min_tokens)
    return F.transform(kept, lambda b: F.struct(strip(F.substring(text, b["s"] * 4 + 1, (b["e"] - b["s"]) * 4)).alias("content"), (b["s"] * 4).alias("char_start"), (b["e"] * 4).alias("char_end"), (b["e"] - b["s"]).alias("token_count"), F.lit("fixed_size").alias("chunk_type")))


def chunk_documents(docs: DataFrame, strategy: str = "hybrid", size: int = 512, overlap: int = 50, max_tokens: int = 1024, min_tokens: int = 50, overlap_mode: str = "double") -> DataFrame:
    """(doc_id, chunk_index, content, chunk_type, token_count, char_start, char_end); blank texts have no chunk.

    strategy: fixed, sentences, paragraph, semantic or hybrid; paragraph and semantic run hybrid.
    """
    own = once(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(strip(F.col("text")) != ""), "_s", sentence_segments(F.col("text")))
    t = F.col("text")
    if strategy == "fixed":
        made = fixed(t, size, overlap, min_tokens, overlap_mode)
    elif strategy == "sentences":
        made = packed(F.col("_s"), t, "sentence_boundary", max_tokens, min_tokens)
    elif strategy in ("hybrid", "paragraph", "semantic"):
        own = once(own, "_p", paragraph_segments(t))
        own = once(own, "_by", F.when(F.size("_p") >= 2, packed(F.col("_p"), t, "paragraph", max_tokens, min_tokens)))
        made = F.when(F.size("_by") > 0, F.col("_by")).otherwise(packed(F.col("_s"), t, "sentence_boundary", max_tokens, min_tokens))
    else:
        raise ValueError(f"unknown chunking strategy {strategy}")
    return own.select("doc_id", F.posexplode(made).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.content", "c.chunk_type", "c.token_count", "c.char_start", "c.char_end")


def chunk_by_bounds(docs: DataFrame, bounds: Column, kind: str, max_tokens: int = 1024, min_tokens: int = 50) -> DataFrame:
    """Chunks packed from any offsets array (0 first, the length last)."""
    own = once(docs.select("doc_id", "text"), "_b", bounds)
    segments = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda i: F.substring(F.col("text"), F.element_at("_b", i) + 1, F.element_at("_b", i + 1) - F.element_at("_b", i)))
    own = once(own, "_g", segments)
    return own.select("doc_id", F.posexplode(packed(F.col("_g"), F.col("text"), kind, max_tokens, min_tokens)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


def chunk_context(chunks: DataFrame, n: int = 1) -> DataFrame:
    """Each chunk with its n neighbours on both sides, joined by blank lines."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(-n, n)
    return chunks.withColumn("context", F.array_join(F.collect_list("content").over(w), "\n\n"))


def chunk_stats(chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One row: chunks, tokens and lengths; with docs also the share of characters that chunks keep."""
    one = chunks.agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.avg("token_count").alias("mean_tokens"), F.avg(F.length("content")).alias("mean_length"), F.sum(F.col("char_end") - F.col("char_start")).alias("covered"))
    if docs is None:
        return one
    return one.join(F.broadcast(docs.agg(F.sum(F.length("text")).alias("chars")))).withColumn("kept", F.col("covered") / F.col("chars"))
