"""Embedding jobs: quantisation, vocabularies, features and reuse of stored embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clusters import codebooks, encode
from ..functions.text import contained, once, raw_words, share, words
from ..sources.shared import kept

from ..functions.embeddings import cosine, norm
from .monitor import dot_sentences
from .ranking import small_side


def quantize_int8(df: DataFrame, vec: str = "vec") -> DataFrame:
    """q, scale = max |x| / 127 (1 for a zero embedding) and norm; halves round to even."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return df.withColumn("scale", scale).withColumn("q", F.transform(vec, lambda x: F.bround(x.cast("double") / F.col("scale"), 0).cast("tinyint"))).withColumn("norm", norm(F.col(vec)))


def quantize_binary(df: DataFrame, vec: str = "vec") -> DataFrame:
    """q: the sign of each number."""
    return df.withColumn("q", F.transform(vec, lambda x: F.signum(x.cast("double")).cast("tinyint")))


def quantize_pq(df: DataFrame, parts: int = 8, centroids: int = 256, sample_rows: int = 20_000, vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Rows with codes array<int>, and the codebook (sub, code, centroid): a k-means a sub-embedding, fitted on a bounded sample."""
    spark = df.sparkSession
    x = np.array([r[0] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(vec).collect()], float)
    books = codebooks(x, parts, centroids)
    held = spark.sparkContext.broadcast(books)

    def codes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.array([np.asarray(v, float) for v in pdf[vec]]).reshape(len(pdf), -1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "codes": list(encode(m, held.value).astype(np.int32))})

    book = spark.createDataFrame([(s, k, [float(v) for v in row]) for s, b in enumerate(books) for k, row in enumerate(b)], "sub int, code int, centroid array<double>")
    return df.select("doc_id", vec).mapInPandas(codes_of, "doc_id long, codes array<int>"), book


def dequantize(df: DataFrame, kind: str = "int8", codebook: DataFrame | None = None) -> DataFrame:
    """vec of quantised rows; the sign 0 becomes -1, as a bit has no third value."""
    if kind == "int8":
        return df.withColumn("vec", F.transform("q", lambda x: x * F.col("scale")))
    if kind == "binary":
        return df.withColumn("vec", F.transform("q", lambda x: F.when(x > 0, 1.0).otherwise(-1.0)))
    if kind == "pq":
        parts = df.select("doc_id", F.posexplode("codes").alias("sub", "code")).join(codebook, ["sub", "code"])
        return parts.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sub", "centroid"))), lambda s: s["centroid"])).alias("vec"))
    raise ValueError(f"unknown quantisation {kind}")


def quantize(df: DataFrame, kind: str = "int8") -> DataFrame:
    if kind not in ("int8", "binary"):
        raise ValueError(f"unknown quantisation {kind}")
    return {"int8": quantize_int8, "binary": quantize_binary}[kind](df)


def quantization_stats(original: DataFrame, kind: str = "int8") -> DataFrame:
    """One row: embeddings, compression ratio, mean 1 - cosine to the original over all rows, MB saved."""
    back = dequantize(quantize(original.withColumn("_v", F.col("vec")), kind), kind)
    own = back.select(F.size("_v").alias("d"), (1 - cosine(F.col("vec"), F.col("_v"))).alias("loss"))
    small = F.col("d") + 8 if kind == "int8" else F.ceil(F.col("d") / 8)
    return own.agg(F.lit(kind).alias("method"), F.count("*").alias("n"), (F.sum(F.col("d") * 4) / F.sum(small)).alias("ratio"), F.avg("loss").alias("loss"), (F.sum(F.col("d") * 4 - small) / 1e6).alias("saved_mb"))


def quantization_bench(original: DataFrame) -> DataFrame:
    return quantization_stats(original, "int8").unionByName(quantization_stats(original, "binary"))


def clean_terms(text: str = "text") -> Column:
    cleaned = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)[^\p{L}\p{N}\s]+", "")  # whole texts, not word by word
    return F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: F.length(w) > 2)


def domain_vocabulary(docs: DataFrame, key: str) -> DataFrame:
    """Per key: documents, words, distinct terms, density, and terms of three or more among the 100 commonest, 50 at most."""
    own = docs.select(key, F.size(words(F.col("text"))).alias("n"), clean_terms().alias("t"))
    sizes = own.groupBy(key).agg(F.count("*").alias("documents"), F.sum("n").alias("words"))
    freq = kept(own.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("f")), "term-counts")
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc("f"), "term")
    top = freq.withColumn("r", F.row_number().over(w)).filter("r <= 50 and f >= 3").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("terms"))
    return sizes.join(freq.groupBy(key).agg(F.count("*").alias("unique_words")), key, "left").join(top, key, "left").withColumn("density", share(F.col("unique_words"), F.col("words")))


def domain_boost(rows: DataFrame, terms: Column) -> DataFrame:
    """vec times 1 + 0.1 x share of the text's distinct words among the domain's terms."""
    own = once(rows.drop("boost"), "_words", F.array_distinct(words(F.col("text"))))
    own = once(own, "boost", 1 + 0.1 * share(F.size(F.array_intersect("_words", terms)), F.size("_words")))
    return own.withColumn("vec", F.transform("vec", lambda x: x * F.col("boost"))).drop("_words")


#: Vocabularies of 50 terms at most that may be broadcast.
VOCABULARIES = 10_000


def domain_embeddings(rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Embeddings boosted where their domain has a vocabulary (key, terms)."""
    own = rows.join(small_side(kept(vocabulary.select(key, "terms"), "vocabulary"), VOCABULARIES), key, "left")
    return domain_boost(own, F.coalesce("terms", F.array().cast("array<string>")))


def structural_vector(text: str = "text", metadata: Column | None = None, size: int = 32) -> Column:
    c = F.coalesce(F.col(text), F.lit(""))
    w = raw_words(c)
    upper = F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x))
    own = [F.length(c), F.size(w), F.size(dot_sentences(c)), F.regexp_count(c, F.lit("\n")), F.regexp_count(c, F.lit(r"\?")), F.regexp_count(c, F.lit("!")), F.size(upper), F.size(F.filter(w, lambda x: x.rlike("^[0-9]+$")))]
    if metadata is None:
        own += [F.lit(0.0)] * 4
    else:
        own += [F.coalesce(F.size(metadata), F.lit(0))] + [F.coalesce(F.map_contains_key(metadata, F.lit(k)).cast("int"), F.lit(0)) for k in ("title", "author", "date")]
    return F.concat(F.array(*(x.cast("double") for x in own)), F.array_repeat(F.lit(0.0), size - len(own)))


#: Words and phrases of time.
TIME_WORDS, TIME_PHRASES = ("yesterday", "today", "tomorrow", "recent", "current", "future", "past"), ("in the future", "in the past", "currently", "previously", "recently")


def temporal_vector(as_of: str, text: str = "text", created: str | None = None, size: int = 16) -> Column:
    """Shares of time words, dates and phrases, and recency: 1 / (1 + days / 365), infinite 365 days ahead of as_of, as a double's division is."""
    c = F.coalesce(F.col(text), F.lit(""))
    n, low = F.size(raw_words(c)), F.lower(c)
    days = F.date_diff(F.lit(as_of).cast("date"), F.to_date(created)) if created else None
    own = [share(contained(low, TIME_WORDS), n), share(F.regexp_count(c, F.lit(r"\d{4}|\d{1,2}/\d{1,2}|\d{1,2}-\d{1,2}")), n), F.lit(0.0) if days is None else F.coalesce(F.when(days == -365, F.lit(float("inf"))).otherwise(1 / (1 + days / 365)), F.lit(0.0)), share(contained(low, TIME_PHRASES), n)]
    return F.concat(F.array(*(x.cast("double") for x in own)), F.array_repeat(F.lit(0.0), size - len(own)))


#: Weights of the semantic, keyword, structural and temporal parts.
PART_WEIGHTS = {"semantic": 0.6, "keyword": 0.2, "structural": 0.1, "temporal": 0.1}


def multi_vector(rows: DataFrame, as_of: str, semantic: str = "vec", created: str | None = None) -> DataFrame:
    """parts struct<semantic, structural, temporal>; the sparse keyword part is the table of keyword_vector."""
    return rows.withColumn("parts", F.struct(F.col(semantic).alias("semantic"), structural_vector().alias("structural"), temporal_vector(as_of, created=created).alias("temporal")))


def scaled(vec: Column, weight: float) -> Column:
    return F.transform(vec, lambda x: x.cast("double") * weight)


def combine_vectors(parts: dict[str, Column]) -> Column:
    return F.concat(*(scaled(c, PART_WEIGHTS[n]) for n, c in parts.items()))


def multi_vector_search(corpus: DataFrame, queries: DataFrame, kinds: tuple[str, ...], k: int) -> DataFrame:
    """Weighted mean of cosines over the kinds: columns of both tables. Scaled unit parts side by side make it one product."""
    from ..functions.embeddings import unit
    from .dense import knn

    total = sum(PART_WEIGHTS[n] for n in kinds)
    joined = F.concat(*(scaled(unit(F.col(n)), float(np.sqrt(PART_WEIGHTS[n] / total))) for n in kinds))
    return knn(corpus.select("doc_id", joined.alias("vec")), queries.select("query_id", joined.alias("vec")), k, "dot")


def embedding_pipeline(rows: DataFrame, key: str) -> DataFrame:
    """Vocabulary, boosted embeddings and int8 form of rows (doc_id, key, text, vec)."""
    return quantize_int8(domain_embeddings(rows, domain_vocabulary(rows, key), key))


def embedding_memo(texts: DataFrame, memo: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Texts with a stored embedding of the model, and those to encode; memo: (model, text_hash, vec)."""
    own = texts.withColumn("text_hash", F.sha2("text", 256))
    known = memo.filter(F.col("model") == model).select("text_hash", "vec")
    return own.join(known, "text_hash"), own.join(known, "text_hash", "left_anti")


def stale_keys(new: DataFrame, old: DataFrame, uses: DataFrame) -> DataFrame:
    """Result keys of uses (doc_id, key) whose document's fingerprint changed or is gone."""
    n, o = (x.select("doc_id", F.sha2("text", 256).alias(c)) for x, c in ((new, "n"), (old, "o")))
    changed = o.join(n, "doc_id", "left").filter(F.col("n").isNull() | (F.col("n") != F.col("o"))).select("doc_id")
    return uses.join(changed, "doc_id", "left_semi").select("key").distinct()
