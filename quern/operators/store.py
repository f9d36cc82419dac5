"""Lookups, maintenance and validation of document tables. A change gives a new table; nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, words


def get_by_id(docs: DataFrame, doc_id) -> DataFrame:
    return docs.filter(F.col("doc_id") == doc_id)


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def list_preview(docs: DataFrame) -> DataFrame:
    return docs.withColumn("preview", preview(F.col("text")))


def list_page(docs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return docs.orderBy("doc_id").offset(offset).limit(limit).withColumn("content_length", F.length("text"))


def delete_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id", "left_anti")


def delete_by_filter(docs: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number deleted; a null predicate deletes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return docs.filter(~hit), docs.filter(hit).agg(F.count("*").alias("deleted"))


def upsert_docs(docs: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    new = updates.withColumn("updated_at", F.lit(as_of).cast("timestamp"))
    return docs.join(updates, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def patch_docs(docs: DataFrame, patches: DataFrame, columns: tuple[str, ...], as_of: str) -> DataFrame:
    """columns replaced where the patch (doc_id, columns) gives a value."""
    p = patches.select("doc_id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    own = docs.join(p, "doc_id", "left")
    changed = {c: F.coalesce(f"_{c}", c) for c in columns} | {"updated_at": F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))}
    return own.withColumns(changed).select(*docs.columns)


def doc_status(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """status and error by outcomes (doc_id, ok, error); without an outcome a document is pending."""
    own = docs.join(outcomes, "doc_id", "left")
    return own.withColumn("status", F.when(F.col("ok").isNull(), "pending").when(F.col("ok"), "completed").otherwise("failed")).drop("ok")


def delete_file_cascade(files: DataFrame, docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and documents (file_id) without those of gone (file_id)."""
    return files.join(gone, "file_id", "left_anti"), docs.join(gone, "file_id", "left_anti")


#: Text that documents must not hold: fixed values.
FORBIDDEN = ("<script", "javascript:", "eval(", "exec(")


def validate_docs(docs: DataFrame) -> DataFrame:
    """violations array<string> of (title, text)."""
    t, c = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    rules = [(strip(t) == "", "title required"), (F.length(t) > 500, "title too long"), (strip(c) == "", "content required"), (F.length(c) > 1_000_000, "content too long")]
    rules += [(F.contains(F.lower(c), F.lit(p)), f"forbidden {p}") for p in FORBIDDEN]
    return docs.withColumn("violations", F.array_compact(F.array(*(F.when(cond, F.lit(m)) for cond, m in rules))))


def validate_queries(queries: DataFrame) -> DataFrame:
    """text trimmed, k by default 10, and error."""
    own = queries.withColumn("text", strip(F.coalesce("text", F.lit("")))).withColumn("k", F.coalesce("k", F.lit(10)))
    return own.withColumn("error", F.when(F.col("text") == "", "query required").when(F.length("text") > 1000, "query too long").when(~F.col("k").between(1, 50), "limit out of range"))


#: Tags that stay in stored html: fixed values.
ALLOWED_TAGS = ("p", "br", "strong", "em", "u", "ol", "ul", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "code", "pre")


def strip_html(c: Column, tags: tuple[str, ...] = ALLOWED_TAGS) -> Column:
    """Tags outside the list removed; those that stay lose their attributes."""
    kept = F.regexp_replace(c, rf"(?i)<(/?)({'|'.join(tags)})(?:\s[^<>]*)?/?>", "\u0001$1$2\u0002") if tags else c
    return F.translate(F.regexp_replace(kept, r"<[^<>]*>", ""), "\u0001\u0002", "<>")


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """title, content without html and source by default api, each cut to its length, and error."""
    own = uploads.withColumn("source", F.coalesce("source", F.lit("api"))).withColumn("text", strip(strip_html(F.coalesce("text", F.lit("")), ()))).withColumn("title", strip(F.coalesce("title", F.lit(""))))
    return own.withColumn("error", F.when(F.col("title") == "", "title required").when(F.length("title") > 200, "title too long").when(F.col("text") == "", "content required").when(F.length("text") > 1_000_000, "content too long").when(F.length("source") > 100, "source too long"))


EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def validate_strings(rows: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """errors map of column to message. rules: column -> required, min, max, pattern, low, high, email."""
    made = []
    for name, rule in rules.items():
        c = strip(F.col(name).cast("string"))
        bad = F.when(c.isNull() | (c == ""), F.lit("required") if rule.get("required") else F.lit(None))
        if "min" in rule:
            bad = bad.when(F.length(c) < rule["min"], f"at least {rule['min']} characters")
        if "max" in rule:
            bad = bad.when(F.length(c) > rule["max"], f"at most {rule['max']} characters")
        if "pattern" in rule or rule.get("email"):
            bad = bad.when(~c.rlike(rule.get("pattern", EMAIL)), "invalid format")
        if "low" in rule:
            n = c.try_cast("long")
            bad = bad.when(n.isNull(), "not an integer").when((n < rule["low"]) | (n > rule["high"]), "out of range")
        made.append(F.struct(F.lit(name).alias("key"), bad.alias("value")))
    return rows.withColumn("errors", F.map_from_entries(F.filter(F.array(*made), lambda e: e["value"].isNotNull())))


def validate_payload_rows(rows: DataFrame, payload: str, required: tuple[str, ...], max_bytes: int = 1 << 20) -> DataFrame:
    """error of json rows: too large, not an object, or a required field that lacks."""
    keys = F.json_object_keys(payload)
    bad = F.when(F.octet_length(payload) > max_bytes, "too large").when(keys.isNull(), "invalid json")
    for name in required:
        bad = bad.when(~F.array_contains(keys, name), f"missing {name}")
    return rows.withColumn("error", bad)


#: Injection patterns: fixed values.
SQL_INJECTION = (r"\b(union|select|insert|update|delete|drop|create|alter|exec|execute)\b", r"--|#|/\*|\*/", r"\b(or|and)\b\s+\d+\s*=\s*\d+", r"['\"];")
XSS = (r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>")


def flag_injection(rows: DataFrame, text: str = "text") -> DataFrame:
    """sql_injection and xss flags, and the patterns that matched."""
    hits = lambda ps: F.array_compact(F.array(*(F.when(F.col(text).rlike(f"(?is){p}"), F.lit(i)) for i, p in enumerate(ps))))
    return rows.withColumn("sql_patterns", hits(SQL_INJECTION)).withColumn("xss_patterns", hits(XSS)).withColumn("sql_injection", F.size("sql_patterns") > 0).withColumn("xss", F.size("xss_patterns") > 0)


def cond_relevance(hits: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """(query_id, context): the texts of hits of more than least relevance, by rank."""
    kept = hits.filter(F.round("relevance", 6) > least)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda s: s[text]), "\n\n").alias("context"))


def append_docs(rows: DataFrame, as_of: str, source: str = "manual", title: str | None = None) -> DataFrame:
    """Rows (text, and title, source where given) as stored documents with id, timestamp and content_length."""
    at = F.lit(as_of).cast("timestamp")
    own = rows.withColumn("id", F.expr("uuid()")).withColumn("created_at", at).withColumn("content_length", F.length("text")).withColumn("ingest_date", F.to_date(at))
    return own.withColumns({c: F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v) for c, v in (("source", source), ("title", title or "Untitled"))})


def append_docs_meta(rows: DataFrame, defaults: dict[str, str], meta: str = "metadata") -> DataFrame:
    """metadata = defaults, overwritten by the row's own entries."""
    d = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    own = F.coalesce(F.col(meta), F.create_map().cast("map<string,string>"))
    return rows.withColumn(meta, F.map_concat(F.map_filter(d, lambda k, _: ~F.map_contains_key(own, k)), own))


def append_docs_checked(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """title cut to 500 and source to 100, blank texts refused, is_duplicate where a stored text has the same hash."""
    own = rows.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("title", F.substring("title", 1, 500)).withColumn("source", F.substring("source", 1, 100)).withColumn("_h", F.sha2("text", 256))
    known = stored.select(F.sha2("text", 256).alias("_h")).distinct().withColumn("_dup", F.lit(True))
    return own.join(known, "_h", "left").withColumn("is_duplicate", F.coalesce("_dup", F.lit(False))).drop("_h", "_dup")


def create_docs(rows: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows as completed documents, and the others with their violations."""
    own = validate_docs(rows)
    good = own.filter(F.size("violations") == 0).drop("violations").withColumn("text", strip(F.col("text"))).withColumn("title", strip(F.col("title"))).withColumn("status", F.lit("completed")).withColumn("created_at", F.lit(as_of).cast("timestamp"))
    return good, own.filter(F.size("violations") > 0).withColumn("status", F.lit("failed"))


def write_docs(docs: DataFrame, path: str) -> None:
    """Appends to a parquet table partitioned by ingest_date."""
    docs.write.mode("append").partitionBy("ingest_date").parquet(path)


def document_metadata(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_length", F.length("text")).withColumn("word_count", F.size(words(F.col("text")))).withColumn("content_hash", F.sha2("text", 256))
