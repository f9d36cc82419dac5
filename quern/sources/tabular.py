"""Tables and files as documents: delimited files, row documents, html pages and directories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers of missing cells, delimiters, and the largest file.
NA = ("", "N/A", "NULL", "null", "nan")
DELIMITERS = (",", ";", "\t", "|")
MAX_BYTES = 50 << 20


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, format, text): one document a file."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    return raw.withColumn("format", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)))


def scan_dir(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "html", "csv")) -> DataFrame:
    """(path, size, content, status): every file below path, processed by extension or skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    return files.select("path", F.col("length").alias("size"), "content", F.when(ext.isin(*extensions), "processed").otherwise("skipped").alias("status"))


class _Page(HTMLParser):
    """Text outside scripts and styles, with title, description and author."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.meta, self.off, self.in_title = [], [], {}, 0, False

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in ("script", "style"):
            self.off += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (own.get("name") or "").lower() in ("description", "author"):
            self.meta[own["name"].lower()] = own.get("content") or ""

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.off = max(0, self.off - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.off and data.strip():
            self.parts.append(re.sub(r"\s+", " ", data.strip()))


def scan_html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text, title, description, author) of (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for html in pdf["html"]:
                p = _Page()
                p.feed(html or "")
                p.close()
                out.append(("\n".join(p.parts), "".join(p.title).strip(), p.meta.get("description"), p.meta.get("author")))
            yield pd.DataFrame({"page_id": pdf["page_id"], **{n: [o[i] for o in out] for i, n in enumerate(("text", "title", "description", "author"))}})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string, title string, description string, author string")


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """(path, delimiter) of files' lines (path, line_no, line): the same nonzero count on each of the first five lines, the highest total wins."""
    first = lines.filter(F.col("line_no") <= 5)
    counts = [F.length("line") - F.length(F.replace("line", F.lit(d), F.lit(""))) for d in DELIMITERS]
    aggs = [x for i, c in enumerate(counts) for x in (F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.sum(c).alias(f"s{i}"))]
    one = first.groupBy("path").agg(*aggs)
    scored = F.array(*(F.struct((-F.when((F.col(f"l{i}") == F.col(f"h{i}")) & (F.col(f"l{i}") > 0), F.col(f"s{i}")).otherwise(0)).alias("m"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))
    return one.select("path", F.array_min(scored)["d"].alias("delimiter"))


def scan_csv_auto(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, names cleaned, markers of missing cells as null."""
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape="\\", ignoreLeadingWhiteSpace=True, multiLine=True)
    named = clean_columns(raw)
    return named.select(*(F.when(~F.col(c).isin(*NA), F.col(c)).alias(c) for c in named.columns))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, else latin-1."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def clean_name(name: str | None) -> str:
    own = re.sub(r"[!@#$%^&*()+=\[\]{};':\"\\|,.<>?/~`]", "", (name or "").strip())
    return re.sub(r"\s+", "_", own).replace("-", "_").lower() or "unnamed_column"


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names cleaned; _2, _3 where names clash."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = clean_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def clean_cell(field: T.StructField) -> Column:
    """A cell as text: null is empty, times are formatted, blanks joined and control characters removed."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(field.dataType, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    else:
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "), r"[\x00-\x1f\x7f-\x9f]", "")
    return F.coalesce(text, F.lit(""))


def clean_cells(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(f.name) if f.name in keep else clean_cell(f).alias(f.name) for f in df.schema.fields))


def route_formats(files: DataFrame) -> DataFrame:
    """reader (csv, excel or null) and reason for files (name, size)."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    reader = F.when(F.col("size") <= MAX_BYTES, F.when(ext == "csv", "csv").when(ext.isin("xlsx", "xls"), "excel"))
    return files.withColumn("reader", reader).withColumn("reason", F.when(F.col("size") > MAX_BYTES, "too large").when(reader.isNull(), "unsupported"))


def extract_text_by_type(content: Column, kind: Column) -> Column:
    """Text and csv decoded, json indented again, other content decoded with bad bytes dropped."""
    text = decode_bytes(content)
    parsed = F.try_parse_json(text) if hasattr(F, "try_parse_json") else None
    pretty = F.to_json(parsed, {"pretty": "true"}) if parsed is not None else text
    return F.when(kind.contains("json"), F.coalesce(pretty, text)).when(kind.startswith("text"), text).otherwise(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit("")))


def row_text(df: DataFrame, keep: tuple[str, ...]) -> Column:
    """`col: value | col: value` of the filled cells, keep left out."""
    cells = [F.when(clean_cell(f) != "", F.concat(F.lit(f"{clean_name(f.name)}: "), clean_cell(f))) for f in df.schema.fields if f.name not in keep]
    return F.array_join(F.array_compact(F.array(*cells)), " | ")


def rows_to_docs(df: DataFrame, ordinal: str, chunk_rows: int = 1000, prefix: str = "") -> DataFrame:
    """(ordinal, text, metadata, chunk): one document a row with a filled cell; metadata col_* is cut to 100 characters."""
    fields = [f for f in df.schema.fields if f.name != ordinal]
    meta = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f"col_{clean_name(f.name)}").alias("key"), F.substring(clean_cell(f), 1, 100).alias("value")) for f in fields)), lambda e: e["value"] != ""))
    own = df.select(F.col(ordinal).alias("ordinal"), F.concat(F.lit(prefix), row_text(df, (ordinal,))).alias("text"), meta.alias("metadata"), F.floor(F.col(ordinal) / chunk_rows).alias("chunk"))
    return own.filter(F.col("text") != prefix)


def rows_to_docs_packed(df: DataFrame, ordinal: str, name: str, chunk_rows: int = 1000, key: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk, title, text, start_row, end_row): one document for each chunk_rows rows, lines in order."""
    keep = (ordinal, *key)
    own = df.select(*key, F.col(ordinal).alias("_o"), row_text(df, keep).alias("_t")).withColumn("chunk", F.floor(F.col("_o") / chunk_rows))
    line = F.when(F.col("_t") != "", F.struct("_o", F.concat(F.lit("[Row: "), (F.col("_o") + 1).cast("string"), F.lit("] "), "_t").alias("t")))
    one = own.groupBy(*key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n").alias("text"), (F.min("_o") + 1).alias("start_row"), (F.max("_o") + 1).alias("end_row"))
    parts = F.count("*").over(Window.partitionBy(*key)) if key else F.count("*").over(Window.partitionBy(F.lit(0)))
    label = F.concat(F.lit(name), *(F.concat(F.lit(" ("), F.col(k).cast("string"), F.lit(")")) for k in key))
    return one.filter("text <> ''").withColumn("title", F.when(parts == 1, label).otherwise(F.concat(label, F.lit(" - Part "), (F.col("chunk") + 1).cast("string"))))


def sheet_docs(df: DataFrame, sheet: str, ordinal: str, name: str) -> DataFrame:
    """Packed documents of several sheets, told apart by a column."""
    return rows_to_docs_packed(df, ordinal, name, key=(sheet,))


def load_golden(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Questions with answers from files of one JSON array each, or of a JSON row a line."""
    return spark.read.schema("id string, question string, answer string, relevant_docs array<string>, metadata map<string,string>").json(path, multiLine=multi_line)


#: (question, answer, difficulty) of the generated golden rows.
TEMPLATES = (("What is topic %d?", "Topic %d is described in document %d.", "easy"), ("How does process %d work?", "Process %d works as in document %d.", "medium"), ("Why is metric %d important?", "Metric %d matters as in document %d.", "hard"))


def gen_golden(rows: DataFrame) -> DataFrame:
    """rows (id) with a question on each from the templates in turn: qa, question, answer, relevant_doc, difficulty."""
    pick = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in TEMPLATES)), (F.col("id") % 3 + 1).cast("int"))
    number = lambda c: F.replace(c, F.lit("%d"), F.col("id").cast("string"))
    return rows.select("*", F.format_string("qa_%04d", "id").alias("qa"), number(pick(0)).alias("question"), number(pick(1)).alias("answer"), F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("relevant_doc"), pick(2).alias("difficulty"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Structs flattened to column_field."""
    flat = [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") if isinstance(f.dataType, T.StructType) else F.col(f.name) for f in df.schema.fields for g in (f.dataType.fields if isinstance(f.dataType, T.StructType) else [f])]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """One row: rows and an order-free sum of row hashes."""
    return docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def persist_index(docs: DataFrame, folder: str, force: bool = False) -> tuple[DataFrame, str]:
    """Postings under the corpus fingerprint, built only where absent or forced; the table and its path."""
    from ..operators.lexical import postings

    spark = docs.sparkSession
    path = f"{folder}/postings/corpus_hash={corpus_fingerprint(docs).first().fingerprint}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        postings(docs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path
