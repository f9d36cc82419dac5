"""Queries of files: written from the given tables into the shared folder, and read back by the sources under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense, evaluate
from ..operators.dedupe import file_dedupe as dedupe_files
from ..sources import ingest, tabular
from ..sources.shared import shared_path
from .content import _RISKY
from .corpus import _risky, docs, notes
from .inputs import read
from .retrieval import asked, corpus


def _note_files(spark, sf_dir):
    """A text file for each note, and a JSON file for every third."""
    folder = shared_path(spark, "files")
    own = notes(spark, sf_dir).select("doc_id", "text")
    own.repartition("doc_id").write.partitionBy("doc_id").text(f"{folder}/notes")
    own.filter("doc_id % 3 = 0").repartition("doc_id").write.partitionBy("doc_id").json(f"{folder}/more")
    return folder


def _doc_id():
    return F.regexp_extract("path", r"doc_id=(\d+)/", 1).cast("long").alias("doc_id")


def scan_text_files(spark, sf_dir):
    files = tabular.scan_text_files(spark, f"{_note_files(spark, sf_dir)}/notes")
    return files.select(_doc_id(), "size", "format", F.sha2("text", 256).alias("text"))


def scan_dir(spark, sf_dir):
    files = tabular.scan_dir(spark, _note_files(spark, sf_dir)).filter(F.col("path").contains("doc_id="))
    return files.select(_doc_id(), "status").groupBy("doc_id", "status").agg(F.count("*").alias("n"))


def csv_as_text_doc(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("path"), F.col("c_custkey").alias("line_no"), F.col("c_name").alias("Customer Name"), F.col("c_mktsegment").alias("Segment"))
    return ingest.csv_as_text_doc(rows).select("path", F.sha2("text", 256).alias("text"), "row_count", "column_count")


def ingest_pipeline(spark, sf_dir):
    """The first half of the documents is in the store when all of them are ingested."""
    store, own = shared_path(spark, "store"), docs(spark, sf_dir).select("doc_id", "text")
    ingest.ingest_pipeline(own.filter("doc_id % 2 = 0"), store, "fixed", size=128, overlap=16, min_tokens=20)
    run = ingest.ingest_pipeline(own, store, "fixed", size=128, overlap=16, min_tokens=20)
    chunks = spark.read.parquet(f"{store}/chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    return run.join(chunks, "doc_id", "left").select("doc_id", "status", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def persist_index(spark, sf_dir):
    """Built at the first call, found at the second, and searched."""
    own, folder = docs(spark, sf_dir), shared_path(spark, "index")
    tabular.persist_index(own, folder)
    post, _ = tabular.persist_index(own, folder)
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def load_golden(spark, sf_dir):
    path = shared_path(spark, "golden")
    made = tabular.gen_golden(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    made.select(F.col("qa").alias("id"), "question", "answer", F.array("relevant_doc").alias("relevant_docs"), F.create_map(F.lit("difficulty"), F.col("difficulty")).alias("metadata")).write.json(path)
    return tabular.load_golden(spark, path, multi_line=False).select("id", "question", F.col("relevant_docs")[0].alias("relevant_doc"), F.col("metadata")["difficulty"].alias("difficulty"))


def extract_text_by_type(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("text/plain", "text/csv", "application/octet-stream"))), (F.col("doc_id") % 3 + 1).cast("int"))
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 3 == 2, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return _risky(spark, sf_dir).select("doc_id", F.sha2(tabular.extract_text_by_type(content, kind), 256).alias("text"))


def file_dedupe(spark, sf_dir):
    files = docs(spark, sf_dir).select(F.format_string("f%010d", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return dedupe_files(files).select("path", "sha256", F.col("size").cast("long").alias("size"), "is_duplicate")


def _graded(spark, sf_dir):
    v = corpus(spark, sf_dir)
    hits = dense.knn(v, asked(v), 10).select("query_id", "doc_id", "rank", "score")
    return v, hits


def retriever_bench(spark, sf_dir):
    """Cosine and dot product over the same queries: results, scores and shared results with cosine."""
    v, exact = _graded(spark, sf_dir)
    dot = dense.knn(v, asked(v), 10, "dot").select("query_id", "doc_id", "rank", "score")
    return evaluate.retriever_bench({"cosine": exact, "dot": dot}, "cosine").select("method", "queries", "results", F.round("mean_score", 6).alias("mean_score"), F.round("overlap", 6).alias("overlap"))


def export_eval(spark, sf_dir):
    path = shared_path(spark, "eval")
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.struct((F.col("c_custkey") % 7).alias("hits"), F.col("c_mktsegment").alias("mode")).alias("retrieval"))
    tabular.export_csv(own, path)
    return spark.read.csv(path, header=True, schema="run_id long, retrieval_hits long, retrieval_mode string")


def export_monitoring(spark, sf_dir):
    path = shared_path(spark, "monitoring")
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    ingest.export_monitoring({"metrics": e.filter("event_type <> 'error'"), "alerts": e.filter("event_type = 'error'")}, path, "2024-01-05 00:00:00", 72)
    read_back = lambda name: spark.read.schema("event_id long, ts timestamp, event_type string").json(f"{path}/{name}").withColumn("part", F.lit(name))
    return read_back("metrics").unionByName(read_back("alerts")).select("event_id", "event_type", "part")


_CHUNKS = """n as (select doc_id, length(text) // 4 as n, text from documents),
c as (select doc_id, least(n, i + 128) - case when i > 0 then greatest(0, i - 16) else 0 end as t from (select doc_id, n, unnest(range(0, n, 112)) as i from n where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')),
k as (select doc_id, count(*) as chunks, cast(sum(t) as bigint) as tokens from c where t >= 20 group by doc_id)"""
SQL = {
    "scan_text_files": "select doc_id, length(text) + 1 as size, 'txt' as format, sha256(text || chr(10)) as text from notes",
    "scan_dir": "select doc_id, 'processed' as status, 1 as n from notes union all select doc_id, 'skipped', 1 from notes where doc_id % 3 = 0",
    "csv_as_text_doc": """select 'nation-' || c_nationkey || '.csv' as path, count(*) as row_count, 2 as column_count,
      sha256('CSV data from nation-' || c_nationkey || '.csv:' || chr(10) || chr(10) || 'Columns: customer_name, segment' || chr(10) || chr(10) || string_agg(c_name || ' | ' || c_mktsegment, chr(10) order by c_custkey)) as text from customer group by c_nationkey""",
    "ingest_pipeline": f"""with {_CHUNKS}, f as (select doc_id, min(doc_id) over (partition by text) as first, min(case when doc_id % 2 = 0 then doc_id end) over (partition by text) as even from documents)
      select f.doc_id, case when even is not null then 'known' when f.doc_id = first then 'new' else 'duplicate' end as status,
             case when f.doc_id = coalesce(even, first) then coalesce(chunks, 0) else 0 end as chunks, case when f.doc_id = coalesce(even, first) then coalesce(tokens, 0) else 0 end as tokens
      from f left join k on f.doc_id = k.doc_id""",
    "persist_index": r"""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from t group by term""",
    "load_golden": "select printf('qa_%04d', c_custkey) as id, ['What is topic ' || c_custkey || '?', 'How does process ' || c_custkey || ' work?', 'Why is metric ' || c_custkey || ' important?'][c_custkey % 3 + 1] as question, 'doc_' || c_custkey as relevant_doc, ['easy', 'medium', 'hard'][c_custkey % 3 + 1] as difficulty from customer",
    "extract_text_by_type": f"with {_RISKY} select doc_id, sha256(t) as text from risky",
    "file_dedupe": "select printf('f%010d', doc_id) as path, sha256(text) as sha256, strlen(text) as size, row_number() over (partition by text order by doc_id) > 1 as is_duplicate from documents",
    "retriever_bench": """with v as (select vec_id as doc_id, cast(embedding as double[]) as vec from embeddings),
      p as (select q.doc_id as query_id, v.doc_id, list_cosine_similarity(q.vec, v.vec) as cosine, list_dot_product(q.vec, v.vec) as dot from v q, v where q.doc_id % 20 = 0),
      h as (select 'cosine' as method, query_id, doc_id, cosine as score from p qualify row_number() over (partition by query_id order by round(cosine, 6) desc, doc_id) <= 10
            union all select 'dot', query_id, doc_id, dot from p qualify row_number() over (partition by query_id order by round(dot, 6) desc, doc_id) <= 10)
      select h.method, count(distinct h.query_id) as queries, count(*) / count(distinct h.query_id) as results, round(avg(h.score), 6) as mean_score, round(count(c.doc_id) / count(*), 6) as overlap
      from h left join (select * from h where method = 'cosine') c on h.query_id = c.query_id and h.doc_id = c.doc_id group by h.method""",
    "export_eval": "select c_custkey as run_id, c_custkey % 7 as retrieval_hits, c_mktsegment as retrieval_mode from customer",
    "export_monitoring": "select event_id, event_type, case when event_type = 'error' then 'alerts' else 'metrics' end as part from events where ts <= timestamp '2024-01-05 00:00:00' and epoch(timestamp '2024-01-05 00:00:00') - epoch(date_trunc('second', ts)) <= 72 * 3600",
}
QUERIES = {f.__name__: f for f in (scan_text_files, scan_dir, csv_as_text_doc, ingest_pipeline, persist_index, load_golden, extract_text_by_type, file_dedupe, retriever_bench, export_eval, export_monitoring)}
