"""Queries of chunking, stored documents, duplicates and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import dedupe as D
from ..operators import dense
from ..operators import hooks as H
from ..operators import stats as S
from ..operators import store as T
from .inputs import read
from .quality import interactions
from .retrieval import asked, corpus

AS_OF = "1998-04-01 00:00:00"


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def notes(spark, sf_dir):
    return read(spark, sf_dir, "notes")


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _longs(df):
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def count_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", C.count_tokens(F.col("text")).alias("tokens"))


def _bounds(name, f, prepare=lambda c: c):
    def query(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", F.array_join(f(prepare(F.col("text"))).cast("array<string>"), ",").alias("bounds"))

    query.__name__ = name
    return query


sentence_bounds = _bounds("sentence_bounds", C.sentence_bounds)
paragraph_bounds = _bounds("paragraph_bounds", C.paragraph_bounds, lambda c: F.replace(c, F.lit("\n"), F.lit("\n\n")))


def section_bounds(spark, sf_dir):
    own = docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return own.select("doc_id", F.array_join(C.section_bounds(F.col("text")).cast("array<string>"), ",").alias("bounds"))


def chunk_fixed(spark, sf_dir):
    return _longs(C.chunk_documents(docs(spark, sf_dir), "fixed", 128, 16, min_tokens=20)).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content"), "token_count", "char_start", "char_end")


def chunk_sentences(spark, sf_dir):
    return _longs(C.chunk_documents(docs(spark, sf_dir), "sentences", max_tokens=256)).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content"), "token_count", "char_start", "char_end")


def _paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def chunk_by_bounds(spark, sf_dir):
    return _longs(C.chunk_by_bounds(_paragraphs(spark, sf_dir), C.paragraph_bounds(F.col("text")), "paragraph", 256)).select("doc_id", "chunk_index", "token_count", "char_start", "char_end")


def chunk_hybrid(spark, sf_dir):
    return _longs(C.chunk_documents(_paragraphs(spark, sf_dir), "hybrid", max_tokens=256)).select("doc_id", "chunk_index", "chunk_type", F.sha2("content", 256).alias("content"), "token_count", "char_start")


def chunk_documents(spark, sf_dir):
    return C.chunk_documents(docs(spark, sf_dir), "semantic").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


#: Code points of a chunk of the registered chunker.
WINDOW = 400


def chunk_table_function(spark, sf_dir):
    """A chunker of fixed windows, registered and called from SQL by a lateral join."""
    H.register_chunker(spark, "quern_windows", lambda text: [text[k : k + WINDOW] for k in range(0, len(text), WINDOW)])
    docs(spark, sf_dir).createOrReplaceTempView("quern_documents")
    return spark.sql("""select d.doc_id, cast(c.chunk_index as bigint) as chunk_index, length(c.content) as n, sha2(c.content, 256) as content_sha256
                        from quern_documents d, lateral quern_windows(d.text) c""").withColumn("n", F.col("n").cast("long"))


def chunk_context(spark, sf_dir):
    made = C.chunk_documents(docs(spark, sf_dir), "sentences", max_tokens=256)
    return _longs(C.chunk_context(made)).select("doc_id", "chunk_index", F.sha2("context", 256).alias("context"))


def chunk_stats(spark, sf_dir):
    d = docs(spark, sf_dir)
    return _rounded(C.chunk_stats(C.chunk_documents(d, "sentences", max_tokens=256), d))


def get_by_id(spark, sf_dir):
    return T.get_by_id(docs(spark, sf_dir), 7).select("doc_id", F.sha2("text", 256).alias("text"))


def list_preview(spark, sf_dir):
    return T.list_preview(docs(spark, sf_dir)).select("doc_id", "preview")


def list_page(spark, sf_dir):
    return _longs(T.list_page(docs(spark, sf_dir), 20, 40)).select("doc_id", "content_length")


def _ids(spark, sf_dir):
    return read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")


def delete_by_id(spark, sf_dir):
    return T.delete_by_id(docs(spark, sf_dir), _ids(spark, sf_dir)).select("doc_id")


def delete_by_filter(spark, sf_dir):
    stays, gone = T.delete_by_filter(docs(spark, sf_dir), F.col("lang") == "fr")
    return stays.agg(F.count("*").alias("stays")).join(F.broadcast(gone))


def _versioned(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("updated_at", F.lit("1990-01-01 00:00:00").cast("timestamp"))


def upsert_docs(spark, sf_dir):
    new = docs(spark, sf_dir).filter("doc_id % 5 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("new").alias("text"), "source", "lang")
    out = T.upsert_docs(_versioned(spark, sf_dir), new, AS_OF)
    return out.select("doc_id", F.substring("text", 1, 20).alias("head"), F.year("updated_at").cast("long").alias("y"))


def patch_docs(spark, sf_dir):
    p = docs(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "patched").alias("text"), F.lit("moved").alias("source"))
    return T.patch_docs(_versioned(spark, sf_dir), p, ("text", "source"), AS_OF).select("doc_id", F.substring("text", 1, 20).alias("head"), "source", F.year("updated_at").cast("long").alias("y"))


def _outcomes(spark, sf_dir):
    return read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"), F.when(F.col("quality") == 0, "bad").alias("error"))


def doc_status(spark, sf_dir):
    return T.doc_status(docs(spark, sf_dir), _outcomes(spark, sf_dir)).select("doc_id", "status", "error")


def delete_file_cascade(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"))
    own = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"), "l_orderkey")
    f, d = T.delete_file_cascade(files, own, files.filter("file_id % 7 = 0"))
    return f.agg(F.count("*").alias("files")).join(F.broadcast(d.agg(F.count("*").alias("docs"))))


def _risky(spark, sf_dir):
    k = F.col("doc_id") % 6
    tail = F.when(k == 0, " <script>alert(1)</script> <b>x</b>").when(k == 1, " eval(1); http://bit.ly/a1 <p class='c'>y</p>").when(k == 2, " drop table x; -- http://127.0.0.1/x").when(k == 3, "' or 1 = 1 http://10.0.0.1/admin/password=secret").when(k == 4, " powershell http://very-long-name-of-a-host-that-goes-on-and-on-for-ever.example.com/").otherwise("")
    return notes(spark, sf_dir).withColumn("text", F.concat("text", tail))


def validate_docs(spark, sf_dir):
    own = _risky(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("title")))
    return T.validate_docs(own).select("doc_id", F.array_join("violations", "|").alias("violations"))


def validate_queries(spark, sf_dir):
    q = read(spark, sf_dir, "query_log").select("query_id", F.when(F.col("query_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), F.when(F.col("query_id") % 3 == 0, F.lit(None)).otherwise(F.col("query_id") % 70).cast("int").alias("k"))
    return _longs(T.validate_queries(q)).select("query_id", "text", "k", "error")


def validate_uploads(spark, sf_dir):
    own = _risky(spark, sf_dir).select("doc_id", "title", "text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    return T.validate_uploads(own).select("doc_id", "title", "source", F.sha2("text", 256).alias("text"), "error")


def validate_strings(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.col("c_name")).alias("name"), F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "@example.com").otherwise("")).alias("mail"), (F.col("c_custkey") % 130).cast("string").alias("age"))
    out = T.validate_strings(c, {"name": {"required": True, "max": 18}, "mail": {"email": True}, "age": {"low": 1, "high": 120}})
    return out.select("c_custkey", *(F.col("errors")[n].alias(f"{n}_error") for n in ("name", "mail", "age")))


def validate_payload_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "not json").when(F.col("event_id") % 10 == 1, '{"x": 1}').otherwise(F.col("props")).alias("p"))
    return T.validate_payload_rows(e, "p", ("k",)).select("event_id", "error")


def flag_injection(spark, sf_dir):
    return T.flag_injection(_risky(spark, sf_dir)).select("doc_id", "sql_injection", "xss", F.array_join("sql_patterns", ",").alias("sql_patterns"), F.array_join("xss_patterns", ",").alias("xss_patterns"))


def strip_html(spark, sf_dir):
    return _risky(spark, sf_dir).select("doc_id", F.sha2(T.strip_html(F.col("text")), 256).alias("text"))


def cond_relevance(spark, sf_dir):
    v = corpus(spark, sf_dir)
    hits = dense.with_relevance(dense.knn_cosine(v, asked(v), 5)).withColumn("text", F.concat(F.lit("v"), "doc_id"))
    return T.cond_relevance(hits, 0.15)


def append_docs(spark, sf_dir):
    out = T.append_docs(docs(spark, sf_dir).select("doc_id", "text"), AS_OF)
    return _longs(out).select("doc_id", "title", "source", "content_length", F.length("id").cast("long").alias("id_length"))


def append_docs_meta(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("metadata"))
    out = T.append_docs_meta(own, {"source": "api", "kind": "text"})
    return out.select("doc_id", *(F.col("metadata")[k].alias(k) for k in ("lang", "source", "kind")))


def append_docs_checked(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("title", F.repeat("source", 120)).withColumn("source", F.repeat("source", 40)).withColumn("text", F.when(F.col("doc_id") % 13 == 0, "  ").otherwise(F.col("text")))
    out = T.append_docs_checked(d, docs(spark, sf_dir).filter("doc_id < 100"))
    return _longs(out.select("doc_id", F.length("title").alias("title"), F.length("source").alias("source"), "is_duplicate"))


def create_docs(spark, sf_dir):
    good, bad = T.create_docs(_risky(spark, sf_dir), AS_OF)
    return good.select("doc_id", "status").union(bad.select("doc_id", "status"))


def document_metadata(spark, sf_dir):
    return _longs(T.document_metadata(docs(spark, sf_dir)).select("doc_id", "content_length", "word_count", "content_hash"))


def dedupe_exact(spark, sf_dir):
    d = docs(spark, sf_dir)
    ledger = d.filter("doc_id % 50 = 0").select(D.content_hash().alias("content_hash"))
    return D.dedupe_exact(d, ledger).select("doc_id", "content_hash")


def processed_ledger(spark, sf_dir):
    d = docs(spark, sf_dir)
    return D.processed_ledger(d.filter("doc_id < 500").select(D.content_hash().alias("content_hash")), d.filter("doc_id >= 400"))


def dup_by_hash(spark, sf_dir):
    d = docs(spark, sf_dir)
    return D.dup_by_hash(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).select("doc_id")


def near_dup(spark, sf_dir):
    v = corpus(spark, sf_dir)
    moved = v.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.transform("vec", lambda x: x + F.when(F.col("doc_id") % 2 == 0, 0.01).otherwise(0.4)).alias("vec"), "label").filter("doc_id % 20 = 0")
    return _rounded(D.near_dup(moved.select(F.col("doc_id").alias("query_id"), "vec"), v))


def doc_count(spark, sf_dir):
    return S.doc_count(docs(spark, sf_dir))


def collection_stats(spark, sf_dir):
    one = S.collection_stats(notes(spark, sf_dir))
    return _rounded(_longs(one.select("n", "mean_length", "min_length", "max_length", "total_length", F.col("sources")["asia"].alias("asia"), F.year("newest").alias("newest"))))


def collection_status(spark, sf_dir):
    return S.collection_status(docs(spark, sf_dir), ("lang", "source")).select("n", F.array_join("langs", ",").alias("langs"), F.size("sources").cast("long").alias("sources"))


def document_stats(spark, sf_dir):
    return S.document_stats(notes(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("completed")), "1998-01-02")


def file_stats(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("u"), (F.col("o_custkey") % 3).cast("string"))).alias("user"), F.col("o_orderkey").alias("size"))
    return S.file_stats(o)


def latency_stats(spark, sf_dir):
    return _rounded(S.latency_stats(read(spark, sf_dir, "events").select("ts", F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))))


def ingest_stats(spark, sf_dir):
    own = T.validate_docs(_risky(spark, sf_dir)).select(F.get("violations", F.lit(0)).alias("error"))
    return S.ingest_stats(own).select("documents", "errors", F.array_join("details", "|").alias("details"))


def pipeline_stats(spark, sf_dir):
    i = interactions(spark, sf_dir).select(F.when(F.col("id") % 2 == 0, F.array(F.lit("quantize"), F.lit("domain"))).otherwise(F.array(F.lit("domain"))).alias("steps"), F.col("balance").alias("ms"), F.col("n").alias("texts"))
    return _rounded(S.pipeline_stats(i))


def cache_log_stats(spark, sf_dir):
    return _rounded(S.cache_log_stats(read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (F.col("value") > 20).alias("hit"))))


def event_log(spark, sf_dir):
    return S.event_log(read(spark, sf_dir, "events")).select(F.unix_timestamp("hour").alias("hour"), "event_type", "n")


def _pack(text, pattern, cap, low, kind):
    """Recursive packing of segments by SQL: a row a segment, folded in order."""
    return f"""with recursive d as (select doc_id, {text} as text from documents),
seg as (select doc_id, i, s, sum(length(s)) over (partition by doc_id order by i) as e from (select doc_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as s from (select doc_id, list_filter(string_split(regexp_replace(text, '({pattern})', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as p from d))),
last as (select doc_id, max(i) as n from seg group by doc_id),
f as (select doc_id, cast(1 as bigint) as i, cast(0 as hugeint) as st, cast(e as hugeint) as en, false as cut, cast(0 as hugeint) as pst, cast(0 as hugeint) as pen from seg where i = 1
  union all select f.doc_id, seg.i, case when (seg.e - f.st) // 4 <= {cap} then f.st else f.en end, seg.e, (seg.e - f.st) // 4 > {cap}, f.st, f.en from f join seg on f.doc_id = seg.doc_id and seg.i = f.i + 1),
packs as (select doc_id, pst as a, pen as b from f where cut union all select f.doc_id, st, en from f join last on f.doc_id = last.doc_id and f.i = last.n),
chunks as (select packs.doc_id, row_number() over (partition by packs.doc_id order by a) - 1 as chunk_index, regexp_replace(substr(text, cast(a + 1 as bigint), cast(b - a as bigint)), '^\\s+|\\s+$', '', 'g') as content, '{kind}' as chunk_type, cast((b - a) // 4 as bigint) as token_count, cast(a as bigint) as char_start, cast(b as bigint) as char_end
  from packs join d on packs.doc_id = d.doc_id where (b - a) // 4 >= {low} and regexp_replace(substr(text, cast(a + 1 as bigint), cast(b - a as bigint)), '^\\s+|\\s+$', '', 'g') <> '')"""


_SENT = _pack("text", r"[.!?]+\s+", 256, 50, "sentence_boundary")
_PARA = _pack("replace(text, chr(10), chr(10) || chr(10))", r"\n\s*\n", 256, 50, "paragraph")
_SPLIT = "list_filter(string_split(regexp_replace({0}, '({1})', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_RISKY = """risky as (select *, text || case doc_id % 6 when 0 then ' <script>alert(1)</script> <b>x</b>' when 1 then ' eval(1); http://bit.ly/a1 <p class=''c''>y</p>' when 2 then ' drop table x; -- http://127.0.0.1/x'
  when 3 then ''' or 1 = 1 http://10.0.0.1/admin/password=secret' when 4 then ' powershell http://very-long-name-of-a-host-that-goes-on-and-on-for-ever.example.com/' else '' end as t from notes)"""


def _flags(ps):
    return "array_to_string(list_filter([" + ", ".join("case when regexp_matches(t, '(?is)" + p.replace("'", "''") + f"') then {i} end" for i, p in enumerate(ps)) + "], lambda x: x is not null), ',')"


def _bsql(text, pattern):
    return f"""with p as (select doc_id, {_SPLIT.format(text, pattern)} as p from documents),
      s as (select doc_id, i, sum(length(s)) over (partition by doc_id order by i) as e from (select doc_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as s from p))
      select p.doc_id, '0' || coalesce(',' || string_agg(cast(e as varchar), ',' order by i), '') as bounds from p left join s on p.doc_id = s.doc_id group by p.doc_id"""


SQL = {
    "count_tokens": "select doc_id, length(text) // 4 as tokens from documents",
    "sentence_bounds": _bsql("text", r"[.!?]+\s+"),
    "paragraph_bounds": _bsql("replace(text, chr(10), chr(10) || chr(10))", r"\n\s*\n"),
    "chunk_fixed": r"""with w as (select doc_id, text, length(text) // 4 as n, unnest(range(0, length(text) // 4, 112)) as i from documents),
      b as (select doc_id, text, i, case when i > 0 then greatest(0, i - 16) else 0 end as s, least(n, i + 128) as e from w)
      select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_index, sha256(regexp_replace(substr(text, s * 4 + 1, (e - s) * 4), '^\s+|\s+$', '', 'g')) as content, e - s as token_count, s * 4 as char_start, e * 4 as char_end from b where e - s >= 20 and trim(text) <> ''""",
    "chunk_sentences": f"{_SENT} select doc_id, chunk_index, sha256(content) as content, token_count, char_start, char_end from chunks",
    "chunk_by_bounds": f"{_PARA} select doc_id, chunk_index, token_count, char_start, char_end from chunks",
    "chunk_context": f"{_SENT} select doc_id, chunk_index, sha256(string_agg(content, chr(10) || chr(10)) over (partition by doc_id order by chunk_index rows between 1 preceding and 1 following)) as context from chunks",
    "chunk_stats": f"{_SENT} select count(*) as chunks, cast(sum(token_count) as bigint) as tokens, min(token_count) as min_tokens, max(token_count) as max_tokens, round(avg(token_count), 6) as mean_tokens, round(avg(length(content)), 6) as mean_length, cast(sum(char_end - char_start) as bigint) as covered, (select cast(sum(length(text)) as bigint) from documents) as chars, round(sum(char_end - char_start) / (select sum(length(text)) from documents), 6) as kept from chunks",
    "get_by_id": "select doc_id, sha256(text) as text from documents where doc_id = 7",
    "list_preview": "select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from documents",
    "list_page": "select doc_id, length(text) as content_length from documents order by doc_id limit 20 offset 40",
    "delete_by_id": "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 0)",
    "delete_by_filter": "select count(*) filter (where lang <> 'fr') as stays, count(*) filter (where lang = 'fr') as deleted from documents",
    "upsert_docs": "with n as (select doc_id * 2 as doc_id from documents where doc_id % 5 = 0) select doc_id, substr(text, 1, 20) as head, cast(1990 as bigint) as y from documents where doc_id not in (select doc_id from n) union all select doc_id, 'new', 1998 from n",
    "patch_docs": "select doc_id, case when doc_id % 6 = 0 then 'patched' else substr(text, 1, 20) end as head, case when doc_id % 3 = 0 then 'moved' else source end as source, cast(case when doc_id % 3 = 0 then 1998 else 1990 end as bigint) as y from documents",
    "doc_status": "select d.doc_id, case when l.doc_id is null then 'pending' when quality = 1 then 'completed' else 'failed' end as status, case when quality = 0 then 'bad' end as error from documents d left join labels l on d.doc_id = l.doc_id",
    "delete_file_cascade": "select (select count(*) from part where p_partkey % 7 <> 0) as files, (select count(*) from lineitem where l_partkey % 7 <> 0) as docs",
    "validate_docs": f"with {_RISKY} select doc_id, concat_ws('|', case when doc_id % 10 = 0 then 'title required' end, case when contains(lower(t), '<script') then 'forbidden <script' end, case when contains(lower(t), 'javascript:') then 'forbidden javascript:' end, case when contains(lower(t), 'eval(') then 'forbidden eval(' end, case when contains(lower(t), 'exec(') then 'forbidden exec(' end) as violations from risky",
    "validate_queries": "select query_id, case when query_id % 11 = 0 then '' else trim(text) end as text, coalesce(case when query_id % 3 <> 0 then query_id % 70 end, 10) as k, case when query_id % 11 = 0 then 'query required' when length(trim(text)) > 1000 then 'query too long' when coalesce(case when query_id % 3 <> 0 then query_id % 70 end, 10) not between 1 and 50 then 'limit out of range' end as error from query_log",
    "validate_uploads": f"with {_RISKY} select doc_id, title, case when doc_id % 2 = 0 then source else 'api' end as source, sha256(trim(regexp_replace(t, '<[^<>]*>', '', 'g'))) as text, cast(null as varchar) as error from risky",
    "validate_strings": """select c_custkey, case when c_custkey % 9 = 0 then 'required' when length(c_name) > 18 then 'at most 18 characters' end as name_error, case when c_custkey % 2 = 1 then 'invalid format' end as mail_error, case when c_custkey % 130 not between 1 and 120 then 'out of range' end as age_error from customer""",
    "validate_payload_rows": "select event_id, case when event_id % 10 = 0 then 'invalid json' when event_id % 10 = 1 then 'missing k' end as error from events",
    "flag_injection": f"with {_RISKY}, f as (select doc_id, {_flags(T.SQL_INJECTION)} as sql_patterns, {_flags(T.XSS)} as xss_patterns from risky) select doc_id, sql_patterns <> '' as sql_injection, xss_patterns <> '' as xss, sql_patterns, xss_patterns from f",
    "strip_html": f"with {_RISKY} select doc_id, sha256(replace(replace(regexp_replace(regexp_replace(t, '<(/?)(p|br|strong|em|u|ol|ul|li|h1|h2|h3|h4|h5|h6|blockquote|code|pre)(?:\\s[^<>]*)?/?>', chr(1) || '\\1\\2' || chr(2), 'gi'), '<[^<>]*>', '', 'g'), chr(1), '<'), chr(2), '>')) as text from risky",
    "cond_relevance": """with v as (select vec_id as doc_id, cast(embedding as double[]) as vec from embeddings), h as (select q.doc_id as query_id, v.doc_id, list_cosine_similarity(q.vec, v.vec) as s from v q, v where q.doc_id % 20 = 0),
      r as (select *, row_number() over (partition by query_id order by round(s, 6) desc, doc_id) as rank from h qualify rank <= 5)
      select query_id, string_agg('v' || doc_id, chr(10) || chr(10) order by rank) as context from r where round(greatest(0, least(1, s)), 6) > 0.15 group by query_id""",
    "append_docs": "select doc_id, 'Untitled' as title, 'manual' as source, length(text) as content_length, cast(36 as bigint) as id_length from documents",
    "append_docs_meta": "select doc_id, case when doc_id % 2 = 0 then lang end as lang, case when doc_id % 2 = 0 then source else 'api' end as source, 'text' as kind from documents",
    "append_docs_checked": "select doc_id, least(500, length(source) * 120) as title, least(100, length(source) * 40) as source, text in (select text from documents where doc_id < 100) as is_duplicate from documents where doc_id % 13 <> 0",
    "create_docs": f"with {_RISKY} select doc_id, case when contains(lower(t), '<script') or contains(lower(t), 'javascript:') or contains(lower(t), 'eval(') or contains(lower(t), 'exec(') then 'failed' else 'completed' end as status from risky",
    "document_metadata": r"select doc_id, length(text) as content_length, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as word_count, sha256(text) as content_hash from documents",
    "dedupe_exact": "select min(doc_id) as doc_id, sha256(text) as content_hash from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 50 = 0) group by sha256(text)",
    "processed_ledger": "select distinct sha256(text) as content_hash from documents",
    "dup_by_hash": "select doc_id from documents where doc_id % 2 = 1 and text in (select text from documents where doc_id % 2 = 0)",
    "doc_count": "select count(*) as n from documents",
    "collection_stats": "select count(*) as n, round(avg(length(text)), 6) as mean_length, min(length(text)) as min_length, max(length(text)) as max_length, cast(sum(length(text)) as bigint) as total_length, count(*) filter (where source = 'asia') as asia, max(year(created_at)) as newest from notes",
    "collection_status": "select count(*) as n, (select string_agg(lang, ',' order by lang) from (select distinct lang from documents)) as langs, count(distinct source) as sources from documents",
    "document_stats": """with s as (select *, case when doc_id % 3 = 0 then 'failed' else 'completed' end as status from notes)
      select 'total' as kind, '' as value, count(*) as n from s union all select 'today', '', count(*) from s where cast(created_at as date) = date '1998-01-02' union all select 'status', status, count(*) from s group by status union all select 'source', source, count(*) from s group by source""",
    "file_stats": """with f as (select o_orderpriority as type, o_orderstatus as status, case when o_custkey % 3 > 0 then 'u' || (o_custkey % 3) else 'anonymous' end as u, o_orderkey as size from orders)
      select 'type' as kind, type as value, count(*) as n, cast(sum(size) as bigint) as bytes from f group by type union all select 'status', status, count(*), cast(sum(size) as bigint) from f group by status union all select 'user', u, count(*), cast(sum(size) as bigint) from f group by u union all select 'total', '', count(*), cast(sum(size) as bigint) from f""",
    "latency_stats": """select count(*) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99,
      round(avg(case when event_type <> 'error' then 1 else 0 end), 6) as success_rate, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 6) as qps from events""",
    "ingest_stats": f"""with {_RISKY}, v as (select case when contains(lower(t), '<script') then 'forbidden <script' when contains(lower(t), 'javascript:') then 'forbidden javascript:' when contains(lower(t), 'eval(') then 'forbidden eval(' when contains(lower(t), 'exec(') then 'forbidden exec(' end as error from risky)
      select count(*) filter (where error is null) as documents, count(*) filter (where error is not null) as errors, (select string_agg(error || ':' || n, '|' order by error) from (select error, count(*) as n from v where error is not null group by error)) as details from v""",
    "pipeline_stats": "select case when id % 2 = 0 then 'domain_quantize' else 'domain' end as combination, count(*) as uses, round(sum(balance), 6) as total_ms, round(avg(balance), 6) as mean_ms, cast(sum(n) as bigint) as texts from interactions group by 1",
    "cache_log_stats": "select event_type as type, count(*) as requests, count(*) filter (where value > 20) as hits, round(avg(case when value > 20 then 1 else 0 end), 6) as hit_rate from events group by 1",
    "event_log": "select cast(floor(epoch(date_trunc('hour', ts))) as bigint) as hour, event_type, count(*) as n from events group by 1, 2",
}


def _hybrid(text, cap):
    """Chunks by paragraphs where a text has two and they give a chunk, else by sentences."""
    para, sent = _pack(text, r"\n\s*\n", cap, 50, "paragraph"), _pack(text, r"[.!?]+\s+", cap, 50, "sentence_boundary")
    return f"""with n as (select doc_id, count(*) as parts from ({para} select * from seg) group by doc_id), para as ({para} select * from chunks), sent as ({sent} select * from chunks),
own as (select para.* from para join n using (doc_id) where parts >= 2)
select * from own union all select * from sent where doc_id not in (select doc_id from own)"""


SQL |= {
    "chunk_hybrid": f"select doc_id, chunk_index, chunk_type, sha256(content) as content, token_count, char_start from ({_hybrid('replace(text, chr(10), chr(10) || chr(10))', 256)})",
    "chunk_documents": f"select doc_id, count(*) as chunks, cast(sum(token_count) as bigint) as tokens from ({_hybrid('text', 1024)}) group by doc_id",
}
SQL["chunk_table_function"] = f"""with w as (select doc_id, text, unnest(range((length(text) + {WINDOW - 1}) // {WINDOW})) as chunk_index from documents),
c as (select doc_id, chunk_index, substr(text, chunk_index * {WINDOW} + 1, {WINDOW}) as content from w)
select doc_id, chunk_index, length(content) as n, sha256(content) as content_sha256 from c"""
QUERIES = {f.__name__: f for f in (count_tokens, sentence_bounds, paragraph_bounds, section_bounds, chunk_fixed, chunk_sentences, chunk_by_bounds, chunk_hybrid, chunk_documents, chunk_table_function, chunk_context, chunk_stats, get_by_id, list_preview, list_page, delete_by_id, delete_by_filter, upsert_docs, patch_docs, doc_status, delete_file_cascade, validate_docs, validate_queries, validate_uploads, validate_strings, validate_payload_rows, flag_injection, strip_html, cond_relevance, append_docs, append_docs_meta, append_docs_checked, create_docs, document_metadata, dedupe_exact, processed_ledger, dup_by_hash, near_dup, doc_count, collection_stats, collection_status, document_stats, file_stats, latency_stats, ingest_stats, pipeline_stats, cache_log_stats, event_log)}
