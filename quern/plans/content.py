"""Queries of embedding jobs, content scans, context assembly, the document graph, tabular sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import dense, factored, graph
from ..operators import embed as B
from ..operators import query_log as Q
from ..operators import scan as S
from ..operators.ranking import small_side
from ..sources import tabular as T
from ..sources.shared import kept, shared_path
from ..streaming import streams as R
from .corpus import _risky, docs, notes
from .inputs import read
from . import quality as Y
from .quality import feedback, interactions
from .retrieval import asked, corpus

AS_OF = "1998-12-31"


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _longs(df):
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def _summed(df, column):
    """Each row's array as a sum weighted by place."""
    return df.select("doc_id", F.posexplode(column).alias("i", "x")).groupBy("doc_id").agg(F.round(F.sum(F.col("x").cast("double") * (F.col("i") + 1)), 6).alias("weighted"))


# embedding jobs


def quantize_int8(spark, sf_dir):
    q = B.quantize_int8(corpus(spark, sf_dir))
    return _summed(q, "q").join(_rounded(q.select("doc_id", "scale", "norm")), "doc_id")


def quantize_binary(spark, sf_dir):
    return _summed(B.quantize_binary(corpus(spark, sf_dir)), "q")


def quantize(spark, sf_dir):
    return _summed(B.quantize(corpus(spark, sf_dir), "int8"), "q")


def dequantize(spark, sf_dir):
    return _summed(B.dequantize(B.quantize_int8(corpus(spark, sf_dir))), "vec")


def quantize_pq(spark, sf_dir):
    codes, book = B.quantize_pq(corpus(spark, sf_dir), centroids=64)
    return _summed(B.dequantize(codes, "pq", book), "vec")


def quantization_stats(spark, sf_dir):
    return _rounded(B.quantization_stats(corpus(spark, sf_dir)))


def quantization_bench(spark, sf_dir):
    return _rounded(B.quantization_bench(corpus(spark, sf_dir)))


def domain_vocabulary(spark, sf_dir):
    v = B.domain_vocabulary(docs(spark, sf_dir), "lang")
    return _rounded(v.select("lang", "documents", "words", "unique_words", "density", F.array_join("terms", " ").alias("terms")))


def _embeddings(spark, sf_dir):
    """An embedding of four numbers a document, from its id."""
    d = docs(spark, sf_dir)
    return d.withColumn("vec", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("doc_id") % (i + 3)).cast("double")))


def domain_boost(spark, sf_dir):
    own = B.domain_boost(_embeddings(spark, sf_dir), F.array(F.lit("the"), F.lit("de"), F.lit("of"), F.lit("der")))
    return _rounded(own.select("doc_id", "boost", F.col("vec")[0].alias("first")))


def domain_embeddings(spark, sf_dir):
    v = _embeddings(spark, sf_dir)
    words = B.domain_vocabulary(v.filter("lang <> 'de'"), "lang")
    return _rounded(B.domain_embeddings(v, words, "lang").select("doc_id", "boost"))


def keyword_vector(spark, sf_dir):
    from ..operators.fusion import keyword_vector as k

    return k(docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("slots"), F.sum("w").alias("total"))


def structural_vector(spark, sf_dir):
    return _summed(_risky(spark, sf_dir).select("doc_id", B.structural_vector().alias("v")), "v")


def temporal_vector(spark, sf_dir):
    return _summed(notes(spark, sf_dir).select("doc_id", B.temporal_vector(AS_OF, created="created_at").alias("v")), "v")


def multi_vector(spark, sf_dir):
    own = B.multi_vector(_embeddings(spark, sf_dir), AS_OF)
    return _summed(own.select("doc_id", F.concat("parts.semantic", "parts.structural", "parts.temporal").alias("v")), "v")


def combine_vectors(spark, sf_dir):
    v = corpus(spark, sf_dir).select("doc_id", B.combine_vectors({"semantic": F.slice("vec", 1, 32), "keyword": F.slice("vec", 33, 16), "structural": F.slice("vec", 49, 8), "temporal": F.slice("vec", 57, 8)}).alias("v"))
    return _summed(v, "v")


def multi_vector_search(spark, sf_dir):
    v = corpus(spark, sf_dir).withColumn("semantic", F.slice("vec", 1, 40)).withColumn("structural", F.slice("vec", 41, 24))
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return _rounded(B.multi_vector_search(v, q, ("semantic", "structural"), 5).select("query_id", "doc_id", "score"))


def embedding_pipeline(spark, sf_dir):
    return _rounded(B.embedding_pipeline(_embeddings(spark, sf_dir), "lang").select("doc_id", "scale", "norm"))


def embedding_memo(spark, sf_dir):
    v = _embeddings(spark, sf_dir)
    memo = v.filter("doc_id % 3 = 0").select(F.lit("m").alias("model"), F.sha2("text", 256).alias("text_hash"), "vec").dropDuplicates(["text_hash"])
    hit, miss = B.embedding_memo(v.select("doc_id", "text"), memo, "m")
    return hit.select("doc_id", F.lit(True).alias("reused")).union(miss.select("doc_id", F.lit(False)))


def stale_keys(spark, sf_dir):
    old = docs(spark, sf_dir).select("doc_id", "text")
    new = old.withColumn("text", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("text"))).filter("doc_id % 7 <> 0")
    return B.stale_keys(new, old, old.select("doc_id", F.concat(F.lit("k"), (F.col("doc_id") % 50).cast("string")).alias("key")))


# content scans


def scan_patterns(spark, sf_dir):
    return _risky(spark, sf_dir).select("doc_id", F.array_join(S.scan_patterns(F.col("text")), "|").alias("threats"))


def scan_patterns_basic(spark, sf_dir):
    return _risky(spark, sf_dir).select("doc_id", F.array_join(S.scan_patterns_basic(F.col("text")), "|").alias("threats"))


def scan_keywords(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(S.scan_keywords(F.col("text")), "|").alias("words"))


def byte_entropy(spark, sf_dir):
    return _rounded(S.byte_entropy(_risky(spark, sf_dir)))


def extract_urls(spark, sf_dir):
    return S.extract_urls(_risky(spark, sf_dir))


def suspicious_urls(spark, sf_dir):
    return S.suspicious_urls(S.extract_urls(_risky(spark, sf_dir)))


def _files(spark, sf_dir):
    k = F.col("doc_id") % 8
    head = F.when(k == 0, F.unhex(F.lit("25504446"))).when(k == 1, F.unhex(F.lit("4D5A"))).when(k == 2, F.unhex(F.lit("EFBBBF"))).when(k == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "txt", "csv", "exe", "md", "json"))), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 17 == 0, "con.txt").when(F.col("doc_id") % 19 == 0, "a/b.csv").otherwise(F.concat(F.lit("my_file-"), "doc_id", F.lit("."), ext))
    return _risky(spark, sf_dir).select("doc_id", name.alias("name"), F.when(F.col("doc_id") % 23 == 0, F.unhex(F.lit(""))).otherwise(F.concat(head, F.encode("text", "UTF-8"))).alias("content"))


def detect_type(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", S.detect_type(F.col("content"), F.col("name")).alias("t")).select("doc_id", "t.mime", "t.confidence")


def detect_bom(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", S.detect_bom(F.col("content")).alias("t")).select("doc_id", "t.*")


def validate_files(spark, sf_dir):
    return S.validate_files(_files(spark, sf_dir)).select("doc_id", F.array_join("errors", "|").alias("errors"))


def validate_files_basic(spark, sf_dir):
    return S.validate_files_basic(_files(spark, sf_dir)).select("doc_id", F.array_join("errors", "|").alias("errors"), "sha256")


def check_active_content(spark, sf_dir):
    own = _risky(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " <!DOCTYPE x> SYSTEM").otherwise("")))
    return own.select("doc_id", F.array_join(S.check_active_content(F.col("text"), "xml"), "|").alias("found"))


def validate_filenames(spark, sf_dir):
    return S.validate_filenames(_files(spark, sf_dir)).select("doc_id", "error", "sanitized", "title")


# context assembly


def _hits(spark, sf_dir, n=8):
    """For every twentieth embedding its nearest embeddings, each with the text of the document of that id."""
    v = corpus(spark, sf_dir)
    hits = dense.with_relevance(dense.knn_cosine(v, asked(v), n))
    texts = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text", "source", F.expr("timestamp '1998-01-01 00:00:00' + (doc_id % 1000) * interval '1 day'").alias("created_at"))
    return hits.join(texts, "doc_id").withColumn("metadata", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3"), F.lit("d"), F.lit("4"))).otherwise(F.create_map(F.lit("a"), F.lit("1"))))


def hit_importance(spark, sf_dir):
    return _rounded(X.hit_importance(_hits(spark, sf_dir), AS_OF).select("query_id", "doc_id", "importance"))


def key_points(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.array_join(X.key_points(F.col("text"), 3), "|").alias("points"))


def summarize(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", X.summarize(F.col("text"), 0.5).alias("summary"))


def compress_docs(spark, sf_dir):
    return _longs(X.compress_docs(notes(spark, sf_dir), "moderate", 40).select("doc_id", "text", "token_count"))


def select_diverse(spark, sf_dir):
    return X.select_diverse(X.hit_importance(_hits(spark, sf_dir), AS_OF), 4, 0.4)


def context_window(spark, sf_dir):
    q = Q.query_complexity(read(spark, sf_dir, "query_log").select("query_id", "text")).select("query_id", "level")
    return X.context_window(X.hit_importance(_hits(spark, sf_dir), AS_OF).join(q, "query_id"), budget=300)


def _window(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("position", F.col("rank"))


def format_context(spark, sf_dir):
    return X.format_context(_window(spark, sf_dir)).select("query_id", F.sha2("context", 256).alias("context"))


def context_stats(spark, sf_dir):
    return _rounded(X.context_stats(_window(spark, sf_dir)))


def context_by_chars(spark, sf_dir):
    return X.context_by_chars(_hits(spark, sf_dir), 900, 200).select("query_id", F.sha2("context", 256).alias("context"))


def truncate_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.truncate_text(F.col("text"), 150), 256).alias("text"))


# entities and graph


def _entities(spark, sf_dir):
    return graph.merge_entities(graph.extract_entities(notes(spark, sf_dir)))


def extract_entities(spark, sf_dir):
    return graph.extract_entities(notes(spark, sf_dir))


def entity_canonical(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("person", "organization", "money", "metric"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(kind == "person", F.concat(F.lit("dr. JANE smith "), "doc_id")).when(kind == "organization", F.concat(F.lit("Acme "), "doc_id", F.lit(" corporation"))).when(kind == "money", F.concat(F.lit("$1,"), "doc_id", F.lit("K"))).otherwise(" Profit ")
    return notes(spark, sf_dir).select("doc_id", graph.entity_canonical(kind, text).alias("canonical"))


def entity_aliases(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 2 == 0, "person").otherwise("organization")
    name = F.when(F.col("doc_id") % 5 == 0, "kpi").otherwise(F.concat(F.lit("Acme Big "), "title"))
    return notes(spark, sf_dir).select("doc_id", F.array_join(graph.entity_aliases(kind, name), "|").alias("aliases"))


def merge_entities(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("entities"), F.sum("mentions").alias("mentions"))


def entity_index(spark, sf_dir):
    return graph.entity_index(_entities(spark, sf_dir))


def _graph(spark, sf_dir):
    """Entities, stored, and the factored graph over them."""
    entities = kept(_entities(spark, sf_dir), "entities")
    return entities, factored.factor(entities, notes(spark, sf_dir))


def doc_edges(spark, sf_dir):
    """Links between classes of documents, with the document pairs that each stands for."""
    links = factored.class_links(_graph(spark, sf_dir)[1])
    return links.select("a", "b", "links", "strength", "type", "back", "back_type", F.array_join("shared", "|").alias("shared"))


def edge_strength(spark, sf_dir):
    """Every document with its class, its links, and the mean strength of the links that it has as the newer one of any two."""
    _, g = _graph(spark, sf_dir)
    links = kept(factored.class_links(g), "links")
    both = links.select(F.col("a").alias("class"), F.col("b").alias("other"), "strength").union(links.filter("a <> b").select("b", "a", "back"))
    sizes = g.classes.select(F.col("class").alias("other"), "size")
    met = F.when(F.col("class") == F.col("other"), F.col("size") - 1).otherwise(F.col("size"))
    each = both.join(sizes, "other").groupBy("class").agg(F.sum(met).alias("links"), F.round(F.sum(F.col("strength") * met) / F.sum(met), 6).alias("strength"))
    return g.members.join(small_side(each), "class").select("doc_id", "class", "links", "strength")


def edge_type(spark, sf_dir):
    """By type: document pairs that have it in either order, and those that have it in one."""
    links = factored.class_links(_graph(spark, sf_dir)[1])
    each = links.select("links", F.explode(F.array_distinct(F.array("type", "back_type"))).alias("kind"), (F.col("type") == F.col("back_type")).alias("both"))
    none = F.lit(0).cast("long")
    return each.groupBy(F.col("kind").alias("type")).agg(F.sum(F.when(F.col("both"), F.col("links")).otherwise(none)).alias("links"), F.sum(F.when(~F.col("both"), F.col("links")).otherwise(none)).alias("one_order"))


def _starts(spark, sf_dir):
    return notes(spark, sf_dir).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "doc_id")


def _paths(spark, sf_dir):
    """From every twentieth note to all others."""
    return factored.multi_hop(_graph(spark, sf_dir)[1], _starts(spark, sf_dir))


def multi_hop(spark, sf_dir):
    return _paths(spark, sf_dir).select("query_id", "end", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "strength", "hops")


def reasoning_chain(spark, sf_dir):
    return graph.reasoning_chain(_paths(spark, sf_dir)).select("query_id", "end", F.array_join("chain", ". ").alias("chain"))


def neighborhood(spark, sf_dir):
    _, g = _graph(spark, sf_dir)
    nodes, inside = factored.neighborhood(g, _starts(spark, sf_dir))
    sizes = nodes.join(small_side(g.classes.select("class", "size")), "class").groupBy("query_id").agg(F.sum("size").alias("nodes"))
    edges = inside.groupBy("query_id").agg(F.sum("links").alias("edges"))
    # a note without a shared form is alone
    every = _starts(spark, sf_dir).select("query_id").join(sizes, "query_id", "left").join(edges, "query_id", "left")
    return every.select("query_id", F.coalesce("nodes", F.lit(1).cast("long")).alias("nodes"), "edges")


def graph_stats(spark, sf_dir):
    entities, g = _graph(spark, sf_dir)
    links = kept(factored.class_links(g), "links")
    ends = g.members.join(small_side(factored.degrees(g, links).select("class", "n")), "class").select(F.col("doc_id").alias("d"), "n")
    one = graph.graph_stats(entities, links.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("edges")), ends)
    return _rounded(one.select("documents", "entities", "per_document", "edges", F.array_join("degrees", ",").alias("degrees"), F.array_join("common", ",").alias("common")))


def _names(spark, sf_dir):
    return read(spark, sf_dir, "region").select(F.concat(F.initcap("r_name"), F.lit(" Corp")).alias("name")).union(spark.createDataFrame([("Dr Jane Smith",), ("Jane Smith",)], "name string"))


def related_entities(spark, sf_dir):
    return graph.related_entities(_entities(spark, sf_dir), _names(spark, sf_dir)).select("name", "canonical", "n")


def entity_insights(spark, sf_dir):
    entities, g = _graph(spark, sf_dir)
    names = _names(spark, sf_dir)
    hit = kept(graph.called(entities, names), "called")
    out = graph.entity_insights(entities, hit, factored.neighbour_counts(g, hit), names)
    return out.select("name", "documents", "neighbours", F.array_join("related", "|").alias("related"))


def follow_up(spark, sf_dir):
    return graph.follow_up(_paths(spark, sf_dir)).select("query_id", "question", "confidence")


def multi_hop_batch(spark, sf_dir):
    entities, g = _graph(spark, sf_dir)
    hits = _starts(spark, sf_dir).withColumn("rank", F.lit(1))
    names = _starts(spark, sf_dir).select("query_id", F.lit("Jane Smith").alias("name"))
    search = lambda starts, asked, targets: factored.multi_hop(g, starts, targets, asked=asked)
    return _longs(graph.multi_hop_batch(search, entities, hits, names)).select("query_id", "doc_id", "distance")


# tabular sources


def scan_html_pages(spark, sf_dir):
    return T.scan_html_pages(read(spark, sf_dir, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), "title")


def clean_cells(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.concat(F.lit("  a \t b\n"), "o_orderpriority", F.lit(" ")).alias("note"))
    return T.clean_cells(o, ("o_orderkey",))


def clean_columns(spark, sf_dir):
    n = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" Customer-Key! "), F.col("c_name").alias("User  Name"), F.col("c_nationkey").alias("user name"))
    return T.clean_columns(n)


def route_formats(spark, sf_dir):
    name = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("csv", "CSV", "xlsx", "txt"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return T.route_formats(read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (F.col("p_partkey") * 1_000_000).alias("size"))).select("p_partkey", "reader", "reason")


def _customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("Market Segment"), "c_nationkey")


def rows_to_docs(spark, sf_dir):
    d = T.rows_to_docs(_customers(spark, sf_dir), "c_custkey", prefix="Customer row. ")
    return d.select("ordinal", "text", F.size("metadata").cast("long").alias("n"), "chunk")


def rows_to_docs_packed(spark, sf_dir):
    return T.rows_to_docs_packed(_customers(spark, sf_dir), "c_custkey", "customers.csv").select("chunk", "title", F.sha2("text", 256).alias("text"), "start_row", "end_row")


def sheet_docs(spark, sf_dir):
    d = T.sheet_docs(_customers(spark, sf_dir).withColumn("sheet", F.col("c_nationkey") % 3), "sheet", "c_custkey", "book")
    return _longs(d).select("sheet", "chunk", "title", F.sha2("text", 256).alias("text"))


def corpus_fingerprint(spark, sf_dir):
    return T.corpus_fingerprint(docs(spark, sf_dir))


def gen_golden(spark, sf_dir):
    return T.gen_golden(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")).select("qa", "question", "answer", "relevant_doc", "difficulty", "c_name")


def decode_bytes(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", F.sha2(T.decode_bytes(F.col("content")), 256).alias("text"))


def sniff_delimiter(spark, sf_dir):
    sep = F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|", " "))), (F.col("c_custkey") % 5 + 1).cast("int"))
    lines = read(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.posexplode(F.array(*(F.concat(F.lit("a"), sep, F.lit("b, c" if i == 2 else "b"), sep, F.lit("c")) for i in range(6)))).alias("line_no", "line"))
    return T.sniff_delimiter(lines.withColumn("line_no", F.col("line_no") + 1))


def scan_csv_auto(spark, sf_dir):
    path = shared_path(spark, "csv")
    read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "N/A").otherwise(F.col("c_name")).alias("Customer Name")).write.csv(path, header=True)
    return T.scan_csv_auto(spark, path)


# streams, run to the end of a table's rows


def _streamed(spark, df, build, mode="append"):
    """What a stream over df's rows, one file a batch, has written at its end."""
    folder = shared_path(spark, "stream")
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = build(stream).writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_scores(spark, sf_dir):
    return _rounded(_streamed(spark, interactions(spark, sf_dir), R.stream_scores).select("id", "overall"))


def stream_quality(spark, sf_dir):
    out = _streamed(spark, interactions(spark, sf_dir), lambda s: R.stream_quality(s, "1 day", None))
    return _rounded(out.select(F.unix_timestamp("start").alias("start"), "n", "overall"))


def stream_event_log(spark, sf_dir):
    return _streamed(spark, read(spark, sf_dir, "events"), R.stream_event_log).select(F.unix_timestamp("hour").alias("hour"), "event_type", "n")


def stream_feedback(spark, sf_dir):
    out = _streamed(spark, feedback(spark, sf_dir), R.stream_feedback)
    return _rounded(out.select(F.unix_timestamp("start").alias("start"), "n", "satisfaction"))


def stream_alerts(spark, sf_dir):
    return _rounded(_streamed(spark, interactions(spark, sf_dir), R.stream_alerts).select("id", "metric", "level", "value"))


def stream_ingest(spark, sf_dir):
    folder = shared_path(spark, "ingest")
    docs(spark, sf_dir).select("doc_id", "text").write.parquet(f"{folder}/in")
    R.stream_ingest(spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/in"), f"{folder}/ledger", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("doc_id").agg(F.count("*").alias("chunks"))


_V = "with v as (select vec_id as doc_id, cast(embedding as double[]) as vec from embeddings)"
_P = "round(sum(x * i), 6) as weighted"
_RISKY = """risky as (select *, text || case doc_id % 6 when 0 then ' <script>alert(1)</script> <b>x</b>' when 1 then ' eval(1); http://bit.ly/a1 <p class=''c''>y</p>' when 2 then ' drop table x; -- http://127.0.0.1/x'
  when 3 then ''' or 1 = 1 http://10.0.0.1/admin/password=secret' when 4 then ' powershell http://very-long-name-of-a-host-that-goes-on-and-on-for-ever.example.com/' else '' end as t from notes)"""
_HITS = """v as (select vec_id as doc_id, cast(embedding as double[]) as vec from embeddings), h0 as (select q.doc_id as query_id, v.doc_id, list_cosine_similarity(q.vec, v.vec) as s from v q, v where q.doc_id % 20 = 0),
h1 as (select *, row_number() over (partition by query_id order by round(s, 6) desc, doc_id) as rank from h0 qualify rank <= 8),
hits as (select query_id, h1.doc_id, rank, greatest(0, least(1, s)) as relevance, 'Document ' || h1.doc_id as title, text, source, timestamp '1998-01-01 00:00:00' + (h1.doc_id % 1000) * interval '1 day' as created_at from h1 join documents n on h1.doc_id = n.doc_id)"""


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _list(pairs, sep="|"):
    return "concat_ws('" + sep + "', " + ", ".join(f"case when {c} then {_lit(n)} end" for c, n in pairs) + ")"


_POINTS = """sent as (select doc_id, i, s from (select doc_id, unnest(range(len(p))) as i, unnest(p) as s from (select doc_id, list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)) as p from notes))),
scored as (select *, case when length(s) > 200 then -0.2 else 0 end + case when regexp_matches(s, '\\d') then 0.3 else 0 end + 0.1 * (""" + " + ".join(f"cast(contains(lower(s), '{w}') as int)" for w in X.INDICATORS + X.VERBS) + """) as sc from sent where length(s) >= 20),
ranked as (select *, row_number() over (partition by doc_id order by round(sc, 6) desc, i) as r from scored)"""
_FILES = """f as (select doc_id, case when doc_id % 17 = 0 then 'con.txt' when doc_id % 19 = 0 then 'a/b.csv' else 'my_file-' || doc_id || '.' || ['pdf', 'txt', 'csv', 'exe', 'md', 'json'][doc_id % 6 + 1] end as name from notes)"""

SQL = {
    "quantize_int8": f"{_V}, s as (select doc_id, vec, case when list_max(list_transform(vec, lambda x: abs(x))) > 0 then list_max(list_transform(vec, lambda x: abs(x))) / 127 else 1 end as scale from v), x as (select doc_id, i, round_even(vec[i] / scale, 0) as x from s, range(1, 65) r(i)) select x.doc_id, {_P}, any_value(round(scale, 6)) as scale, any_value(round(sqrt(list_inner_product(vec, vec)), 6)) as norm from x join s on x.doc_id = s.doc_id group by x.doc_id",
    "quantize": f"{_V}, s as (select doc_id, vec, list_max(list_transform(vec, lambda x: abs(x))) / 127 as scale from v), x as (select doc_id, i, round_even(vec[i] / scale, 0) as x from s, range(1, 65) r(i)) select doc_id, {_P} from x group by doc_id",
    "quantize_binary": f"{_V}, x as (select doc_id, i, sign(vec[i]) as x from v, range(1, 65) r(i)) select doc_id, {_P} from x group by doc_id",
    "dequantize": f"{_V}, s as (select doc_id, vec, list_max(list_transform(vec, lambda x: abs(x))) / 127 as scale from v), x as (select doc_id, i, round_even(vec[i] / scale, 0) * scale as x from s, range(1, 65) r(i)) select doc_id, {_P} from x group by doc_id",
    "quantization_stats": f"{_V}, s as (select vec, list_max(list_transform(vec, lambda x: abs(x))) / 127 as scale from v), q as (select vec, list_transform(vec, lambda x: round_even(x / scale, 0) * scale) as w from s) select 'int8' as method, count(*) as n, round(sum(64 * 4) / sum(72), 6) as ratio, round(avg(1 - list_cosine_similarity(vec, w)), 6) as loss, round(sum(256 - 72) / 1000000, 6) as saved_mb from q",
    "domain_boost": r"with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w from documents), b as (select doc_id, 1 + 0.1 * case when len(w) = 0 then 0 else len(list_intersect(w, ['the', 'de', 'of', 'der'])) / len(w) end as boost from w) select doc_id, round(boost, 6) as boost, round(doc_id % 4 * boost, 6) as first from b",
    "domain_vocabulary": r"""with w as (select lang, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w from documents), s as (select lang, count(*) as documents, cast(sum(len(w)) as bigint) as words from w group by lang),
      t as (select lang, regexp_replace(x, '[^\p{L}\p{N}]', '', 'g') as t from (select lang, unnest(w) as x from w)), f as (select lang, t, count(*) as f from t where length(t) > 2 group by lang, t), r as (select *, row_number() over (partition by lang order by f desc, t) as r from f)
      select s.lang, documents, words, u as unique_words, round(u / words, 6) as density, terms from s join (select lang, count(*) as u from f group by lang) using (lang) join (select lang, string_agg(t, ' ' order by r) as terms from r where r <= 50 and f >= 3 group by lang) using (lang)""",
    "temporal_vector": rf"""with w as (select doc_id, text, lower(text) as low, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as n, date_diff('day', cast(created_at as date), date '{AS_OF}') as d from notes)
      select doc_id, round(({' + '.join(f"cast(contains(low, '{x}') as int)" for x in B.TIME_WORDS)}) / n + 2 * len(regexp_extract_all(text, '\d{{4}}|\d{{1,2}}/\d{{1,2}}|\d{{1,2}}-\d{{1,2}}')) / n + 3 / (1 + d / 365) + 4 * ({' + '.join(f"cast(contains(low, '{x}') as int)" for x in B.TIME_PHRASES)}) / n, 6) as weighted from w""",
    "structural_vector": rf"""with {_RISKY}, w as (select doc_id, t, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') as w from risky)
      select doc_id, cast(length(t) + 2 * len(w) + 3 * len(list_filter(string_split(t, '.'), lambda x: trim(x) <> '')) + 5 * (length(t) - length(replace(t, '?', ''))) + 6 * (length(t) - length(replace(t, '!', ''))) + 7 * len(list_filter(w, lambda x: upper(x) = x and lower(x) <> x)) + 8 * len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) as double) as weighted from w""",
    "combine_vectors": f"{_V}, x as (select doc_id, i, vec[i] * case when i <= 32 then 0.6 when i <= 48 then 0.2 else 0.1 end as x from v, range(1, 65) r(i)) select doc_id, {_P} from x group by doc_id",
    "multi_vector_search": f"{_V}, s as (select q.doc_id as query_id, v.doc_id, (0.6 * list_cosine_similarity(q.vec[1:40], v.vec[1:40]) + 0.1 * list_cosine_similarity(q.vec[41:64], v.vec[41:64])) / 0.7 as s from v q, v where q.doc_id % 20 = 0) select query_id, doc_id, round(s, 6) as score from (select *, row_number() over (partition by query_id order by round(s, 6) desc, doc_id) as r from s) where r <= 5",
    "embedding_memo": "select doc_id, text in (select text from documents where doc_id % 3 = 0) as reused from documents",
    "stale_keys": "select distinct 'k' || (doc_id % 50) as key from documents where doc_id % 7 = 0 or (doc_id % 4 = 0 and text <> 'changed')",
    "scan_patterns": f"with {_RISKY} select doc_id, {_list([('regexp_matches(t, ' + _lit('(?is)' + p) + ')', p) for k in ('general', 'text') for p in S.PATTERNS[k]])} as threats from risky",
    "scan_patterns_basic": f"with {_RISKY} select doc_id, {_list([('contains(lower(t), ' + _lit(p) + ')', p) for p in S.BASIC])} as threats from risky",
    "scan_keywords": f"select doc_id, {_list([('contains(lower(text), ' + _lit(p) + ')', p) for p in S.KEYWORDS])} as words from documents",
    "byte_entropy": f"with {_RISKY}, b as (select doc_id, unnest(regexp_extract_all(hex(encode(t)), '[0-9A-F]{{2}}')) as b from risky), c as (select doc_id, b, count(*) as n from b group by doc_id, b), t as (select doc_id, sum(n) as t from c group by doc_id) select doc_id, round(-sum(n / t * log2(n / t)), 6) as entropy from c join t using (doc_id) group by doc_id",
    "extract_urls": f"with {_RISKY} select doc_id, unnest(regexp_extract_all(t, {_lit(S.URL)})) as url from risky",
    "suspicious_urls": f"with {_RISKY}, u as (select distinct doc_id, unnest(regexp_extract_all(t, {_lit(S.URL)})) as url from risky), h as (select *, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) as host from u) select doc_id, url from h where regexp_matches(host, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}|[a-z0-9]{{20,}}\\.com|[^a-z0-9.-]') or {' or '.join(f'contains(lower(url), {_lit(d)})' for d in S.SHORT_OR_LOCAL)}",
    "check_active_content": f"with {_RISKY}, x as (select doc_id, t || case when doc_id % 3 = 0 then ' <!DOCTYPE x> SYSTEM' else '' end as t from risky) select doc_id, {_list([('contains(t, ' + _lit(p) + ')', p) for p in S.ACTIVE['xml']])} as found from x",
    "validate_filenames": f"with {_FILES} select doc_id, case when regexp_matches(name, '\\.\\.|[/\\\\<>:\"|?*]') then 'dangerous character' when upper(split_part(name, '.', 1)) in ({', '.join(map(_lit, S.RESERVED))}) then 'reserved name' end as error, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') as sanitized, case name when 'con.txt' then 'Con' when 'a/b.csv' then 'A/b' else 'My File ' || doc_id end as title from f",
    "hit_importance": f"with {_HITS} select query_id, doc_id, round(relevance + greatest(0, 1 - date_diff('day', cast(created_at as date), date '{AS_OF}') / 365) * 0.1 + case when doc_id % 2 = 0 then 0.05 else 0 end, 6) as importance from hits",
    "key_points": f"with {_POINTS} select n.doc_id, coalesce(p, '') as points from notes n left join (select doc_id, string_agg(s, '|' order by r) as p from ranked where r <= 3 group by doc_id) k on n.doc_id = k.doc_id",
    "summarize": f"with {_POINTS}, n as (select doc_id, greatest(1, floor(count(*) filter (where length(s) > 20) * 0.5)) as n from sent group by doc_id) select ranked.doc_id, string_agg(s, '. ' order by r) || '.' as summary from ranked join n on ranked.doc_id = n.doc_id where r <= n.n group by ranked.doc_id",
    "format_context": f"with {_HITS} select query_id, sha256(string_agg('Document ' || rank || ': ' || title || ' (Source: ' || source || ')' || printf(' [Relevance: %.2f]', relevance) || chr(10) || text || chr(10), chr(10) order by rank)) as context from hits group by query_id",
    "context_stats": f"with {_HITS} select query_id, count(*) as documents, cast(sum(length(text) // 4) as bigint) as tokens, round(avg(relevance), 6) as relevance from hits group by query_id",
    "truncate_text": "with d as (select doc_id, text, substr(text, 1, 600) as h from documents), l as (select *, length(h) - least(coalesce(nullif(strpos(reverse(h), '.'), 0), 601), coalesce(nullif(strpos(reverse(h), chr(10)), 0), 601)) as b from d) select doc_id, sha256(case when length(text) <= 600 then text else (case when b > 300 then substr(text, 1, b + 1) else h end) || chr(10) || chr(10) || '[Content truncated due to length...]' end) as text from l",
    "entity_canonical": "select doc_id, case doc_id % 4 when 0 then 'Jane Smith ' || doc_id when 1 then 'Acme ' || doc_id || ' Corp' when 2 then '$1' || doc_id || '000' else 'profit' end as canonical from notes",
    "entity_aliases": "select doc_id, case when doc_id % 5 = 0 then 'key performance indicator|performance indicator|kpi' when doc_id % 2 = 0 then 'A. B. N. ' || substr(cast(doc_id as varchar), 1, 1) || '.|Acme' else 'ABN' || substr(cast(doc_id as varchar), 1, 1) end as aliases from notes",
    "clean_cells": "select o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, 'a b ' || o_orderpriority as note from orders",
    "clean_columns": "select c_custkey as customer_key, c_name as user_name, c_nationkey as user_name_2 from customer",
    "route_formats": "select p_partkey, case when p_partkey * 1000000 <= 52428800 then case p_partkey % 4 when 0 then 'csv' when 1 then 'csv' when 2 then 'excel' end end as reader, case when p_partkey * 1000000 > 52428800 then 'too large' when p_partkey % 4 = 3 then 'unsupported' end as reason from part",
    "rows_to_docs": "select c_custkey as ordinal, 'Customer row. name: ' || c_name || case when c_custkey % 3 > 0 then ' | market_segment: ' || c_mktsegment else '' end || ' | c_nationkey: ' || c_nationkey as text, cast(case when c_custkey % 3 > 0 then 3 else 2 end as bigint) as n, c_custkey // 1000 as chunk from customer",
    "rows_to_docs_packed": """with l as (select c_custkey, c_custkey // 1000 as chunk, '[Row: ' || (c_custkey + 1) || '] name: ' || c_name || case when c_custkey % 3 > 0 then ' | market_segment: ' || c_mktsegment else '' end || ' | c_nationkey: ' || c_nationkey as t from customer)
      select chunk, case when count(*) over () = 1 then 'customers.csv' else 'customers.csv - Part ' || (chunk + 1) end as title, sha256(string_agg(t, chr(10) order by c_custkey)) as text, min(c_custkey) + 1 as start_row, max(c_custkey) + 1 as end_row from l group by chunk""",
    "sheet_docs": """with l as (select c_custkey, cast(c_nationkey % 3 as bigint) as sheet, c_custkey // 1000 as chunk, '[Row: ' || (c_custkey + 1) || '] name: ' || c_name || case when c_custkey % 3 > 0 then ' | market_segment: ' || c_mktsegment else '' end || ' | c_nationkey: ' || c_nationkey as t from customer)
      select sheet, chunk, 'book (' || sheet || ')' || case when count(*) over (partition by sheet) = 1 then '' else ' - Part ' || (chunk + 1) end as title, sha256(string_agg(t, chr(10) order by c_custkey)) as text from l group by sheet, chunk""",
    "gen_golden": "select printf('qa_%04d', c_custkey) as qa, ['What is topic ' || c_custkey || '?', 'How does process ' || c_custkey || ' work?', 'Why is metric ' || c_custkey || ' important?'][c_custkey % 3 + 1] as question, ['Topic ' || c_custkey || ' is described in document ' || c_custkey || '.', 'Process ' || c_custkey || ' works as in document ' || c_custkey || '.', 'Metric ' || c_custkey || ' matters as in document ' || c_custkey || '.'][c_custkey % 3 + 1] as answer, 'doc_' || c_custkey as relevant_doc, ['easy', 'medium', 'hard'][c_custkey % 3 + 1] as difficulty, c_name from customer",
    "scan_csv_auto": "select cast(c_custkey as varchar) as c_custkey, case when c_custkey % 4 <> 0 then c_name end as customer_name from customer",
}
# files: the first bytes in hexadecimal, then the text's
_FILES = f"""{_RISKY}, files as (select doc_id, case when doc_id % 17 = 0 then 'con.txt' when doc_id % 19 = 0 then 'a/b.csv' else 'my_file-' || doc_id || '.' || ['pdf', 'txt', 'csv', 'exe', 'md', 'json'][doc_id % 6 + 1] end as name,
  case when doc_id % 23 = 0 then '' else case doc_id % 8 when 0 then '25504446' when 1 then '4D5A' when 2 then 'EFBBBF' when 3 then 'FF' else '' end || hex(encode(t)) end as h, t from risky),
ext as (select *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) as ext from files),
typed as (select *, case {" ".join(f"when starts_with(h, '{sig}') then '{mime}'" for sig, mime in S.SIGNATURES)} end as found, case ext {" ".join(f"when '{e}' then '{mime}'" for e, mime in S.EXTENSIONS)} end as guess from ext),
kinds as (select *, coalesce(found, guess, 'application/octet-stream') as mime from typed),
basic as (select *, list_filter([case when regexp_matches(name, '\\.\\.|[/\\\\<>:"|?*]') or upper(split_part(name, '.', 1)) in ({", ".join(f"'{r}'" for r in S.RESERVED)}) then 'name' end, case when ext not in ({", ".join(f"'{e}'" for e in S.ALLOWED)}) then 'extension' end,
  case when h = '' then 'empty' end, {", ".join(f"case when starts_with(h, '{sig}') then 'signature {sig}' end" for sig in S.DANGEROUS)}], lambda x: x is not null) as errors from kinds)"""
SQL |= {
    "detect_type": f"with {_FILES} select doc_id, mime, case when found is not null then 0.9 when guess is not null then 0.7 else 0.3 end as confidence from kinds",
    "detect_bom": f"with {_FILES} select doc_id, case when starts_with(h, 'FF') then 'latin-1' else 'utf-8' end as encoding, starts_with(h, 'EFBBBF') as bom, case when starts_with(h, 'EFBBBF') then 0.9 when starts_with(h, 'FF') then 0.5 else 0.7 end as confidence from files",
    "validate_files_basic": f"with {_FILES} select doc_id, array_to_string(errors, '|') as errors, sha256(unhex(h)) as sha256 from basic",
    "validate_files": f"""with {_FILES}, scans as ({SQL["scan_patterns"].split("from notes)", 1)[1].strip().replace("from risky", "from risky")}),
      more as (select b.doc_id, b.errors || list_filter([case when not ({" or ".join(f"(ext = '{e}' and mime in ({', '.join(repr(m) for m in ms)}))" for e, ms in S.ALLOWED.items())}) then 'type' end, case when h <> '' and threats <> '' then 'content' end], lambda x: x is not null) as errors from basic b join scans using (doc_id))
      select doc_id, array_to_string(errors, '|') as errors from more""",
    "stream_scores": Y.SQL["score_interactions"].replace("select id, round(grounding, 6) as grounding, round(confidence, 6) as confidence, round(hallucination_risk, 6) as hallucination_risk, round(overall, 6) as overall from z", "select id, round(overall, 6) as overall from z"),
    "stream_alerts": Y.SQL["quality_alerts"],
    "compress_docs": f"""with short as ({SQL["summarize"]}), cut as (select doc_id, case when length(summary) // 4 > 40 then substr(summary, 1, cast(floor(length(summary) * (40 / (length(summary) // 4)) * 0.9) as bigint)) || '...' else summary end as text from short)
      select doc_id, text, length(text) // 4 as token_count from cut""",
    "context_by_chars": f"""with {_HITS}, l as (select *, substr(text, 1, 200) as head, length(substr(text, 1, 200)) - least(coalesce(nullif(strpos(reverse(substr(text, 1, 200)), '.'), 0), 201), coalesce(nullif(strpos(reverse(substr(text, 1, 200)), chr(10)), 0), 201)) as b from hits),
      p as (select query_id, rank, 'Document: ' || title || chr(10) || 'Content: ' || case when length(text) <= 200 then text else (case when b > 100 then substr(text, 1, b + 1) else head end) || chr(10) || chr(10) || '[Content truncated due to length...]' end as part from l),
      k as (select *, sum(length(part)) over (partition by query_id order by rank) as total from p)
      select query_id, sha256(string_agg(part, chr(10) || chr(10) order by rank)) as context from k where total <= 900 group by query_id""",
}
QUERIES = {f.__name__: f for f in (quantize_int8, quantize_binary, quantize, dequantize, quantize_pq, quantization_stats, quantization_bench, domain_vocabulary, domain_boost, domain_embeddings, keyword_vector, structural_vector, temporal_vector, multi_vector, combine_vectors, multi_vector_search, embedding_pipeline, embedding_memo, stale_keys, scan_patterns, scan_patterns_basic, scan_keywords, byte_entropy, extract_urls, suspicious_urls, detect_type, detect_bom, validate_files, validate_files_basic, check_active_content, validate_filenames, hit_importance, key_points, summarize, compress_docs, select_diverse, context_window, format_context, context_stats, context_by_chars, truncate_text, extract_entities, entity_canonical, entity_aliases, merge_entities, entity_index, doc_edges, edge_strength, edge_type, multi_hop, reasoning_chain, neighborhood, graph_stats, related_entities, entity_insights, follow_up, multi_hop_batch, scan_html_pages, clean_cells, clean_columns, route_formats, rows_to_docs, rows_to_docs_packed, sheet_docs, corpus_fingerprint, gen_golden, decode_bytes, sniff_delimiter, scan_csv_auto, stream_scores, stream_quality, stream_event_log, stream_feedback, stream_alerts, stream_ingest)}
