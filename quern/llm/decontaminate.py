"""Benchmark decontamination: a prefix-filtered set join over word windows, in DataFrame functions alone.

A window is window_words consecutive words of an item; a shorter item is one window. Exact containment of a whole window needs
all its tokens, so its necessary prefix is one token: its rarest, by counts over all documents. Document words join the windows'
prefix tokens only. The token's place in the window and the document's length bound where the window could begin (positional
and length bounds); the second rarest token must stand at its place too; what is left is verified against the document's words
over the window's own size.

Texts are split into words once, into a stored table with a number for each row. While the index of windows takes at most
index_bytes, by a sum over it, it is broadcast and a document is verified where it stands, so that hits alone leave the scan. A
larger index is met by a join on the token, with frequent tokens dealt to several tasks, and its candidates by a join on the row
number.

Defined cases: a null or empty text has no words, and is not contaminated; an item without words has no window; an item that
occurs twice in the benchmark counts once by item_id, and equal texts under two ids count for both; rows are told apart by their
own number, so a repeated or null doc_id gives one result row each; empty tables give clean documents or an empty table; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The largest index of windows that is broadcast.
INDEX_BYTES = 64 << 20
#: Row numbers that are broadcast at most.
BROADCAST_ROWS = 2_000_000
#: Tokens with more than a HOT_TOKENS-th of all words, and more than HOT_ROWS, are dealt to several tasks.
HOT_TOKENS, HOT_ROWS = 1000, 100_000


def words_of(text: Column) -> Column:
    """A-Z lower-cased words; Spark's lower() does just that where all characters are ASCII."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP, -1), "")


def item_windows(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, tokens) of each distinct window, and (window_id, item_id) of the items that hold it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("tokens")).distinct()
    windows = stored(each.select("tokens").distinct().select(F.monotonically_increasing_id().alias("window_id"), "tokens"), "bench-windows")
    return windows, each.join(windows, "tokens").select("window_id", "item_id")


def measured(df: DataFrame, *strings: Column) -> int:
    """Bytes that the rows take at most in a broadcast, about: of the strings and 64 more a row."""
    size = F.lit(64).cast("long")
    for s in strings:
        size = size + F.octet_length(s)
    return df.agg(F.sum(size)).first()[0] or 0


def prefix_index(texts: DataFrame, windows: DataFrame, index_bytes: int) -> tuple[DataFrame, bool]:
    """(word, n, o, other, o2, len, window_id, tokens): each window by its rarest token at o, with its next rarest at o2; whether it is small."""
    vocabulary = stored(windows.select(F.explode("tokens").alias("word")).distinct(), "bench-words")
    known = F.broadcast(vocabulary) if measured(vocabulary, F.col("word")) <= index_bytes else vocabulary
    counts = texts.select(F.explode("_decon_words").alias("word")).join(known, "word").groupBy("word").agg(F.count("*").alias("n"))
    places = windows.select("window_id", F.posexplode("tokens").alias("o", "word")).join(vocabulary.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))), "word")
    order = F.array_sort(F.collect_list(F.struct("n", "word", "o")))  # a window's own tokens
    ranked = places.groupBy("window_id").agg(order.alias("t")).filter(F.col("t")[0]["n"] > 0)
    first, other = F.col("t")[0], F.coalesce(F.get("t", F.lit(1)), F.col("t")[0])
    slim = ranked.select("window_id", first["word"].alias("word"), first["n"].alias("n"), first["o"].alias("o"), other["word"].alias("other"), other["o"].alias("o2"))
    index = stored(slim.join(windows.withColumn("len", F.size("tokens")), "window_id"), "bench-index")
    return index, measured(index, F.col("word"), F.col("other"), F.array_join("tokens", "12345678")) <= index_bytes


def window_hits(texts: DataFrame, windows: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(row, s, len, window_id): each window that occurs in a row's words, at place s. texts: as tokenised() gives them."""
    index, small = prefix_index(texts, windows, index_bytes)
    w, begin = F.col("_decon_words"), F.col("p") - F.col("o")
    bounds = (F.col("p") >= F.col("o")) & (begin + F.col("len") <= F.col("_decon_n"))
    fits = (F.get(w, begin + F.col("o2")) == F.col("other")) & (F.slice(w, begin + 1, F.col("len")) == F.col("tokens"))
    place = F.posexplode("_decon_words").alias("p", "word")
    if small:
        found = texts.select("_decon_row", "_decon_n", "_decon_words", place).join(F.broadcast(index), "word").filter(bounds & fits)
    else:
        total = texts.agg(F.sum("_decon_n")).first()[0] or 0
        bound = max(HOT_ROWS, total // HOT_TOKENS)
        hot = F.broadcast(index.filter(F.col("n") > bound).select("word", F.ceil(F.col("n") / bound).cast("int").alias("k")).distinct())  # at most HOT_TOKENS
        dealt = texts.select("_decon_row", "_decon_n", place).join(hot, "word", "left").withColumn("salt", F.pmod(F.xxhash64("_decon_row", "p"), F.coalesce("k", F.lit(1))))
        copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(F.lit(1), F.col("n")) / bound) - 1)))
        candidates = dealt.join(copies, ["word", "salt"]).filter(bounds).select("_decon_row", "p", "o", "o2", "other", "len", "window_id", "tokens")
        found = candidates.join(texts.select("_decon_row", "_decon_words"), "_decon_row").filter(fits)
    return stored(found.select(F.col("_decon_row").alias("row"), begin.alias("s"), "len", "window_id"), "bench-hits")


def tokenised(docs: DataFrame) -> DataFrame:
    """docs without its text, and _decon_row, _decon_words, _decon_n: a number of the row, its words and their count; stored."""
    split = docs.withColumns({"_decon_row": F.monotonically_increasing_id(), "_decon_words": words_of(F.col("text"))})
    return stored(split.withColumn("_decon_n", F.size("_decon_words")), "bench-texts")


def contamination(docs: DataFrame, benchmark: DataFrame, window_words: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items) for each document."""
    windows, owners = item_windows(benchmark, window_words)
    texts = tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    hits = window_hits(texts, windows, index_bytes)
    # the words under the union of a document's windows
    union = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("len")).alias("e")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")),
        lambda acc: acc["n"],
    )
    covered = hits.groupBy("row").agg(union.cast("long").alias("n_hit"))
    items = hits.select("row", "window_id").distinct().join(owners, "window_id").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    base = texts.select(F.col("_decon_row").alias("row"), "doc_id", F.col("_decon_n").cast("long").alias("n_words"))
    out = base.join(covered.join(items, "row"), "row", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")).withColumn("n_items", F.size("items").cast("long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window_words: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark window; rows with the same doc_id are judged each."""
    texts = tokenised(docs)
    hits = stored(window_hits(texts, item_windows(benchmark, window_words)[0], index_bytes).select(F.col("row").alias("_decon_row")).distinct(), "bench-rows")
    few = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits  # else texts are shuffled by their row numbers
    return texts.join(few, "_decon_row", "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item_id, w, len(w) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
win as (
  select distinct item_id, len(t) as k, array_to_string(t, ' ') as s
  from (select item_id, list_slice(w, i, i + 9) as t
        from (select item_id, w, unnest(range(1, greatest(1, n - 9) + 1)) as i from b))),
places as (
  select doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') as s
  from (select d.doc_id, d.w, ks.k, unnest(range(1, len(d.w) - ks.k + 2)) as p from d, (select distinct k from win) ks where len(d.w) >= ks.k)),
hit as (select distinct a.doc_id, a.k, a.p, win.item_id from places a join win on a.k = win.k and a.s = win.s),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(items.n_items, 0) as n_items,
       sha256(coalesce(items.ids, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
"""

QUERIES = {"op7_decontamination": op7_decontamination}
SQL = {"op7_decontamination": OP7_SQL}
