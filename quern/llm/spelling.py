r"""Spelling variants of a corpus's words by reduced-alphabet generation.

Runs of letters are counted over all documents. Each letter of a word is hashed to one of SYMBOLS symbols; the one-edit neighbourhood
of the reduced word is generated (itself, every deletion and every replacement; an insertion is its longer word's deletion), joined
to the reduced vocabulary, and what meets is verified on the original strings inside the join. Being near is symmetric, so of two
reduced words of one length only the one that has the larger symbol generates the other: a pair is met once, and no pair is lost.

Generation is numpy over flat symbol arrays. A reduced word is a polynomial hash modulo 2 ** 64, so a neighbour's hash follows from
sums before and after the edit: work is linear in a word's length. The join is on these hashes; equal hashes of different words
cost a comparison and nothing else. With 8 symbols a word meets few others that are not near it.

A word's form is its most frequent near word, if that is FREQUENT times as frequent as itself; roots follow forms by pointer doubling,
whose rounds grow with the logarithm of the longest chain (a chain's counts grow by FREQUENT a step, so it is short).

Defined cases: a null or empty text has no words; a null doc_id enters the hash of a run as an empty string; repeated rows count
each; long texts and words are taken whole (words of over LONG letters are joined by their own hashes, and meet their text after);
a table without words gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .merkle import CRC_TABLE, crc32_sql

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, the ratio of a form's count to the word's, and the divisor of a run's hash.
LETTERS, OCCURRENCES, FREQUENT, SLIP = 6, 5, 5, 199
SYMBOLS = 8
#: Words of more letters send no text with their neighbours.
LONG = 64
#: Letters of the words, and rows of the neighbours, that a task holds at a time.
SLICE_LETTERS, SLICE_ROWS = 1 << 17, 1 << 18
#: An odd base has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def lowered(run: Column) -> Column:
    """A-Z lower-cased; lower() does that alone where every character has one byte."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of the documents."""
    # shorter runs are no words, with or without a slip
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{LETTERS},}}+"), F.lit(0))).alias("run"))
    runs = runs.select("doc", lowered(F.col("run")).alias("run"))
    hashed = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (hashed % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = runs.select(F.when(hashed % SLIP == 0, slip).otherwise(F.col("run")).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= LETTERS) & (F.col("n") >= OCCURRENCES))


def reduced(texts: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols, from 1, of all words in one array, and the words' lengths."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype("uint64")
    mixed = (points * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    return (mixed * np.uint64(symbols) >> np.uint64(32)) + np.uint64(1), np.fromiter(map(len, texts), "int64", len(texts))


class Sums:
    """Polynomial sums of flat words: of a whole word, and before each of its letters."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(symbols)) - starts[self.word]
        powers = np.full(int(lengths.max(initial=0)) + 1, BASE, "uint64")
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[place]
        self.term = symbols * self.power
        upto = np.concatenate([[np.uint64(0)], np.cumsum(self.term)])
        self.total = upto[starts + lengths] - upto[starts]
        self.before = upto[:-1] - upto[starts][self.word]
        self.last = place == lengths[self.word] - 1


def keys(texts: list[str], symbols: int) -> np.ndarray:
    """The hash of each reduced word."""
    return Sums(*reduced(texts, symbols)).total


def neighbourhood(texts: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word's number, hash): the words themselves, then deletions, then replacements by each smaller symbol; none comes twice."""
    flat, lengths = reduced(texts, symbols)
    sums = Sums(flat, lengths)
    yield np.arange(len(texts)), sums.total
    # one deletion for each run of equal symbols
    once = sums.last | np.concatenate([flat[1:] != flat[:-1], [True]])[: len(flat)]
    of = sums.word[once]
    yield of, sums.before[once] + (sums.total[of] - sums.before[once] - sums.term[once]) * np.uint64(INVERSE)
    for symbol in range(1, symbols):
        larger = flat > symbol
        of = sums.word[larger]
        yield of, sums.total[of] - (flat[larger] - np.uint64(symbol)) * sums.power[larger]


def letter_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_LETTERS letters."""
    for batch in batches:
        start = size = 0
        for i, text in enumerate(batch.column("word").to_pylist()):
            if size and size + len(text) > SLICE_LETTERS:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += len(text)
        if start < batch.num_rows:
            yield batch.slice(start)


def own_keys(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    for part in letter_slices(batches):
        found = pa.array(keys(part.column("word").to_pylist(), symbols).view("int64"))
        yield pa.RecordBatch.from_arrays([found, part.column("word"), part.column("n")], names=["key", "near", "near_n"])


def sent_keys(batches: Iterator[pa.RecordBatch], symbols: int, column: str) -> Iterator[pa.RecordBatch]:
    """(key, self, and the word's column and count) of each neighbour; self: it is the word's own reduced form."""
    for part in letter_slices(batches):
        for k, (of, hashes) in enumerate(neighbourhood(part.column("word").to_pylist(), symbols)):
            for at in range(0, len(of), SLICE_ROWS):
                rows = pa.array(of[at : at + SLICE_ROWS])
                own = pa.array(np.full(len(rows), k == 0))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + SLICE_ROWS].view("int64")), own, part.column(column).take(rows), part.column("n").take(rows)], names=["key", "self", column, "n"])


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every two words that are near, once. vocabulary: (word, n), stored."""
    own = vocabulary.mapInArrow(lambda b: own_keys(b, symbols), "key long, near string, near_n long")
    # words of one reduced form send it both; the smaller word's is taken
    once = ~F.col("self") | (F.col("word") < F.col("near"))
    short = vocabulary.filter(F.length("word") <= LONG).mapInArrow(lambda b: sent_keys(b, symbols, "word"), "key long, self boolean, word string, n long")
    pairs = short.join(own, "key").filter(once & one_edit(F.col("word"), F.col("near"))).select("word", "n", "near", "near_n")
    long = vocabulary.filter(F.length("word") > LONG).withColumn("id", F.xxhash64("word"))
    sent = long.mapInArrow(lambda b: sent_keys(b, symbols, "id"), "key long, self boolean, id long, n long")
    met = sent.join(own.filter(F.length("near") >= LONG), "key").drop("key", "n").join(long, "id")
    return pairs.union(met.filter(once & one_edit(F.col("word"), F.col("near"))).select("word", "n", "near", "near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: where following forms ends. forms: (word, form)."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        farther = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(ahead.join(farther, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not moved.filter("moved").head(1):
            return ahead
        ahead = moved.drop("moved")


def variants(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    vocabulary = stored(words(docs), "spelling-words")
    pair = [F.struct(F.col(a).alias("word"), F.col(f"{a}_n" if a == "near" else "n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n" if b == "near" else "n").alias("near_n")) for a, b in (("word", "near"), ("near", "word"))]
    links = near_pairs(vocabulary, symbols).select(F.inline(F.array(*pair)))
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    most = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), "near")))
    each = links.union(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), most.alias("most"))
    frequent = -F.col("most.minus") >= FREQUENT * F.col("n")
    judged = stored(each.select("word", "n", "n_near", F.when(frequent, F.col("most.near")).alias("form"), F.when(frequent, -F.col("most.minus")).alias("form_n")), "spelling-forms")
    ends = roots(judged.filter(F.col("form").isNotNull()).select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with recursive crc as (select {CRC_TABLE} as t),
runs as (
  select coalesce(doc_id::varchar, '') as doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run from documents),
counted as (select doc, run, count(*) as c from runs where length(run) >= {LETTERS} group by doc, run),
keyed as (select *, doc || ':' || run as k from counted),
hashed as (select run, c, {crc32_sql("k", "t")} as h from keyed, crc),
found as (select case when h % {SLIP} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
vocabulary as (select word, sum(c)::bigint as n from found where length(word) >= {LETTERS} group by word having sum(c) >= {OCCURRENCES}),
cuts as (select word, n, unnest(range(length(word))) as place from vocabulary),
cut as (select word, n, place, left(word, place) || substr(word, place + 2) as rest from cuts),
near as (
  select distinct a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.place = b.place and a.rest = b.rest and a.word <> b.word
  union select distinct a.word, a.n, b.word, b.n from cut a join vocabulary b on a.rest = b.word
  union select distinct b.word, b.n, a.word, a.n from cut a join vocabulary b on a.rest = b.word),
best as (select word, n, count(*) as n_near, arg_min(near, struct_pack(m := -near_n, w := near)) as near, max(near_n) as near_n from near group by word, n),
formed as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= {FREQUENT} * v.n then b.near end as form,
         case when b.near_n >= {FREQUENT} * v.n then b.near_n end as form_n
  from vocabulary v left join best b using (word)),
chains as (
  select word, word as root, form as ahead from formed
  union all
  select c.word, c.ahead, f.form from chains c join formed f on c.ahead = f.word)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from formed f join chains c on f.word = c.word and c.ahead is null
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL = {"op11_spelling_variants": OP11_SQL}
