r"""Personal data: base patterns, and bootstrapped contextual extraction.

The base spans are exact. They seed the method, which runs on a table of instances: each identifier-like token of any document
(a run with five digits or more, four numbers in a row, or one with a written-out at sign) with the words around it, and each base span that holds none,
as plain e-mails do. A seed is an instance that a base span covers; it has that span's kind. An instance's contexts are lexical
patterns: its last word before, its last two words before, and the word before with the word after, each with the instance's
shape: a class of its count of digits, or one shape for e-mails and names with a written-out at sign, and one for four numbers.

Spark scores the pattern-instance graph in rounds: a pattern's confidence in a kind is the share of its instances that are known of
the kind, shrunk by PRIOR unknown ones, and counts only with MIN_SUPPORT distinct known instances; an instance's confidence is that
of the best combination, 1 - (1 - c1)(1 - c2)... over its patterns. Instances above KEEP become known, stay so, and support
patterns in the next round, until a round finds none. What is known in the end and no base span is an added span.

The text is read once; instances go on in a slim table, keyed and pre-aggregated by pattern, and are joined back by the
document's place. Everything is DataFrame functions.

Defined cases: a null or empty text has no spans; long texts are scanned whole; without seeds nothing is added; an instance that
overlaps a base span is never added; rows with the same doc_id are told apart by their own text's hash (repeated rows give
repeated rows); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, computed, stored, table
from .spans import cut, matches, met, pieces, spans_text, tagged

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: A look-behind or the last match's end stands before each run, so that a long run is tried once only.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SMALL = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Four numbers with any light punctuation or a written-out dot between them.
QUAD = r"(?<![0-9])[0-9]{1,3}(?:\x20?[\[(]?(?:[.,:]|(?i:dot))[\])]?\x20?[0-9]{1,3}){3}(?![0-9])"
#: Identifier-like tokens: such numbers, five digits or more with light punctuation between, or a name with a written-out at sign and dot.
INSTANCE = rf"{QUAD}|" + r"(?<![^\x20\x09-\x0D])[A-Za-z+(#]{0,6}[0-9](?:[\x20]?[().+/:-]{0,2}[0-9]){4,}+[A-Za-z]{0,4}|[A-Za-z0-9._-]{2,40}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9.-]{2,40}+(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]{2,40}+){0,4}"
#: Characters around an instance within which a context word must lie; a word that reaches farther is cut there.
AROUND = 60
MIN_SUPPORT, PRIOR, KEEP = 5, 2.0, 0.9


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, kind>> of the base kinds."""
    digit = text.rlike("[0-9]")
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, digit), lambda x: x["m"].rlike(rf"^{SMALL}(?:\.{SMALL}){{3}}$"))
    long_enough = F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: F.length(digits_of(x["m"])).between(14, 19))
    card = F.filter(long_enough, lambda x: luhn(digits_of(x["m"])))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(digits_of(x["m"])).between(10, 15))
    return F.concat(*(tagged(found, KINDS, kind) for found, kind in ((email, "email"), (ip, "ip"), (card, "card"), (phone, "phone"))))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, own, base, found): base spans, and instances with the characters around them; own tells equal doc_ids apart.

    An instance has the number k of the kind of a base span that covers some of it, or null.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    based = computed(own.withColumn("own", F.xxhash64("text")), "base", base_spans(text))
    tokens = computed(based, "tokens", matches(text, INSTANCE, text.rlike(r"[0-9]|[\[(](?i:at)[\])]")))
    parts = computed(tokens, "parts", F.when((F.size("base") > 0) | (F.size("tokens") > 0), pieces(text)).otherwise(F.array().cast("array<string>")))
    instance = lambda s, e, m, k: F.struct(s.alias("s"), e.alias("e"), m.alias("m"), k.alias("k"))
    covered = F.transform(met(F.col("tokens"), F.col("base")), lambda c: instance(c["x"]["s"], c["x"]["e"], c["x"]["m"], c["k"]))
    bare = F.filter(met(F.col("base"), F.transform("tokens", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(0).alias("k")))), lambda c: c["k"].isNull())
    spelt = F.transform(bare, lambda c: instance(c["x"]["s"], c["x"]["e"], cut(F.col("parts"), c["x"]["s"], c["x"]["e"] - c["x"]["s"]), c["x"]["k"]))
    found = computed(parts, "all", F.concat(covered, spelt))
    around = F.transform(
        "all",
        lambda x: F.struct(
            *(x[c].alias(c) for c in ("s", "e", "m", "k")),
            cut(F.col("parts"), F.greatest(F.lit(0), x["s"] - AROUND), F.least(x["s"], F.lit(AROUND))).alias("before"),
            cut(F.col("parts"), x["e"], F.lit(AROUND)).alias("after"),
        ),
    )
    return found.select("doc_id", "own", "base", around.alias("found"))


def patterns_of(instances: DataFrame) -> DataFrame:
    """(id, shape, pattern) of each instance: up to three contexts."""
    word = r"[^\x20\x09-\x0D]+"
    last, two, nxt = rf"({word})[\x20\x09-\x0D]*$", rf"({word}[\x20\x09-\x0D]+{word})[\x20\x09-\x0D]*$", rf"^[\x20\x09-\x0D]*({word})"
    before, after = F.lower("before"), F.lower("after")
    one = F.regexp_extract(before, last, 1)
    contexts = F.array(
        F.when(one != "", F.concat_ws("|", F.lit("1"), "shape", one)),
        F.when(before.rlike(two), F.concat_ws("|", F.lit("2"), "shape", F.regexp_extract(before, two, 1))),
        F.when((one != "") & after.rlike(nxt), F.concat_ws("|", F.lit("3"), "shape", one, F.regexp_extract(after, nxt, 1))),
    )
    return instances.select("id", F.explode(F.array_compact(contexts)).alias("pattern"))


def bootstrap(instances: DataFrame) -> DataFrame:
    """(id, kind): the instances that the rounds found, seeds left out. instances: (id, m, kind or null, shape, before, after)."""
    graph = stored(patterns_of(instances).join(instances.select("id", "m", "kind"), "id"), "pii-graph")
    if not graph.filter(F.col("kind").isNotNull()).head(1) or not graph.filter(F.col("kind").isNull()).head(1):
        return instances.filter("false").select("id", "kind")
    total = stored(graph.groupBy("pattern").agg(F.count("*").alias("n")), "pii-patterns")
    known = graph.select("id", "kind").filter("false")
    while True:
        state = graph.join(known.withColumnRenamed("kind", "_found"), "id", "left").withColumn("now", F.coalesce("kind", "_found"))
        each = state.filter(F.col("now").isNotNull()).groupBy("pattern", "now", "m").agg(F.count("*").alias("n"))
        support = each.groupBy("pattern", "now").agg(F.sum("n").alias("known"), F.count("*").alias("distinct")).filter(F.col("distinct") >= MIN_SUPPORT)
        best = support.join(total, "pattern").select("pattern", F.col("now").alias("kind"), (F.col("known") / (F.col("n") + PRIOR)).alias("c"), "n")
        # a frequent pattern's instances stay where they are
        open_ = state.filter(F.col("now").isNull()).select("id", "pattern")
        scores = best_of_patterns(open_, best).groupBy("id", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("score"))
        top = scores.groupBy("id").agg(F.max(F.struct("score", "kind")).alias("top")).filter(F.col("top.score") >= KEEP)
        new = stored(top.select("id", F.col("top.kind").alias("kind")), "pii-known")
        if not new.head(1):
            return known
        known = known.union(new)


def best_of_patterns(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(id, pattern, kind, c): rows with what their pattern says of each kind."""
    kinds = stored(best.groupBy("pattern").agg(F.collect_list(F.struct("kind", "c")).alias("says"), F.max("n").alias("n")), "pii-best")  # at most one for each kind
    total = kinds.agg(F.sum("n")).first()[0] or 0
    return by_group(rows, kinds, "pattern", total).select("id", "pattern", F.inline("says"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): span arrays for each document."""
    found = stored(scanned(docs), "pii")
    each = found.filter(F.size("found") > 0).select("doc_id", "own", F.explode("found").alias("x")).dropDuplicates(["doc_id", "own", "x"])
    digits = F.length(digits_of(F.col("x.m")))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("x.k"))
    shape = F.when(F.col("x.m").rlike(r"[\[(](?i:at)[\])]") | kind.eqNullSafe("email"), "name").when(F.col("x.m").rlike(rf"^(?:{QUAD})$"), "quad").when(digits < 10, "short").when(digits <= 15, "middle").otherwise("long")
    instances = each.select(
        F.xxhash64("doc_id", "own", "x.s", "x.e").alias("id"), "doc_id", "own", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("m"),
        kind.alias("kind"), shape.alias("shape"), F.col("x.before").alias("before"), F.col("x.after").alias("after"),
    )
    instances = stored(instances, "pii-instances")
    new = bootstrap(instances.select("id", "m", "kind", "shape", "before", "after"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("_kind")).cast("int") - 1
    spans = instances.join(new.withColumnRenamed("kind", "_kind"), "id").groupBy("doc_id", "own").agg(F.collect_list(F.struct("s", number.alias("k"), "e", F.col("_kind").alias("kind"))).alias("added"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    joined = found.select("doc_id", "own", "base").join(spans.withColumnsRenamed({"doc_id": "_doc", "own": "_own"}), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")), "left")
    return joined.select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
