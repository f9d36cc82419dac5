r"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers.

The base spans are exact. The method then judges every other token that looks like an identifier: two first-order character
models, one of random strings and one of ordinary identifiers, give each pair of neighbouring characters a log-likelihood
ratio, and a token whose mean ratio is above a threshold is a secret of kind `random`. A pair's probability is mixed with its
second character's by a share of BACK_OFF, so that characters which ordinary words lack tell even after a character that they lack too; each character
has a share of SMOOTHING at least, whatever the size of the sample.

The models are trained on labelled samples: keys over the usual alphabets and identifiers of the usual shapes, uuids, dates and paths
included, made by rule (secret_samples), and what all documents label: the values that the base patterns found are random strings,
and plain words that occur RECURRING times or more are ordinary. A distinct string of n occurrences counts 1 + log2(n) times, so that
copies of a document weigh little. The threshold is the score that parts labelled strings of another seed best. Their tables are counts of character pairs, at most 67 x 67 entries by construction, and enter
the query as one literal array. Everything is DataFrame functions; texts are never shuffled.

Defined cases: a null or empty text has no spans; long texts are scanned whole;
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed, stored, table
from .secret_samples import identifier_strings, key_strings
from .spans import cut, let, matches, met, outside, pieces, spans_text, tagged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{16,}"
#: Characters of the models; all others share the last place, and a token begins and ends there.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1
#: Tokens that the method judges: SHORTEST characters or more, with a letter.
SHORTEST = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
ORDINARY = r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z_-]{8,}+(?![A-Za-z0-9+/_=@])"
SMOOTHING, BACK_OFF = 1e-4, 0.1
#: Seeds of the labelled strings that are learned from and of those that set the threshold, and how many missed keys a false alarm costs.
TRAINED, HELD_OUT, COST = 1, 2, 5
#: Occurrences of an ordinary word in all documents.
RECURRING = 5


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds."""
    value = lambda m: F.regexp_extract(m, ASSIGN, 1)
    assign = F.filter(matches(text, ASSIGN, F.lit(True)), lambda x: F.length(value(x["m"])) >= 12)
    access = F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: F.length(x["m"]) >= 18)
    hexes = matches(text, HEX, F.lit(True))
    return F.concat(tagged(assign, KINDS, "assign"), tagged(access, KINDS, "access"), tagged(hexes, KINDS, "hex"))


def pairs(token: Column) -> Column:
    """The transition numbers of a token."""
    place = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)) - 1, F.lit(STATES - 1))
    places = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), place)
    edge = F.array(F.lit(STATES - 1))
    return let(F.concat(edge, places, edge), lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: x * STATES + y))


def ratios(found: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, random over ordinary; found: (random, pair), one row a transition count n."""
    rows = found.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 x STATES x STATES
    counts = {True: [0] * STATES**2, False: [0] * STATES**2}
    for r in rows:
        counts[r.random][r.pair] += r.n
    logs = {}
    for kind, c in counts.items():
        total = sum(c)
        single = [(sum(c[j::STATES]) / total + SMOOTHING) / (1 + SMOOTHING * STATES) for j in range(STATES)]
        sums = [sum(c[i * STATES : (i + 1) * STATES]) for i in range(STATES)]
        logs[kind] = [math.log(BACK_OFF * single[i % STATES] + (1 - BACK_OFF) * (x / n if (n := sums[i // STATES]) else single[i % STATES])) for i, x in enumerate(c)]
    return [round(a - b, 4) for a, b in zip(logs[True], logs[False])]


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens, values): base spans, tokens to judge outside them, and the random strings."""
    text = F.col("text")
    own = computed(docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")), "base", base_spans(text))
    own = computed(computed(own, "all", matches(text, TOKEN, F.lit(True))), "parts", F.when(F.size("base") > 0, pieces(text)).otherwise(F.array().cast("array<string>")))
    spelt = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), cut(F.col("parts"), x["s"], x["e"] - x["s"]).alias("m"))
    judged = computed(own, "met", met(F.col("all"), F.col("base")))
    whole = F.transform(F.filter("met", lambda x: x["k"].isNull()), lambda x: x["x"])
    part = F.transform(F.filter(outside(F.transform(F.filter("met", lambda x: x["k"].isNotNull()), lambda x: x["x"]), F.col("base")), lambda x: x["e"] - x["s"] >= SHORTEST), spelt)
    # parts without a letter are no tokens
    free = F.when(F.size("base") == 0, F.col("all")).otherwise(F.concat(whole, F.filter(part, lambda x: x["m"].rlike("[A-Za-z]"))))
    values = F.transform("base", lambda b: F.regexp_extract(cut(F.col("parts"), b["s"], b["e"] - b["s"]), r"([A-Za-z0-9+/_=-]+)\.?$", 1))
    return judged.select("doc_id", "base", free.alias("tokens"), values.alias("values"))


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(w, n): every plain word that recurs in all documents, with its count."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(ORDINARY), F.lit(0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= RECURRING)


def score_of(ratio: Column, token: Column) -> Column:
    """The mean log-likelihood ratio of a token's pairs."""
    return F.aggregate(pairs(token), F.lit(0.0), lambda a, p: a + F.element_at(ratio, p + 1)) / (F.length(token) + 1)


def threshold_of(spark: SparkSession, ratio: Column) -> float:
    """The score that parts held-out keys and identifiers best: most keys above it, less COST times the share of identifiers above it."""
    held = key_strings(spark, HELD_OUT).select(F.lit(True).alias("random"), "w").union(identifier_strings(spark, HELD_OUT).select(F.lit(False), "w"))
    rows = held.filter(F.length("w") >= SHORTEST).select("random", score_of(ratio, F.col("w")).alias("score")).collect()  # a bounded sample
    rows.sort(key=lambda r: -r.score)
    n, hits, best, at = {k: max(1, sum(r.random == k for r in rows)) for k in (True, False)}, {True: 0, False: 0}, 0.0, rows[0].score
    for r, after in zip(rows, [*rows[1:], rows[-1]]):
        hits[r.random] += 1
        gain = hits[True] / n[True] - COST * hits[False] / n[False]
        if gain > best:
            best, at = gain, (r.score + after.score) / 2
    return at


def find_secrets(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, base, added): span arrays for each document. threshold: instead of the one that held-out strings give."""
    spark = docs.sparkSession
    found = stored(scanned(docs), "secrets")
    random = found.select(F.explode("values").alias("w")).filter(F.length("w") >= 12).groupBy("w").agg(F.count("*").alias("n"))
    labelled = key_strings(spark, TRAINED).select(F.lit(True).alias("random"), "w", F.lit(1).alias("n")).union(identifier_strings(spark, TRAINED).select(F.lit(False), "w", F.lit(1)))
    both = random.select(F.lit(True).alias("random"), "w", "n").union(ordinary_words(docs).select(F.lit(False), "w", "n")).union(labelled)
    weighed = both.select("random", "w", (1 + F.floor(F.log2("n"))).alias("n"))
    ratio = F.lit(ratios(weighed.select("random", "n", F.explode(pairs(F.col("w"))).alias("pair"))))
    bound = threshold_of(spark, ratio) if threshold is None else threshold
    added = tagged(F.filter("tokens", lambda t: score_of(ratio, t["m"]) > bound), KINDS, "random")
    return found.select("doc_id", "base", added.alias("added"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))


QUERIES = {"op10_secret_scans": op10_secret_scans}
SQL: dict[str, str] = {}
