"""Word and sentence expressions; Unicode rules where Python's str methods have them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), "")


def raw_words(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def contained(c: Column, phrases) -> Column:
    """How many of the phrases occur in c."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(p)).cast("int") for p in phrases])


def found(c: Column, pattern: str) -> Column:
    """Whether the pattern matches in c; where it begins with a whole word, a search for the word alone goes first."""
    word = re.match(r"\\b([a-z]+)(?=\\[bs])", pattern)
    return c.rlike(pattern) if word is None else F.contains(c, F.lit(word[1])) & c.rlike(pattern)


def matched(c: Column, patterns) -> Column:
    """How many of the patterns match in c."""
    return reduce(lambda a, b: a + b, [found(c, p).cast("int") for p in patterns])


def best_of(scores: list[tuple[str, Column]]) -> Column:
    """struct<minus, n, name> of the highest score, the first of equal ones; each score is evaluated once."""
    return F.array_min(F.array(*(F.struct((-s).alias("minus"), F.lit(n).alias("n"), F.lit(name).alias("name")) for n, (name, s) in enumerate(scores))))


def once(df, name: str, expression: Column):
    """df with a column that is evaluated once a row: a generator's output is not copied into what uses it."""
    return df.select("*", F.explode(F.array(expression)).alias(name))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def cut_after(c: Column, delimiter: str) -> Column:
    """Segments of c, each with the delimiter that ends it; an empty rest is dropped."""
    return F.filter(F.split(F.regexp_replace(c, f"({delimiter})", "$1\u0001"), "\u0001"), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda x: x != "")
