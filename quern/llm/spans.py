"""Where a pattern matches in a text, and which spans meet, in DataFrame functions alone.

Everything is linear in a text and its matches but for sorting and running sums, which take a factor of the logarithm: no array grows
by one element at a time, no list is searched for each element of another, and no text is cut from its start for each match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
#: Code points of a piece that a text is cut into once.
PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative op: after a round of width 1, 2, 4... each element has its last 2, 4, 8... taken together."""
    widths = F.array(*(F.lit(1 << k) for k in range(31)))
    step = lambda acc, w: F.transform(acc, lambda x, i: F.when(i >= w, op(x, F.get(acc, i - w))).otherwise(x))
    return let(values, lambda v: F.aggregate(F.filter(widths, lambda w: w < F.size(v)), v, step))


def add(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches with code point places from 0, end exclusive; none without guard.

    A split by the pattern gives what stands between matches, so the places are running sums of lengths.
    """
    between = F.split(text, pattern, -1)
    placed = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(
            running(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.length(b) + F.length(m)), add),
            lambda ends: F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))),
        ),
    )
    return F.when(guard & text.rlike(pattern), placed).otherwise(F.array().cast(SPAN))


def pieces(text: Column) -> Column:
    """A text as an array of pieces, for cut()."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, n: Column) -> Column:
    """n code points from start (from 0) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + n - 1) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), start - first * PIECE + 1, n)


def met(spans: Column, others: Column) -> Column:
    """array<struct<x, k>>: each of spans, with the k (0 to 7) of one of others that overlaps it, or null. Both: array<struct<s, e, ...>>, others with k.

    In the order of starts, one that overlaps is the one before with the largest end, or the next one.
    """

    def marked(own: Column, rest: Column) -> Column:
        far = F.lit(1 << 40)
        no_place = F.lit(None).cast("int")
        events = F.concat(
            F.transform(rest, lambda o: F.struct(o["s"].alias("s"), F.lit(0).alias("own"), o["e"].alias("e"), o["k"].cast("long").alias("k"), no_place.alias("j"))),
            F.transform(own, lambda x, j: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e"), F.lit(0).cast("long").alias("k"), j.alias("j"))),
        )

        def joined(u: Column) -> Column:
            back = running(F.transform(u, lambda x: F.when(x["own"] == 0, x["e"] * 8 + x["k"]).otherwise(F.lit(-1).cast("long"))), F.greatest)
            ahead = F.reverse(running(F.reverse(F.transform(u, lambda x: F.when(x["own"] == 0, x["s"] * 8 + x["k"]).otherwise(far))), F.least))
            kind = lambda b, a, x: F.when(F.floor(b / 8) > x["s"], F.pmod(b, F.lit(8))).when(F.floor(a / 8) < x["e"], F.pmod(a, F.lit(8)))
            found = let(back, lambda b: let(ahead, lambda a: F.transform(u, lambda x, i: F.struct(x["own"].alias("own"), x["j"].alias("j"), kind(F.get(b, i), F.get(a, i), x).cast("int").alias("k")))))
            return F.array_sort(F.transform(F.filter(found, lambda x: x["own"] == 1), lambda x: F.struct(x["j"].alias("j"), x["k"].alias("k"))))

        return F.zip_with(own, let(F.array_sort(events), joined), lambda x, y: F.struct(x.alias("x"), y["k"].alias("k")))

    none = F.lit(None).cast("int")
    return let(spans, lambda own: let(others, lambda rest: F.when((F.size(own) > 0) & (F.size(rest) > 0), marked(own, rest)).otherwise(F.transform(own, lambda x: F.struct(x.alias("x"), none.alias("k"))))))


def outside(spans: Column, others: Column) -> Column:
    """array<struct<s, e>>: the parts of disjoint spans that no other span covers.

    Starts and ends in order; a part lies between two neighbours where one span is open and no other one.
    """
    one = 1 << 32
    event = lambda at, d: F.struct(at.alias("at"), F.lit(d).cast("long").alias("d"))
    events = F.array_sort(F.flatten(F.concat(F.transform(spans, lambda x: F.array(event(x["s"], 1), event(x["e"], -1))), F.transform(others, lambda x: F.array(event(x["s"], one), event(x["e"], -one))))))
    parts = let(
        events,
        lambda u: let(
            running(F.transform(u, lambda x: x["d"]), add),
            lambda open_: F.transform(u, lambda x, i: F.struct(x["at"].alias("s"), F.coalesce(F.get(u, i + 1)["at"], x["at"]).alias("e"), F.get(open_, i).alias("open"))),
        ),
    )
    return F.transform(F.filter(parts, lambda x: (x["open"] == 1) & (x["s"] < x["e"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, of array<struct<s, k, e, kind>>."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def tagged(found: Column, kinds: tuple[str, ...], kind: str) -> Column:
    """Matches of one kind as array<struct<s, k, e, kind>>."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kinds.index(kind)).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))
