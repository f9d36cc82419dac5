"""Labelled strings for the character models of secret scans: keys by their alphabets, and ordinary identifiers by their shapes.

Everything is DataFrame functions of a row's number; a seed gives another sample of the same kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 4000
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of keys, with the share of the sample that each has by its repeats.
ALPHABETS = (LETTERS + LETTERS.upper() + DIGITS,) * 4 + (LETTERS + LETTERS.upper() + DIGITS + "+/",) * 2 + (LETTERS + LETTERS.upper() + DIGITS + "-_", LETTERS.upper() + DIGITS, LETTERS + DIGITS, LETTERS + LETTERS.upper())
#: Words of names in code, files and addresses.
WORDS = (
    "account action address admin agent alert api app archive array async audio author backup balance batch billing block buffer build button cache calendar callback camera category change channel chart check "
    "client cluster code color column command comment commit common component config connect console contact container content context control convert cookie copy count country create currency current customer "
    "dashboard data date debug default delete deploy detail device dialog directory display document domain download driver edit editor element email employee encode engine entity entry error event example export "
    "factory failure feature field file filter final finance folder footer format forward frame function gateway general get global graph group handler hash header health height history home host hotel image img "
    "import index info input insert install instance integer inventory invoice item job journal json key label language layout length level library license limit link list load local location lock log login main "
    "manager map market master material max memory menu merge message method metric migrate min model module month name network node note number object offer office option order output owner package page parent "
    "parse patch path payment percent person phone photo picture player plugin point policy port position post price print private process product profile program project property provider public purchase quality "
    "quantity query queue quick random range rate read record redirect refresh region register release remote remove render replace report request reset resource response result return review right role root route "
    "row rule sales sample schedule schema screen script search section select sequence series server service session setting shape share sheet shipping show size snapshot sort source space split stack staff stage "
    "start state static status step stock storage store stream string student style submit subject summary supplier support switch symbol sync system table target task team template terminal test text theme thread "
    "ticket time title token tool total track traffic transaction transfer type unit update upload url usage user utility valid value vendor version video view visit wait warehouse watch weather web week "
    "weight widget width window word worker workflow wrapper write year zone"
).split()


def draw(n: int, *of: Column) -> Column:
    """A number below n from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")


def digits(n: int, *of: Column) -> Column:
    return F.lpad(draw(10**n, *of).cast("string"), n, "0")


def key_strings(spark: SparkSession, seed: int, rows: int = ROWS) -> DataFrame:
    """(w): uniform strings of 14 to 45 characters over each alphabet."""
    k, s = F.col("id"), F.lit(seed)
    alphabet = F.get(F.array(*map(F.lit, ALPHABETS)), draw(len(ALPHABETS), k, s, F.lit("a")))
    own = spark.range(rows).withColumn("alphabet", alphabet).withColumn("n", 14 + draw(32, k, s, F.lit("n")))
    place = lambda i: F.pmod(F.xxhash64(k, s, i), F.length("alphabet")).cast("int") + 1
    return own.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.col("alphabet"), place(i), F.lit(1))), "").alias("w"))


def identifier_strings(spark: SparkSession, seed: int, rows: int = ROWS) -> DataFrame:
    """(w): names joined as code, files and addresses join them, dates and times, versions, numbers in groups and uuids."""
    k, s = F.col("id"), F.lit(seed)
    word = lambda name: F.get(F.array(*map(F.lit, WORDS)), draw(len(WORDS), k, s, F.lit(name)))
    hexes = lambda n, name: F.substring(F.sha2(F.concat_ws("-", k.cast("string"), s.cast("string"), F.lit(name)), 256), 1, n)
    year, month, day, time = (F.concat(F.lit("20"), digits(2, k, s, F.lit("y"))), F.lpad((1 + draw(12, k, s, F.lit("m"))).cast("string"), 2, "0"), F.lpad((1 + draw(28, k, s, F.lit("d"))).cast("string"), 2, "0"), digits(6, k, s, F.lit("t")))
    date = F.concat_ws("-", year, month, day)
    a, b, c, small = word("1"), word("2"), word("3"), draw(100, k, s, F.lit("v")).cast("string")
    shapes = (
        F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c), small), F.concat_ws("_", F.upper(a), F.upper(b), F.upper(c)),
        F.concat_ws("/", a, b, c), F.concat_ws("_", a, date), F.concat(F.initcap(a), F.lit("-"), date), F.concat_ws("_", F.upper(a), F.concat(year, month, day), time), F.concat(a, F.lit("_"), F.concat(year, month, day), F.lit("_"), time),
        F.concat(date, F.lit("T"), time, F.lit("Z")), F.concat(a, F.lit("-"), b, F.lit("-v"), small, F.lit("-"), digits(2, k, s, F.lit("p"))), F.concat(F.upper(F.substring(a, 1, 3)), F.lit("-"), digits(5, k, s, F.lit("q")), F.lit("-"), digits(4, k, s, F.lit("r"))),
        F.concat_ws("-", F.lit("978"), digits(1, k, s, F.lit("e")), digits(4, k, s, F.lit("f")), digits(5, k, s, F.lit("g")), F.concat(digits(1, k, s, F.lit("h")), F.substring(F.lit("abx"), draw(3, k, s, F.lit("x")) + 1, F.lit(1)))),
        F.concat_ws("-", hexes(8, "u"), hexes(4, "v"), hexes(4, "w"), hexes(4, "x"), hexes(12, "y")), F.concat_ws("-", hexes(8, "z"), hexes(4, "v"), hexes(4, "w"), hexes(4, "x"), hexes(12, "y")),
    )
    return spark.range(rows).select(F.get(F.array(*shapes), draw(len(shapes), k, s, F.lit("shape"))).alias("w"))
