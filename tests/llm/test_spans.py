"""Places, meeting spans and free parts against plain versions; long texts of many matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quern.llm import pii, secrets_scan, spans


def test_running_and_places(spark):
    r = random.Random(1)
    texts = ["", "x", "a1b22c", "".join(r.choice("ab1 é😀") for _ in range(700)), None, "1" * 50]
    df = spark.createDataFrame([(i, t, [r.randrange(-9, 9) for _ in range(i * 7)]) for i, t in enumerate(texts)], "id int, t string, v array<int>")
    for x in df.select("t", "v", spans.running(F.col("v"), spans.add).alias("sums"), spans.running(F.col("v"), F.greatest).alias("most"), spans.matches(F.col("t"), "[0-9a]+", F.lit(True)).alias("m")).collect():
        assert x.sums == [sum(x.v[: k + 1]) for k in range(len(x.v))] and x.most == [max(x.v[: k + 1]) for k in range(len(x.v))]
        assert [(m.s, m.e, m.m) for m in x.m] == [(*m.span(), m[0]) for m in re.finditer("[0-9a]+", x.t or "")]


def test_cut(spark):
    text = "".join(random.Random(2).choice("ab é😀\n") for _ in range(1500))
    places = [(s, n) for s in (0, 1, 255, 256, 257, 700, 1499, 1500) for n in (0, 1, 60, 256, 600)]
    df = spark.createDataFrame([(text, s, n) for s, n in places], "t string, s int, n int")
    assert [x.c for x in df.select(spans.cut(spans.pieces(F.col("t")), F.col("s"), F.col("n")).alias("c")).collect()] == [text[s : s + n] for s, n in places]


def test_meeting_and_free_parts(spark):
    r, rows = random.Random(3), []
    for i in range(200):
        own, at = [], 0
        while at < 60 and r.random() < 0.9:
            s = at + r.randrange(4)
            at = s + r.randrange(1, 6)
            own.append((s, at))
        rows.append((i, own, [(s, s + r.randrange(1, 9), r.randrange(4)) for s in (r.randrange(60) for _ in range(r.randrange(7)))]))
    df = spark.createDataFrame(rows, "id int, own array<struct<s:int,e:int>>, rest array<struct<s:int,e:int,k:int>>")
    for x in df.select("own", "rest", spans.met(F.col("own"), F.col("rest")).alias("met"), spans.outside(F.col("own"), F.col("rest")).alias("free")).collect():
        covered = {p for o in x.rest for p in range(o.s, o.e)}
        want = []
        for y, o in zip(x.met, x.own):
            kinds = {b.k for b in x.rest if b.s < o.e and o.s < b.e}
            assert (y.x.s, y.x.e) == (o.s, o.e) and (y.k in kinds if kinds else y.k is None)
            part = []
            for p in range(o.s, o.e):
                if p not in covered:
                    part = [part[0], p + 1] if part and part[1] == p else (want.append(tuple(part)) if part else None) or [p, p + 1]
            if part:
                want.append(tuple(part))
        # neighbours of two spans that touch are two parts
        assert [(f.s, f.e) for f in x.free] == want


LONG = {
    "addresses": " ".join(f"10.{i % 250}.{i // 250 % 250}.{i % 7}" for i in range(80_000)),
    "identifiers": " ".join(f"some_identifier{i % 977}" if i % 2 else f"{i:032x}" for i in range(60_000)),
    "token": "".join(random.Random(4).choice("abcXYZ019_") for _ in range(1_000_000)),
}


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize("find", [pii.find_pii, secrets_scan.find_secrets])
def test_long_texts_take_linear_time(spark, find, name):
    text = LONG[name]
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    find(docs.filter("doc_id = 2")).collect()
    began = time.time()
    out = {r.doc_id: len(r.base) for r in find(docs).collect()}
    took = time.time() - began
    print(name, find.__name__, round(took, 1))
    if name == "addresses" and find is pii.find_pii:
        assert out[1] == 80_000
    assert took < 60
