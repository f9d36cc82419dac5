"""Spelling variants against all pairs, generation against strings, and awkward texts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import spelling
from tests.llm.fixtures import SCHEMA, documents, rows

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def texts(seed=5):
    r = random.Random(seed)
    stems = ["receive", "Strasse", "café" * 2, "aaaaaa", "abcabcabc", "ÀÉÿlemon", "z" * 70, "qx" * 40]
    out = []
    for k in range(260):
        words = []
        for _ in range(30):
            w = r.choice(stems)
            if r.random() < 0.4:
                at, kind = r.randrange(len(w)), r.randrange(3)
                w = w[:at] + ("" if kind == 0 else r.choice("abz")) + w[at + (kind < 2) :]
            words += [w] * r.choice((1, 1, 6, 40))
        out.append((k % 250, " ".join(words) + " short x1yyyyyyy2"))
    return [*out, (None, "nobody's receives " * 9), (900, None), (901, ""), (902, "h" * 300_000 + " " + ("g" * 9_000 + " ") * 5 + ("g" * 9_001 + " ") * 30)]


@pytest.mark.parametrize("symbols", [8, 2])
def test_variants(spark, symbols):
    docs = spark.createDataFrame([(*x, 1, 2) for x in texts()], "doc_id long, text string, word int, n int").repartition(4)
    out = spelling.variants(docs, symbols).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute(texts())
    assert len(out) == len({r.word for r in out}) and any(r.root not in (r.word, r.form) for r in out) and any(len(r.word) > 9_000 for r in out)


def test_nothing_and_shared_fixture(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(documents(spark).filter("text is null or text = ''")).count() == 0
    got = spelling.variants(documents(spark, [rows()[5]] * 9)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute([r[:2] for r in [*rows(), *[rows()[5]] * 9]])


def test_neighbourhood_meets_every_reduced_edit_once():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(6, 12))) for _ in range(60)] + ["aaaaaa", "x" * 30]
    flat, lengths = spelling.reduced(words, 3)
    parts = np.split(flat, np.cumsum(lengths)[:-1])
    own = spelling.keys(words, 3)
    sent = [set() for _ in words]
    for of, hashes in spelling.neighbourhood(words, 3):
        for k, h in zip(of, hashes):
            assert int(h) not in sent[k]
            sent[k].add(int(h))
    for a in range(len(words)):
        for b in range(len(words)):
            x, y = ("".join(map(str, p)) for p in (parts[a], parts[b]))
            met = (int(own[b]) in sent[a]) + (int(own[a]) in sent[b])
            assert met == (2 if x == y else 1 if one_edit(x, y) else 0)
