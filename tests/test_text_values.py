"""Values of the text metrics, hashed terms, page text and windowed streams against plain Python over the given tables."""

import html
import math
import os
import re
from collections import Counter, defaultdict

import pytest

from quern.operators import evaluate as E
from quern.operators.fusion import keyword_vector
from quern.plans import catalog
from quern.plans.inputs import read
from quern.sources import tabular
from tests.oracle import SF_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
PAIRS = [("the cat sat on the mat", "the cat is on the mat"), ("a b c d e", "a b c d e"), ("A b", "a B c d"), ("x y z", "a b c"), ("", "a"), (None, "a b"), ("one", "one"), ("a a a a", "a b a"), ("w1 w2 w3 w4 w5 w6 w7", "w7 w6 w5 w1 w2 w3 w4")]


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def bleu(candidate, reference, order):
    """Products of the first precisions, smoothed where nothing matches."""
    x, y = (candidate or "").lower().split(), (reference or "").lower().split()
    if not set(x) & set(y):
        return 0.0
    product, misses = 1.0, 0
    for n in range(1, order + 1):
        left, hits = Counter(grams(y, n)), 0
        for g in grams(x, n):
            if left[g] > 0:
                left[g] -= 1
                hits += 1
        if not hits:
            misses += 1
            hits = math.log(len(x)) / (5 * 2**misses) if len(x) > 1 else 0.0
        product *= hits / max(1, len(grams(x, n)))
    return product ** (1 / order) * min(1.0, math.exp(1 - len(y) / len(x)))


def common(x, y, memo):
    """Length of the longest common subsequence, by its recursion."""
    key = len(x), len(y)
    if not x or not y:
        return 0
    if key not in memo:
        memo[key] = common(x[:-1], y[:-1], memo) + 1 if x[-1] == y[-1] else max(common(x[:-1], y, memo), common(x, y[:-1], memo))
    return memo[key]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "id long, candidate string, reference string")


def test_bleu(spark, pairs):
    for r in E.bleu(pairs).collect():
        assert [r[f"bleu_{n}"] for n in range(1, 5)] == pytest.approx([bleu(*PAIRS[r.id], n) for n in range(1, 5)], abs=1e-9)


def test_rouge_l(spark, pairs):
    rows = E.rouge_l(pairs).collect()
    assert len(rows) == len(PAIRS)
    for r in rows:
        x, y = ((t or "").lower().split() for t in PAIRS[r.id])
        m = common(x, y, {})
        p, q = m / len(x) if x else 0.0, m / len(y) if y else 0.0
        assert (r.precision, r["recall"], r.f) == pytest.approx((p, q, 2 * p * q / (p + q) if m else 0.0))


def test_keyword_vector_counts_every_term_in_one_slot(spark):
    texts = {1: "alpha beta alpha", 2: "beta gamma", 3: "", 4: "alpha " * 500}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = defaultdict(dict)
    for r in keyword_vector(d).collect():
        found[r.doc_id][r.slot] = r.w
    terms = {r.t: r.s for r in spark.sql("select t, pmod(hash(t), 1000) s from values 'alpha', 'beta', 'gamma' as v(t)").collect()}
    assert len(set(terms.values())) == 3
    assert found == {i: {terms[w]: float(n) for w, n in Counter(t.split()).items()} for i, t in texts.items() if t.split()}


def test_html_pages_keep_every_visible_word(spark):
    """By deletion instead of a parser: what is left of a page without scripts, styles, comments and tags."""
    for r in tabular.scan_html_pages(read(spark, SF_DIR, "pages")).join(read(spark, SF_DIR, "pages").select("page_id", "html"), "page_id").collect():
        page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", r.html)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
        assert (r.title or "") == (html.unescape(title[1]).strip() if title else "")
        visible = set(html.unescape(re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<head\b.*?</head>", " ", page))).split())
        assert set(r.text.split()) <= visible
        body = re.findall(r"(?is)<p\b[^>]*>(.*?)</p>", page)
        article = " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", p)) for p in body).split()
        assert len(article) == 0 or len(set(article) & set(r.text.split())) >= 0.9 * len(set(article))


def test_windowed_streams_equal_batches(spark):
    """Events by hour and type, counted in Python; hours that the last watermark leaves open are absent."""
    events = [(r.ts, r.event_type) for r in read(spark, SF_DIR, "events").selectExpr("unix_timestamp(ts) as ts", "event_type").collect()]
    want = Counter((ts // 3600 * 3600, kind) for ts, kind in events)
    got = {(r.hour, r.event_type): r.n for r in catalog.QUERIES["stream_event_log"](spark, SF_DIR).collect()}
    assert got and all(want[key] == n for key, n in got.items())
    closed = max(ts for ts, _ in events) - 3600
    assert {key for key in want if key[0] + 3600 <= closed} <= set(got)
