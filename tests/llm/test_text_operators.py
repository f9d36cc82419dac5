"""Line dedup, SentencePiece, URL filter and decontamination against brute force, awkward cases included."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from quern.llm import decontaminate, line_dedup, pieces, url_filter
from tests.llm.fixtures import SCHEMA, documents, rows, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_lines(docs):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize(("max_bits", "flush"), [(1 << 30, 200_000), (0, 200_000), (0, 1)])
def test_line_dedup(spark, monkeypatch, max_bits, flush):
    monkeypatch.setattr(line_dedup, "FLUSH_KEYS", flush)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(documents(spark), hashes_only=True, max_bits=max_bits).collect()}
    assert got == brute_lines([r[:2] for r in rows()])
    assert sum(v[1] for v in got.values()) == 4


def test_line_dedup_keeps_columns_and_repeated_rows(spark):
    docs = documents(spark, [(5, "x", "en", "s", 1, "x", None, "r", 7, 0.5, "c")] * 2)
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    assert out.filter("doc_id = 5").count() == 3


@pytest.mark.parametrize("max_bits", [1 << 30, 0])
def test_line_dedup_without_ids(spark, max_bits):
    line = "this line is shared by many documents"
    docs = spark.createDataFrame([(1, line), (2, line), (3, line), (None, line), (None, line)], "doc_id long, text string")
    out = [(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(docs, max_bits=max_bits).collect()]
    assert sorted(out, key=str) == [(1, 1), (2, 1), (3, 0), (None, 0), (None, 0)]


def test_line_dedup_full_filter_gives_the_same(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(map(str, line_dedup.dedup_lines(docs, hashes_only=True).collect()))
    monkeypatch.setattr(line_dedup, "hashed", lambda keys: __import__("numpy").zeros(len(list(keys)), "uint64"))
    assert sorted(map(str, line_dedup.dedup_lines(docs, hashes_only=True).collect())) == want


def test_line_dedup_by_sorting_gives_the_same(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(map(str, line_dedup.dedup_lines(docs, hashes_only=True).collect()))
    monkeypatch.setattr(line_dedup, "HASH_BYTES", 0)
    assert sorted(map(str, line_dedup.dedup_lines(docs, hashes_only=True).collect())) == want


@pytest.mark.parametrize("f", [lambda d: line_dedup.dedup_lines(d), lambda d: pieces.piece_digests(d, pieces.model_path()), lambda d: decontaminate.contamination(d, d.selectExpr("doc_id item_id", "text"))])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sentencepiece_equals_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    s = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(3)
    more = ["".join(r.choice("aeb t  \n\r▁éö你😀;)}{\"<>/*01thinger") for _ in range(r.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts() + more)], "doc_id long, text string")
    got = {x.doc_id: x for x in pieces.piece_digests(docs, pieces.model_path(), with_ids=True).collect()}
    for i, t in enumerate(texts() + more):
        ids = s.encode(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == s.decode(ids) == pieces.vocabulary(pieces.model_path()).decode(ids)
        assert got[i].ids_sha256 == sha(",".join(map(str, ids))) and got[i].decoded_sha256 == sha(s.decode(ids))


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/de/x?y", "https://a.example.net/en/p", "https://a.example.net/fr/p", "http://x.org/fr/1#t", "http://bad.host.de/x", "http://good.de/page", "http://good.de/spam/deep/1.html", "http://notbad.host.de/", "ftp://org/fr/", "http://ex%C3%A4.net"]


@pytest.mark.parametrize("shard_bytes", [16 << 20, 8])
def test_url_filter(spark, shard_bytes):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict int")
    block = spark.createDataFrame([("bad.host.de",), ("good.de/spam/",), (None,), ("bad.host.de",)], "entry string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, block, shard_bytes=shard_bytes).collect()}
    for i, u in enumerate(URLS * 2):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fit = [(h + p, k) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda f: len(f[0])) if fit else (None, None)
        own = host == "bad.host.de" or (host == "good.de" and path.startswith("/spam/"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or ("block" if own else "allow"))


@pytest.mark.parametrize("shard_bytes", [16 << 20, 256])
def test_url_filter_by_the_default_list(spark, shard_bytes):
    urls = ["http://cheap-pills.example.de/", "http://m.cheap-pills.example.org/a", "http://cheap-pills.org/", "http://pills-cheap.org/", "http://a.b.com/casino/x", "http://a.b.com/casino", "http://a.b.com/y/casino/", "http://x.com/win/"]
    pages = spark.createDataFrame([(i, u, "p", True) for i, u in enumerate(urls)], "page_id long, url string, path string, blocked boolean")
    out = url_filter.filter_urls(pages, url_filter.default_blocklist(spark), shard_bytes=shard_bytes)
    got = [r.blocked for r in out.orderBy("page_id").collect()]
    assert got == [False, True, True, False, True, False, False, True]
    assert url_filter.filter_urls(pages.filter("false"), url_filter.default_blocklist(spark), shard_bytes=shard_bytes).count() == 0
    none = url_filter.filter_urls(pages, url_filter.default_blocklist(spark).filter("false"), shard_bytes=shard_bytes)
    assert not any(r.blocked for r in none.collect())


def test_url_index_of_a_million_entries(spark):
    """Sixteen shards; half of the urls' hosts are listed, and every sixth as a folder."""
    listed = spark.range(1_000_000).selectExpr("if(id % 3 = 0, concat('h', id, '.example.com/x/'), concat('h', id, '.example.com')) as entry")
    index = url_filter.build_index(listed, 4 << 20)
    assert index.bits == 4 and len(index.shards) == 16
    pages = spark.range(999_000, 1_001_000).selectExpr("id as page_id", "concat('http://www.h', id, '.example.com/', if(id % 2 = 0, 'x/1', 'y')) as url")
    got = {r.page_id: r.blocked for r in url_filter.filter_urls(pages, listed, shard_bytes=4 << 20).select("page_id", "blocked").collect()}
    assert got == {i: i < 1_000_000 and (i % 3 > 0 or i % 2 == 0) for i in range(999_000, 1_001_000)}


def test_url_digests_are_those_of_spark(spark):
    keys = [b"", b"a", b"host.de/path/", bytes(range(256)), b"x" * 1000]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k binary").selectExpr("i", "xxhash64(k) as h").orderBy("i").collect()
    assert [r.h for r in rows] == url_filter.digests([bytes(k) for k in keys]).tolist()


def test_url_filter_of_very_long_urls(spark):
    long = ["http://" + "a." * 60_000 + "bad.de/" + "d/" * 60_000, "http://x.bad.de/" + "e/" * 200_000, "http://" + "." * 50_000 + "/" * 50_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(long)], "page_id long, url string")
    block = spark.createDataFrame([("bad.de",), ("worse.example.com/folder/",)], "entry string")
    assert [r.blocked for r in url_filter.filter_urls(pages, block).orderBy("page_id").collect()] == [True, True, False]


def test_url_index_confirms_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digests", lambda keys: __import__("numpy").full(len(keys), 7))
    (tmp_path / "0").write_bytes(url_filter.packed(url_filter.digests("ab"), [b"a.com", b"b.com"]))
    index = url_filter.UrlIndex(f"file://{tmp_path}", [0], 0, 5)
    assert index.contains([b"a.com", b"c.com", b"b.com"]).tolist() == [True, False, True]


def test_url_index_shipped_by_spark(spark, tmp_path):
    """Where the shared folder cannot be mapped, tasks map the copies that Spark's file shipping made."""
    folder = tmp_path / "shipped-urls"
    folder.mkdir()
    (folder / "0").write_bytes(url_filter.packed(url_filter.digests([b"a.com"]), [b"a.com"]))
    spark.sparkContext.addFile(str(folder), recursive=True)
    index = url_filter.UrlIndex(str(folder), [0], 0, 5, shipped=True)
    index.folder = "/elsewhere/shipped-urls"
    assert spark.sparkContext.parallelize([b"a.com", b"b.com"], 2).map(lambda k: bool(index.contains([k])[0])).collect() == [True, False]


@pytest.mark.parametrize("index_bytes", [64 << 20, 0])
def test_decontamination(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 2)
    w = "zero one two three four five six seven eight nine ten eleven twelve".split()
    bench = [("b1", " ".join(w)), ("b2", "Short Item here"), ("b3", " ... "), ("b4", None), ("b5", "the the the the the the the the the the the"), ("b6", " ".join(w))]
    docs = [(1, "x " + " ".join(w[:10]) + " y"), (2, "x " + " ".join(w[:9]) + " y"), (3, "a short, item-HERE. short item here"), (4, None), (5, ""), (6, "the " * 15), (7, " ".join(w) + " " + " ".join(w)), (8, "É " + " ".join(w).upper())]
    got = {r.doc_id: (r.n_words, r.n_hit, ",".join(r.items)) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string"), index_bytes=index_bytes).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    for i, t in docs:
        own, hit, items = split(t), set(), set()
        for b, text in bench:
            x = split(text)
            for s in range(max(1, len(x) - 9)) if x else ():
                win = x[s : s + 10]
                for p in range(len(own) - len(win) + 1):
                    if own[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        items.add(b)
        assert got[i] == (len(own), len(hit), ",".join(sorted(items)))
    assert sum(v[1] > 0 for v in got.values()) == 5


@pytest.mark.parametrize("index_bytes", [64 << 20, 0])
def test_decontamination_of_repeated_and_null_ids(spark, index_bytes):
    item = "zero one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item, 5), (1, "just eleven other words that stand in this text for once", 6), (None, item, 7), (1, item, 5)], "doc_id long, text string, window_id int")
    bench = spark.createDataFrame([("b", item)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.items) for r in decontaminate.contamination(docs, bench, index_bytes=index_bytes).collect())
    assert got == [(0, 11, 11, ["b"]), (1, 11, 0, []), (1, 11, 11, ["b"]), (1, 11, 11, ["b"])]
    kept = decontaminate.drop_contaminated(docs, bench, index_bytes=index_bytes)
    assert kept.columns == docs.columns and [r.window_id for r in kept.collect()] == [6]
    assert decontaminate.drop_contaminated(docs, bench.filter("false")).count() == 4


def test_decontamination_drops_many_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "short item"), (1, "else"), (None, "a short item")], "doc_id long, text string")
    assert [r.text for r in decontaminate.drop_contaminated(docs, spark.createDataFrame([("b", "short item")], "item_id string, text string")).collect()] == ["else"]


def test_stored_tables_can_be_dropped(spark):
    from quern.llm import common

    common.drop_stored(spark)
    kept = common.stored(spark.range(5), "five")
    assert kept.count() == 5 and common.drop_stored(spark) == 1 and common.drop_stored(spark) == 0
