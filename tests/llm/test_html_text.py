"""Main text of built pages, pages with odd markup, and the whole given table."""

import os
import re
import time
from html import escape

import pytest

from quern.llm import html_text
from quern.llm.html_text import main_text
from tests.oracle import SF_DIR, connection


def say(n, word="word"):
    return " ".join(f"{word}{k}" for k in range(n))


ARTICLE = ["A heading", say(50), "short", say(60, "more"), "x < y & z", "end"]
BODY = f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{escape(x)}</p>" for x in ARTICLE[1:])
MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>All the news of today</a></ul>"
AROUND = {
    "elements": f"<header><h1>Site</h1>{MENU}</header><nav>{MENU}</nav>{{}}<aside>{say(40, 'side')}</aside><form><p>{say(30, 'mail')}</p><input></form><footer>{say(30, 'foot')}</footer>",
    "classes": f"<div id=header><h1>Site</h1></div><div class='main-menu'>{MENU}</div><div class=cookie-notice><p>{say(80, 'cookie')}</p></div>{{}}"
    f"<div class='right sidebar'><p>{say(40, 'side')}</p></div><div class=ad-box>{say(90, 'buy')}</div><section id=comments><article class=comment><p>{say(99, 'reader')}</p></article></section><div id=footer>{say(9, 'foot')}</div>",
    "roles": f"<div role=banner>{say(20, 'top')}</div><div role=navigation>{MENU}</div>{{}}<div role=complementary>{say(40, 'side')}</div><div role=alert>{say(30, 'note')}</div><div hidden>{say(99, 'gone')}</div>",
    "nothing": "{}",
    "scripts": f"<script>if (a<b) {{{{ x = '<p>{say(50, 'js')}</p>' }}}}</script><style>p {{{{ margin: 0 }}}}</style><!-- <p>{say(50, 'comment')}</p> -->{{}}<noscript>{say(20, 'no')}</noscript>",
}
INSIDE = {"article": "<article>{}</article>", "main": "<main>{}</main>", "div": "<div class=x7>{}</div>", "nested": "<div><div class=post-content><div>{}</div></div></div>", "aside": "<article>{}<aside>" + say(30, "aside") + "</aside><div class=share>Tell a friend</div></article>"}


@pytest.mark.parametrize("inside", INSIDE)
@pytest.mark.parametrize("around", AROUND)
def test_article_of_a_page(around, inside):
    page = "<!DOCTYPE html><html><head><title>A title</title></head><body>" + AROUND[around].format(INSIDE[inside].format(BODY)) + "</body></html>"
    assert main_text(page) == "\n".join(ARTICLE)


def test_markup_that_is_left_open():
    assert main_text("<body><nav><ul><li>a<li>b</ul><article><h1>T<p>one <b>two<p>three<br>four</article>") == "T\none two\nthree four"
    assert main_text(f"<article><p>{say(9)}</p></article><script>var x = '") == say(9)
    assert main_text("<p>one &amp two &eacute; &#x41; &nope; <!-- no end") == "one & two é A &nope;"
    assert main_text("<p>one</p><p>two<") == "one\ntwo"
    assert main_text("just text &amp; 1 < 2 & more") == "just text & 1 < 2 & more"
    assert main_text(f"<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl><p>{say(20)}</article>") == f"a\nb\nc\nd\ne\n{say(20)}"


def test_flat_page_and_heading_outside():
    assert main_text(f"<body>{MENU}{BODY}<p><a href=x>link</a>") == "\n".join(ARTICLE)
    assert main_text(f"<div><div class=t><h1>T</h1></div><div class=b><p>{say(40)}<p>{say(50)}</div></div>") == f"T\n{say(40)}\n{say(50)}"
    assert main_text(f"<div class=a>{say(60, 'noise')}</div><div class=b><h1>T</h1><p>{say(50)}<p>{say(50)}<p>{say(50)}</div>") == "\n".join(["T"] + [say(50)] * 3)


@pytest.mark.parametrize("text", ["<div>" * 50_000 + "x", "<!--" * 50_000, "<a " * 50_000, "<" * 100_000, "<ul><li>" * 20_000 + "<li>" * 20_000, "</p>" * 50_000, "<script>" + "</" * 50_000, "<p " + "a=" * 50_000 + ">x", "&" * 100_000])
def test_time_is_linear(text):
    began = time.time()
    main_text(text)
    assert time.time() - began < 10


def test_rows(spark):
    pages = [(1, None, "u", "old", 7, "h"), (2, "", "u", "old", 7, "h"), (3, f"<p>{say(90_000)}", "u", "old", 7, "h"), (3, f"<p>{say(90_000)}", "u", "old", 7, "h"), (None, "<p>é&lt;", None, "old", 7, "h")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string, text string, n_chars int, _html string").repartition(2)
    out = html_text.extract_main_text(df)
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars, r._html) for r in out.collect())
    assert got == sorted([("1", "u", "", 0, "h"), ("2", "u", "", 0, "h"), *[("3", "u", say(90_000), len(say(90_000)), "h")] * 2, ("None", None, "é<", 2, "h")])
    assert html_text.extract_main_text(df.filter("false")).count() == 0
    assert "html" in html_text.extract_main_text(df, keep_html=True).columns


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_given_pages(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op13_html_extraction(spark, SF_DIR).collect()}
    want = {i: (t, n) for i, _, t, n in connection().execute(html_text.OP13_SQL).fetchall()}
    assert got == want and all(re.search(r"\S", t) for t, _ in got.values())
