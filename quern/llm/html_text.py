r"""Main text of html pages from the standard library's streaming parser.

Parser events make lines: a line ends where a block element begins or ends, and keeps its text, its tags and how much of it is link
text. A line's ratio is its text outside links to its tags; ratios are smoothed by a Gaussian over neighbouring lines, and lines whose
smoothed ratio reaches the page's standard deviation of ratios cluster into runs of content. The content region is the element that
holds the clusters: the article that the page marks, or else its main element, or else the deepest container that has most of the
clusters' text. Of a page that puts everything into its body, it is what stands from the first cluster to the last, and the
short blocks that follow it.

All text of the region is taken, short blocks too, but for elements that are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or comments by their tag, role or the words of their class and id. An element of that kind which is never
closed and holds a page's heading or article is taken for a slip and kept.

Open elements are one stack with a count a tag, ends that fit nothing are ignored, and what is left open at the end of a page (a tag,
a comment, a script) is dropped, so that work is linear in the page's length, whatever its markup.

Defined cases: a null, empty or text-free page has an empty text; pages without any element are one block; character references are
decoded, with or without their semicolon, as html5 does; white space is that of str.split; long pages are taken whole; repeated rows
give repeated rows; an empty table gives an empty table. A caller's columns `text` and `n_chars` are replaced, all others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Fixed values of html: elements without content, blocks, and containers of blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body center details div fieldset figure footer form header html main nav section table tbody td tr".split())
BLOCKS = CONTAINERS | frozenset("address caption dd dialog dl dt figcaption h1 h2 h3 h4 h5 h6 head hgroup hr legend li menu ol option p pre summary tfoot th thead title ul".split())
#: What closes an open element of the same kind, and where the search for it ends.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never main text, with what they hold.
BOILER_TAGS = frozenset("head title script style noscript template nav aside footer form fieldset button select textarea input label dialog menu iframe object svg canvas audio video map".split())
BOILER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars nav navbar navigation navi menu menus "
    "breadcrumb breadcrumbs footer comment comments disqus respond cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager masthead copyright disclaimer search skip tags".split()
)
#: A class of this kind speaks of other elements (`has-sidebar`), and one with these words is a heading's, not a page's, header.
ABOUT_OTHERS, OWN_HEADER = frozenset("has with no without".split()), frozenset("article entry post story content title page".split())
#: Smoothing over lines, the threshold in standard deviations, and the share of the clusters' text that makes a container their region.
SIGMA, LAMBDA, MOST, LEAST = 1.0, 1.0, 0.6, 0.1


def boiler(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    """Whether an element is no main text. inside: it stands in an article or a main element."""
    if tag in BOILER_TAGS:
        return True
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
        return True
    if set((attrs.get("role") or "").lower().split()) & BOILER_ROLES:
        return True
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()
    words = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in names]
    words = [x for x in words if x and x[0] not in ABOUT_OTHERS]
    if tag == "article":
        return any("comment" in x or "comments" in x for x in words)
    header = tag == "header" or any("header" in x for x in words)
    if header and not inside and not any(OWN_HEADER & {*x} for x in words):
        return True
    return any(BOILER_WORDS & {*x} for x in words)


class Lines(HTMLParser):
    """Elements with their parents, and lines of (element, text) pieces, from parser events."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.boilers, self.closed = ["#"], [0], [False], [True]
        self.stack, self.open, self.links = [0], Counter(), 0
        self.lines: list[list] = []
        self.pieces, self.n_tags, self.n_links = [], 0, 0
        self.feed(html)
        # what is left is text, or a construct that never ends
        if self.rawdata and not self.cdata_elem and not self.rawdata.startswith("<"):
            self.handle_data(unescape(self.rawdata))
        self.end_line()
        for e in self.stack[1:]:
            self.closed[e] = self.tags[e] in ("html", "body", "p", "li")

    def end_line(self) -> None:
        if self.pieces:
            self.lines.append([self.pieces, self.n_tags, self.n_links])
            self.pieces = []
        self.n_tags = self.n_links = 0

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[self.tags[e]] -= 1
        self.closed[e] = True

    def pop_to(self, tag: str) -> None:
        while self.tags[self.stack[-1]] != tag:
            self.pop()
        self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.n_tags += 1
        if tag == "a":
            self.links += 1
        if tag == "br":
            self.pieces.append((self.stack[-1], " "))
        if tag in VOID:
            return
        if tag in BLOCKS:
            if self.open["p"]:
                self.pop_to("p")
            if tag in SIBLINGS:
                self.close_sibling(*SIBLINGS[tag])
        own = boiler(tag, dict(attrs), bool(self.open["article"] or self.open["main"]))
        if tag in BLOCKS or own:
            self.stack.append(len(self.tags))
            self.open[tag] += 1
            self.tags.append(tag)
            self.parents.append(self.stack[-2])
            self.boilers.append(own)
            self.closed.append(False)

    def close_sibling(self, kinds: set[str], scope: set[str]) -> None:
        if not any(self.open[k] for k in kinds):
            return
        for e in reversed(self.stack):
            tag = self.tags[e]
            if tag in kinds:
                self.pop_to(tag)
                if tag != "td" and tag != "th" or "tr" not in kinds:
                    return
                return self.close_sibling(kinds, scope)
            if tag in scope or tag in CONTAINERS - {"div", "tbody", "tr", "td"}:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.stack[-1] == len(self.tags) - 1 and self.tags[-1] == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.n_tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag]:
            self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem:
            return
        self.pieces.append((self.stack[-1], data))
        if self.links:
            self.n_links += len(data.strip())


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines."""
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach : reach + len(ratios)]


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: the smoothed ratio reaches LAMBDA standard deviations."""
    level = smoothed(ratios)
    found = (level >= LAMBDA * level.std()) & (ratios > 0)
    return found if found.any() else ratios >= 0


def upward(own: list[float], parents: list[int]) -> list[float]:
    """Sums over each element with all below it; a parent comes before its children."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by line feeds."""
    if not html:
        return ""
    page = Lines(html)
    size = len(page.tags)
    marks = upward([float(t in ("article", "main", "h1")) for t in page.tags], page.parents)
    gone = [False] * size
    for e in range(1, size):
        slip = not page.closed[e] and marks[e] > 0
        gone[e] = gone[page.parents[e]] or (page.boilers[e] and not slip)
    lines = []
    for pieces, n_tags, n_links in page.lines:
        text = " ".join("".join(t for e, t in pieces if not gone[e]).split())
        if text:
            at = next(e for e, t in pieces if not gone[e] and t.strip())
            lines.append((text, at, len(text) - min(n_links, len(text)), max(n_tags, 1)))
        else:
            lines.append((text, pieces[0][0], 0, max(n_tags, 1)))
    if not any(x[0] for x in lines):
        return ""
    content = content_lines(np.array([x[2] / x[3] for x in lines]))
    all_text, dense = [0.0] * size, [0.0] * size
    for (text, at, _, _), found in zip(lines, content):
        all_text[at] += len(text)
        dense[at] += len(text) if found else 0
    all_text, dense = upward(all_text, page.parents), upward(dense, page.parents)
    region = marked(page, gone, all_text, dense) or deepest(page, gone, dense)
    within = [False] * size
    within[region] = True
    for e in range(region + 1, size):
        within[e] = within[page.parents[e]]
    if page.tags[region] in ("#", "html", "body"):
        return between_clusters(page, lines, content, within)
    chosen = [x[0] for x in lines if x[0] and within[x[1]]]
    return "\n".join([*heading(page, lines, within), *chosen])


def marked(page: Lines, gone: list[bool], all_text: list[float], dense: list[float]) -> int:
    """The outermost article with most text, or else main element, that has a real share of the content; 0 if there is none."""
    for kind in ("article", "main"):
        # outside: no element of the kind above
        outside = [True] * len(page.tags)
        found = []
        for e in range(1, len(page.tags)):
            above = page.parents[e]
            outside[e] = outside[above] and page.tags[above] != kind
            if page.tags[e] == kind and outside[e] and not gone[e] and all_text[e] > 0:
                found.append(e)
        best = max(found, key=lambda e: all_text[e], default=0)
        if best and (len(found) == 1 or dense[best] >= LEAST * dense[0]):
            return best
    return 0


def deepest(page: Lines, gone: list[bool], dense: list[float]) -> int:
    """The deepest container that holds most of the content's text."""
    best = 0
    for e in range(1, len(page.tags)):
        if page.parents[e] == best or page.tags[page.parents[e]] not in CONTAINERS:
            if page.tags[e] in CONTAINERS and page.tags[e] != "blockquote" and not gone[e] and dense[e] >= MOST * dense[0] and dense[0] > 0:
                best = e
    return best


def heading(page: Lines, lines: list, within: list[bool]) -> list[str]:
    """A page's one heading, where it stands before a region that has none of its own."""
    found = [(k, x) for k, x in enumerate(lines) if x[0] and page.tags[x[1]] == "h1"]
    first = next((k for k, x in enumerate(lines) if x[0] and within[x[1]]), 0)
    return [found[0][1][0]] if len(found) == 1 and not within[found[0][1][1]] and found[0][0] < first else []


def between_clusters(page: Lines, lines: list, content: np.ndarray, within: list[bool]) -> str:
    """Of a page without containers: the lines from its heading or first cluster to its last cluster, without lines that are links alone.

    Lines after the last cluster belong to it as long as they are elements of its kinds without links.
    """
    at = np.flatnonzero(content)
    head = next((k for k, x in enumerate(lines[: at[0]]) if x[0] and page.tags[x[1]] == "h1"), at[0])
    kinds, end = {page.tags[lines[k][1]] for k in at}, at[-1] + 1
    while end < len(lines) and (not lines[end][0] or (page.tags[lines[end][1]] in kinds and lines[end][2] == len(lines[end][0]))):
        end += 1
    return "\n".join(x[0] for x in lines[head:end] if x[0] and x[2] > 0)


def extract_main_text(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """pages with text and n_chars, its code points; the column of html is dropped unless it is kept."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars") and (keep_html or c != html)]
    own = "_html"
    while own in pages.columns:
        own += "_"
    slim = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html}`").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, own):
            text = [main_text(x) for x in part.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = slim.drop(own).schema.add("text", "string").add("n_chars", "long")
    return slim.mapInArrow(run, schema)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The given pages put their article into one element of that name, with headings and paragraphs as its only blocks.
OP13_SQL = r"""
with parts as (
  select page_id, url, unnest(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:h1|p)>')) as part,
         generate_subscripts(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1), '</?(?:h1|p)>'), 1) as place
  from pages),
bare as (select page_id, url, place, regexp_replace(regexp_replace(part, '<br>', ' ', 'g'), '<[a-z/][^>]*>', '', 'g') as part from parts),
decoded as (
  select page_id, url, place,
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(part, '&#x27;', ''''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
                            '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as part
  from bare)
select page_id, url, coalesce(string_agg(part, chr(10) order by place) filter (part <> ''), '') as text,
       length(coalesce(string_agg(part, chr(10) order by place) filter (part <> ''), ''))::bigint as n_chars
from decoded group by page_id, url
"""

QUERIES = {"op13_html_extraction": op13_html_extraction}
SQL = {"op13_html_extraction": OP13_SQL}
