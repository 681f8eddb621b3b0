"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events; block elements cut the page into lines. Each
line has its text and the tags met since the line before. The ratio of characters to tags is
smoothed along the lines with a Gaussian; lines whose smoothed ratio reaches a threshold (the
standard deviation of the ratios, but no more than half the highest) cluster into content
regions. The content element is the article or main element around the main region, or else the
innermost element that holds the lines of all regions; every line of it counts, short ones too,
but for lines of elements that are never content: menus, page headers, footers, sidebars, forms,
notices, adverts, comments, scripts, styles.

Tags and roles set an element aside for good. Words of its class or id do so by their weight:
``comments`` as a name of its own always counts, as a part of a longer name (``comments-list``) only
if the element holds less than half of the page's text, and in a name that tells a state
(``with-sidebar``, ``no-banner``, ``comments-open``) not at all. No word sets aside what holds the
page's largest article or main element, if that has a quarter of the text.

Elements are numbered in the order of their start tags and know their parent and the last element
inside, so time and memory are in proportion to the page however deep it nests.

Defined results
* a null or empty page, or one without content lines, gives an empty text;
* character references are decoded; white space inside a line becomes one space;
* unclosed and badly nested elements, cut-off pages and pages of any length are read as far as
  they go; nothing is cut off;
* of regions with equal text the first counts; repeated rows give repeated results, an empty
  table an empty one;
* only the id, the address and the page are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import parts

SIGMA = 1.0
BATCH_BYTES = 8 << 20
FEED = 1 << 16
RESULT = "page_id long, url string, text string, n_chars long"

# Elements that begin a line of their own, and elements without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements, roles and words in class or id that mark what is never content.
ASIDE_TAGS = frozenset(
    "head title nav footer aside form script style noscript template iframe object svg canvas "
    "button select textarea dialog menu search audio video map".split()
)
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar status".split()
)
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notices notification popup modal "
    "overlay nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar "
    "footer bottom sidebar aside rail widget widgets comment comments commentlist reply replies "
    "respond disqus related recommended share sharing social newsletter subscribe subscription "
    "signup login search toolbar pagination pager skip disclaimer copyright hidden".split()
)
KEEPS_CLASS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(("article", "main"))
# Elements closed by the start of one of the given others.
CLOSED_BY = {
    "p": BLOCKS - {"option", "optgroup", "title", "head", "body", "html"},
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
    "tr": frozenset(("tr",)), "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
# Parts of a name that tell a state of an element, not what it is, and names that
# speak of content.
STATE_FIRST = frozenset("no not has have with without hide show is enable disable".split())
STATE_LAST = frozenset("open closed on off enabled disabled visible collapsed content".split())
CONTENT_NAMES = frozenset("content main article post entry story text body page".split())
# Shares of the page's text: of an element that a part of a name doesn't set aside, and of an
# article or main element that no name sets aside.
MOST_TEXT = 0.5
ARTICLE_TEXT = 0.25
_WORDS = re.compile(r"[a-z]+")

# What a class or id says about an element.
CONTENT, MAYBE_ASIDE, NAMED_ASIDE, ASIDE = range(4)


def named(names: str) -> int:
    """What the words of class and id say."""
    verdict, is_content = CONTENT, False
    for name in names.lower().split():
        words = _WORDS.findall(name)
        if name in CONTENT_NAMES:
            is_content = True
        if not words or not ASIDE_WORDS.intersection(words):
            continue
        if len(words) == 1:
            verdict = NAMED_ASIDE
        elif words[0] not in STATE_FIRST and words[-1] not in STATE_LAST:
            verdict = max(verdict, MAYBE_ASIDE)
    return MAYBE_ASIDE if is_content and verdict == NAMED_ASIDE else verdict


class Lines(HTMLParser):
    """Lines of a page: text, tags before it, number of its element.

    Element 0 is the page itself. ``parents``, ``names``, ``marks`` and ``inside`` (an article or
    main element) are by element; a number is larger than its parent's.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[int] = [0]
        self.blocks: list[int] = [0]  # places in the path of the open block elements
        self.open: dict[str, list[int]] = {}  # places in the path by tag
        self.parents, self.names, self.marks, self.inside = [0], [""], [CONTENT], [False]
        self.pieces: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces = []
        if text:
            self.lines.append((text, self.tags, self.path[-1]))
            self.tags = 0

    def mark(self, tag: str, attrs: list) -> int:
        if tag in ASIDE_TAGS or tag == "header" and not self.inside[self.path[-1]]:
            return ASIDE
        if tag in KEEPS_CLASS:
            return CONTENT
        given = {k: v or "" for k, v in attrs}
        if given.get("role", "").lower() in ASIDE_ROLES or "hidden" in given:
            return ASIDE
        return named(f"{given.get('class', '')} {given.get('id', '')}")

    def pop_to(self, place: int) -> None:
        if self.blocks[-1] >= place:
            self.end_line()
        for element in reversed(self.path[place:]):
            self.open[self.names[element]].pop()
        del self.path[place:]
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.pieces.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        # All elements that end by the start of another one are blocks.
        block = self.blocks[-1]
        if tag in CLOSED_BY.get(self.names[self.path[block]], ()):
            self.pop_to(block)
        parent = self.path[-1]
        mark = self.mark(tag, attrs)
        element = len(self.parents)
        self.parents.append(parent)
        self.names.append(tag)
        self.marks.append(mark)
        self.inside.append(self.inside[parent] or tag in CONTAINERS)
        self.open.setdefault(tag, []).append(len(self.path))
        if tag in BLOCKS:
            self.blocks.append(len(self.path))
        self.path.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path") and self.names[self.path[-1]] == tag:
            self.pop_to(len(self.path) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        places = self.open.get(tag)
        # A stray end tag of a phrase doesn't close blocks.
        if places and (tag in BLOCKS or places[-1] > self.blocks[-1]):
            self.pop_to(places[-1])

    def handle_data(self, data: str) -> None:
        if self.names[self.path[-1]] not in ("script", "style"):
            self.pieces.append(data)

    def set_aside(self) -> list[bool]:
        """For each element whether it is never content, by its own mark or an outer one's."""
        n = len(self.parents)
        never = [mark == ASIDE for mark in self.marks]
        for e in range(1, n):
            never[e] = never[e] or never[self.parents[e]]
        held = [0] * n  # characters of text inside, without what is never content
        for text, _, e in self.lines:
            if not never[e]:
                held[e] += len(text)
        for e in range(n - 1, 0, -1):
            held[self.parents[e]] += held[e]
        kept = [False] * n
        articles = [e for e in range(n) if self.names[e] in CONTAINERS and not never[e]]
        if articles:
            e = max(articles, key=lambda x: held[x])
            if held[e] >= ARTICLE_TEXT * held[0]:
                while e:
                    kept[e] = True
                    e = self.parents[e]
        aside = never
        for e in range(1, n):
            mark = self.marks[e]
            by_name = mark == NAMED_ASIDE or mark == MAYBE_ASIDE and held[e] < MOST_TEXT * held[0]
            aside[e] = aside[e] or aside[self.parents[e]] or by_name and not kept[e]
        return aside

    def last_inside(self) -> list[int]:
        """For each element the largest number of an element inside, or its own."""
        last = list(range(len(self.parents)))
        for e in range(len(last) - 1, 0, -1):
            last[self.parents[e]] = max(last[self.parents[e]], last[e])
        return last


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean along the lines; at the ends over the lines there are."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach:len(ratios) + reach]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach:len(ratios) + reach]


def main_text(html: str, sigma: float = SIGMA) -> str:
    """Text of the content element's lines, one per line."""
    page = Lines()
    for at in range(0, len(html), FEED):
        page.feed(html[at:at + FEED])
    page.close()
    page.end_line()
    aside = page.set_aside()
    # What is set aside keeps its place among the lines, without text.
    ratios = np.array([0.0 if aside[e] else len(text) / max(tags, 1) for text, tags, e in page.lines])
    if not ratios.any():
        return ""
    curve = smoothed(ratios, sigma)
    threshold = min(float(ratios.std()), 0.5 * float(curve.max()))
    above = (curve >= threshold) & (ratios > 0)
    # Clusters: runs of lines above the threshold, lines set aside between them allowed.
    content = np.flatnonzero(ratios > 0)
    runs = np.split(content, np.flatnonzero(np.diff(above[content].astype(int))) + 1)
    runs = [run for run in runs if above[run[0]]]
    main = max(runs, key=lambda run: sum(len(page.lines[i][0]) for i in run.tolist()))
    last = page.last_inside()

    def around(rows: Iterable[int]) -> int:
        """The innermost element that holds the lines."""
        elements = [page.lines[i][2] for i in rows]
        low, high = min(elements), max(elements)
        while last[low] < high:
            low = page.parents[low]
        return low

    root = outer = around(main.tolist())
    found = None
    while outer:
        if page.names[outer] in CONTAINERS:
            found = outer
        outer = page.parents[outer]
    if found is None:
        # Other regions count as well; a line of its own paragraph is part of what surrounds it.
        root = around(i for run in runs for i in run.tolist())
        while root and page.names[root] not in ("div", "section", "td", "body", "html"):
            root = page.parents[root]
    else:
        root = found
    return "\n".join(
        text for text, _, e in page.lines if not aside[e] and root <= e <= last[root]
    )


def _extract_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, urls, pages in parts(batches, BATCH_BYTES, text=2):
        texts = [main_text(p.as_py()) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html"))
    return narrow.mapInArrow(_extract_task, RESULT)
