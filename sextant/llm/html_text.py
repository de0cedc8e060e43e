"""Main text of HTML pages by text-to-tag ratio.

The standard-library parser streams events; blocks are the lines of the page, each with its characters and the tags seen
around it.  The text-to-tag ratio of the lines is smoothed by a Gaussian, and a two-cluster threshold separates dense from
sparse lines.  The containers of dense lines are the content regions; what stands inside a region is kept, so a short paragraph or
list of an article stays, but for blocks without a dense line that are mainly links.

Elements that are never the article (menus, footers, forms, scripts) don't count as lines.  A class, id or role that speaks of adverts, comments
or the like, or a form, makes a container suspect; it goes unless it turns out to wrap the article: it holds the one that the page names, or,
where its words are weak, nearly all dense text, or, where they stand among others, all but a little of what would be left without it.

Edge cases: a null or empty page, or one without text, gives an empty text; a page without mark-up is one
line; unclosed elements end with their parent; repeated pages give equal rows; an empty table gives no rows; other columns are ignored; very long
pages are parsed as a stream of events.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Elements without content, elements that start a line, and elements that are never the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
OUTSIDE = frozenset("aside audio button canvas dialog embed footer head header iframe input label menu nav noscript object option script select style svg template textarea title video".split())
#: Words in a class, id or role that mark what isn't the article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion promoted related reply replies responses search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert warning overlay paywall login".split()
)
OUTSIDE_ARTICLE_WORDS = frozenset("ad advert comment comments promo promoted related reply replies sponsored".split())
#: Of these, words that a wrapper of the article may have too; first words that speak of something else; what a header of these belongs to.
WEAK_WORDS = frozenset("alert banner complementary disclaimer header masthead modal notice notices overlay pager paywall popup promo related search share sharing sidebar social toolbar warning widget widgets".split())
NEGATED = frozenset("has have hide is no non not with without".split())
PARTS = frozenset("article content entry post story".split())
#: Containers whose own header stays part of the article.
ARTICLE = frozenset(("article", "main"))
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An end tag of these closes no element beyond the nearest of these.
SCOPE = frozenset("article aside body div footer form header html main nav section table td ul ol".split())
SIGMA = 1.5
#: Share of links from which a sparse block is a list of links; share of dense text that makes a weakly suspect container a wrapper.
LINKS = 0.5
WRAPS = 0.8
#: How an element stands to the article.
INSIDE, WEAK, HINT, STRONG, NEVER = range(5)


def standing(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    if tag in OUTSIDE and not (tag == "header" and in_article):
        return NEVER
    found = HINT if tag == "form" else INSIDE
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in ("html", "body"):
            marks = OUTSIDE_ARTICLE_WORDS if tag in ARTICLE else OUTSIDE_WORDS
            for token in value.split():
                words = WORD.findall(CAMEL.sub(" ", token).lower())
                own = marks.intersection(words)
                if "header" in own and (in_article or not PARTS.isdisjoint(words)):
                    own = own - {"header"}
                if own and words[0] not in NEGATED:
                    # a word among others may as well tell what the page has or lacks
                    found = max(found, WEAK if own <= WEAK_WORDS else STRONG if own.issuperset(words) else HINT)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return NEVER
    return found


class Line(NamedTuple):
    text: str
    tags: int
    links: int
    path: tuple[int, ...]
    article: int
    suspects: tuple[tuple[int, int], ...]


class Lines(HTMLParser):
    """Collects the lines: text, tags around it, characters in links, numbers of its containers, of its article (or 0) and of suspect containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # element, standing, number
        self.never = self.in_article = self.in_link = self.number = self.tags = self.links = 0
        self.words: list[str] = []
        self.lines: list[Line] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            article = next((n for t, _, n in reversed(self.stack) if t in ARTICLE), 0) if self.in_article else 0
            suspects = tuple((n, how) for _, how, n in self.stack if how)
            self.lines.append(Line(text, self.tags, self.links, tuple(n for t, _, n in self.stack if t in SCOPE), article, suspects))
            self.tags = 0
        self.links = 0
        self.words.clear()

    def push(self, tag: str, how: int) -> None:
        self.number += 1
        self.stack.append((tag, how, self.number))
        self.never += how == NEVER
        self.in_article += tag in ARTICLE
        self.in_link += tag == "a"

    def pop(self) -> None:
        tag, how, _ = self.stack.pop()
        self.never -= how == NEVER
        self.in_article -= tag in ARTICLE
        self.in_link -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK or tag in OUTSIDE:
            self.end_line()
        if tag in VOID:
            return
        if tag in BLOCK:  # an open paragraph ends where a block starts
            while self.stack and self.stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a") and any(t == "p" for t, _, _ in self.stack[-8:]):
                self.pop()
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self.pop()
        self.push(tag, standing(tag, attrs, self.in_article > 0))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or tag in OUTSIDE:
            self.end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in SCOPE and tag not in SCOPE:
                return

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.words.append(data)
            if self.in_link:
                self.links += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the edge values held."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Midpoint of two clusters, by Lloyd's iterations from the extremes; everything is dense if they hardly differ."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        new = float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def ratio(line: Line) -> float:
    return len(line.text) / max(1, line.tags)


def dense_lines(lines: list[Line], cut: float | None = None) -> tuple[list[Line], float]:
    """Lines whose smoothed text-to-tag ratio reaches the two-cluster threshold (or ``cut``), and that threshold."""
    if not lines:
        return [], 0.0
    even = smooth(np.array([ratio(x) for x in lines]))
    cut = threshold(even) if cut is None else cut
    return [lines[k] for k in np.flatnonzero(even >= cut).tolist()], cut


def without_suspects(lines: list[Line], cut: float | None) -> list[Line]:
    """Lines outside suspect containers, but for those containers that wrap the article."""
    if not any(x.suspects for x in lines):
        return lines
    wrappers: set[int] = set()
    if any(x.article for x in lines):
        if not any(x.article and not x.suspects for x in lines):
            sizes: dict[int, int] = {}
            for x in lines:
                if x.article and all(n < x.article for n, _ in x.suspects):
                    sizes[x.article] = sizes.get(x.article, 0) + len(x.text)
            largest = max(sizes, key=sizes.__getitem__, default=0)
            wrappers = {n for x in lines if x.article == largest for n, _ in x.suspects if n < largest}
        lines = [x for x in lines if x.article] or lines
    dense, _ = dense_lines(lines, cut)
    total, held = sum(len(x.text) for x in dense), dict[int, int]()
    for x in dense:
        for n, how in x.suspects:
            if how == WEAK:
                held[n] = held.get(n, 0) + len(x.text)
    wrappers |= {n for n, size in held.items() if size >= WRAPS * total}
    while True:
        kept = [x for x in lines if all(n in wrappers for n, _ in x.suspects)]
        # where hardly any text would be left, the container of most dense text is the page's body, if its words are no more than a hint
        inside: dict[int, int] = {}
        for x in dense:
            outer = next(((n, how) for n, how in x.suspects if n not in wrappers), None)
            if outer and outer[1] <= HINT:
                inside[outer[0]] = inside.get(outer[0], 0) + len(x.text)
        body = max(inside, key=inside.__getitem__, default=0)
        if not body or inside[body] < WRAPS * (inside[body] + sum(len(x.text) for x in kept)):
            return kept
        wrappers.add(body)


def without_links(lines: list[Line], cut: float) -> list[Line]:
    """Lines but for those of blocks that are mainly links and hold no line that is dense by itself."""
    places = {n for x in lines if ratio(x) >= cut for n in x.path}
    sizes: dict[int, list[int]] = {}
    for x in lines:
        for n in x.path:
            if n not in places:
                size = sizes.setdefault(n, [0, 0])
                size[0] += len(x.text)
                size[1] += x.links
    lists = {n for n, (size, links) in sizes.items() if links >= LINKS * size}
    return [x for x in lines if lists.isdisjoint(x.path)]


def main_text(html: str | None, cut: float | None = None) -> str:
    """The article's text: its lines joined by one blank.  ``cut`` replaces the threshold that the page's own ratios give."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = without_suspects(parser.lines, cut)
    if any(x.article for x in lines):  # the page names its article: only that is looked at
        lines = [x for x in lines if x.article]
    dense, cut = dense_lines(lines, cut)
    if any(x.article for x in dense):
        regions = {x.article for x in dense}
        lines = [x for x in lines if x.article in regions]
    else:
        paths = {x.path for x in dense}
        lines = [x for x in lines if any(x.path[: len(r)] == r for r in paths)]
    return " ".join(x.text for x in without_links(lines, cut))


OUT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512)
            texts = [main_text(x) for x in rows.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to (page_id, url, text, n_chars in code points)."""
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(_extract, OUT)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
