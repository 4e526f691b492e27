"""Main-text extraction: streaming parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams through a page. Its events are cut into lines at block elements, as a browser would; a line
has its text, the number of tags in it, and how much of its text stands in links. Elements that never hold the article (menus,
headers, footers, sidebars, forms, scripts, styles, adverts, notices, comments) are passed over, by their names, roles, and the
words of their classes and ids.

A line's ratio is its text outside links for each tag. The ratios are smoothed by a Gaussian, and two clusters of their logarithms,
content and the rest, are found by the threshold between their means; clusters closer than `APART` are one. Regions: an article or
main element, else the nearest sectioning element around a line; a table cell that holds blocks of its own is a region (a page laid out
by a table), any other cell belongs to what holds its table. A region is content if half of its text is, and half stands outside
links; then all its lines are, so that a short paragraph isn't lost. An article's text is never dropped; what stands outside of it
is content only if it has more dense text than all articles of the page.

Cases. A null or empty html, or one without text, gives the empty text. Unclosed and misplaced tags are taken as they come: an end
tag closes what is open down to its start, others are ignored. Repeated rows are each extracted. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import only

#: Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("applet aside audio button canvas datalist dialog embed fieldset footer form head header iframe map math menu nav noscript object script select style svg template textarea title video".split())
CONTAINERS = frozenset("article body div main section".split())
CELLS = frozenset(("td", "th"))
#: What a table is made of; another block inside a cell makes the cell a region.
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A chosen list: words of classes and ids of what isn't the article.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination pager popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
SIGMA = 1.0
#: Two clusters of ratios are told apart if their means differ by this factor at least.
APART = 3.0
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Lines(HTMLParser):
    """Lines (text, tags, characters in links, container, whether in an article) of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # name, whether passed over, whether a region
        self.cells: list[bool] = []  # of the open cells: whether a region
        self.skipping = self.links = self.articles = 0
        self.containers = [0]
        self.n_containers = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.containers[-1], self.articles > 0))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and not self.skipping:
            self._end_line()
        self.tags += 1
        if tag == "br" and not self.skipping:
            self.parts.append(" ")
        if tag in VOID:
            return
        skip = tag in SKIPPED
        if attrs and not skip and tag not in ("html", "body") and (self.articles or tag not in ("article", "main")):
            for name, value in attrs:
                if (name in ("class", "id") and value and not MARKS.isdisjoint(_SPLIT.split(value.lower()))) or (name == "role" and value and value.lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
                    skip = True
                    break
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self._close(len(self.open) - 1)
        if self.cells and not self.cells[-1] and not self.articles and tag in BLOCKS and tag not in TABLE_PARTS:
            self.cells[-1] = True
            self._begin_region()
        region = tag in CONTAINERS and not self.articles
        if region:
            self._begin_region()
        if tag in CELLS:
            self.cells.append(False)
        self.open.append((tag, skip, region))
        self.skipping += skip
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def _begin_region(self) -> None:
        self.n_containers += 1
        self.containers.append(self.n_containers)

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            tag, skip, region = self.open.pop()
            if tag in BLOCKS and not self.skipping:
                self._end_line()
            self.skipping -= skip
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")
            if region or (tag in CELLS and self.cells.pop()):
                self.containers.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def all_lines(self, html: str) -> list[tuple[str, int, int, int, bool]]:
        self.feed(html)
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel, "valid")


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters of values, found by alternating from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = values >= middle
        if above.all() or not above.any():
            return middle if above.any() else low
        new_low, new_high = float(values[~above].mean()), float(values[above].mean())
        if (new_low, new_high) == (low, high):
            break
        low, high = new_low, new_high
    return (low + high) / 2


def dense(lines: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """Which lines are in the cluster of high ratios, with their neighbours' help."""
    ratios = np.array([max(0, len(x[0]) - x[2]) / max(1, x[1]) for x in lines], float)
    levels = np.log1p(smoothed(ratios))
    above = levels >= threshold(levels)
    if above.all() or levels[above].mean() - levels[~above].mean() < np.log(APART):
        return np.ones(len(lines), bool)
    return above


def blocks(html: str | None) -> list[str]:
    """The content blocks of a page, in order."""
    if not html:
        return []
    lines = _Lines().all_lines(html)
    if not lines:
        return []
    total: dict[int, list[int]] = {}  # by region: characters, those outside links, those in dense lines outside links
    articles = set()
    for x, good in zip(lines, dense(lines), strict=True):
        own = total.setdefault(x[3], [0, 0, 0])
        free = max(0, len(x[0]) - x[2])
        own[0] += len(x[0])
        own[1] += free
        own[2] += free * bool(good)
        if x[4]:
            articles.add(x[3])
    least = sum(total[k][2] for k in articles)
    kept = articles | {k for k, (size, free, good) in total.items() if 2 * good >= size and 2 * free >= size and (not articles or good > least)}
    return [x[0] for x in lines if x[3] in kept]


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = ["\n\n".join(blocks(html)) for html in frame["html"]]
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    rows = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
