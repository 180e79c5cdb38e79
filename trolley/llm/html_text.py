"""Main text of HTML pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams its events into lines, one for each block of the page.  A line's ratio
is its text length over the tags inside it; text within links counts for nothing, and lines inside menus,
headers, footers, side bars, notices, adverts, forms or reader comments are left out.  What remains falls into
regions: one for each article element (else each main element), or, on pages with neither, the stretches between
lines left out, where those within one div, section or cell count as one.  The ratios are smoothed with a Gaussian within their region, the smoothed values are parted into
two clusters, and every region that reaches the upper cluster is content, with all its blocks, short ones included.

All text of a content line counts, whatever element holds it and whether style sheets would show it, but for scripts,
styles, form controls and embedded pages.  An inline element that is marked as boilerplate loses its own text alone: the
line around it stays whole.  Time grows with the length of a page however deep its elements lie, open or closed: the place
of the last open element of each name is known.

Null and empty pages have an empty text, and so have pages without a content line.  Broken markup is read as
the parser reads it.  Repeated rows get equal results, empty tables empty ones, other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trolley.llm._words import chunks

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is none of the page's: scripts, styles, markup kept for later, controls of forms, embedded pages.
SILENT = frozenset("script style template head title iframe select textarea datalist".split())
#: Elements that may stand in a head; any other one ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that are no article text.
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in a class or id that mark what is no article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup modal "
    "promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription tags toolbar widget".split()
)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that hold the article, by how sure that is; a header inside them belongs to it.
HOLDERS = {"main": 1, "article": 2}
#: Elements whose lines belong together on pages without a holder, even around an advert.
GROUPS = frozenset(["body", "center", "div", "section", "td"])
#: Marks that count on an article, too (a comment or a teaser may be one); the whole page is never marked.
ARTICLE_MARKS = frozenset("ad advert advertisement comment comments promo promoted related reply sponsored teaser".split())
#: Marks that say nothing inside an article: its own header, and lists of its tags or links, which are its text.
HELD_MARKS = MARKS - frozenset("header masthead related share sharing social tags toolbar widget".split())
#: A start tag on the left closes an open element on the right, as browsers do.
_CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr".split())

SPREAD = 1.0  # of the Gaussian, in lines
_REACH = 3
_KERNEL = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SPREAD) ** 2)
_KERNEL /= _KERNEL.sum()


class _Lines(HTMLParser):
    """Collects the lines of one page: text, tags inside, length of linked text, and whether it is boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, int], int]] = []
        self._text: list[str] = []
        self._dropped: list[str] = []  # text of inline boilerplate
        self._tags = self._linked = 0
        self._open: list[tuple[str, bool, bool]] = []  # element, silent, boilerplate
        self._places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name
        self._silent = self._plate = self._inline = self._links = self._seen = 0
        self._groups = [0]
        self._holders = [(0, 0)]  # how sure the innermost holder is, and its number on the page

    def _end_line(self) -> None:
        if self._text or self._dropped:
            text = " ".join("".join(self._text).split())
            plate = self._plate > 0 or not text
            text = text or " ".join("".join(self._dropped).split())
            if text:
                self.lines.append((text, self._tags, self._linked, plate, self._holders[-1], self._groups[-1]))
            self._text.clear()
            self._dropped.clear()
        self._tags = self._linked = 0

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        held = len(self._holders) > 1
        if tag in BOILERPLATE or (tag == "header" and not held):
            return True
        if tag in ("body", "html", "main"):
            return False
        marks = ARTICLE_MARKS if tag == "article" else HELD_MARKS if held else MARKS
        for name, value in attrs:
            if name == "role" and value and value.strip().lower() in ROLES:
                return True
            if name in ("class", "id") and value and any(p.lower() in marks for p in _PIECES.findall(value)):
                return True
        return False

    def _pop_to(self, at: int) -> None:
        while len(self._open) > at:
            tag, silent, plate = self._open.pop()
            self._places[tag].pop()
            self._silent -= silent
            if tag in BLOCKS:
                self._plate -= plate
            else:
                self._inline -= plate
            if tag in HOLDERS:
                self._holders.pop()
            elif tag in GROUPS:
                self._groups.pop()
            self._links -= tag == "a"

    def _last(self, tag: str) -> int:
        """Place of the last open element of a name, -1 if there is none."""
        places = self._places.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._close("head", stop=frozenset())
        if tag in BLOCKS:
            self._end_line()
            if tag in _CLOSES_P:
                self._close("p", stop=frozenset(["table", "td", "th", "button", "object"]))
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            self._tags += tag not in BLOCKS
            return
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            self._close(tag, stop=frozenset(["ul", "ol", "menu", "dl", "table"]))
        silent, plate = tag in SILENT, self._marked(tag, attrs)
        self._tags += 1
        self._places[tag].append(len(self._open))
        self._open.append((tag, silent, plate))
        self._silent += silent
        if tag in BLOCKS:
            self._plate += plate
        else:
            self._inline += plate
        if tag in HOLDERS:
            self._seen += 1
            self._holders.append((HOLDERS[tag], self._seen))
        elif tag in GROUPS:
            self._seen += 1
            self._groups.append(self._seen)
        self._links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open and self._open[-1][0] == tag:
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: frozenset[str]) -> None:
        """Close the last open element of a name, unless one of ``stop`` was opened after it."""
        at = self._last(tag)
        if at >= 0 and all(self._last(other) < at for other in stop):
            self._pop_to(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        at = self._last(tag)
        if at >= 0:
            if tag not in BLOCKS:
                self._tags += 1
                if any(name in BLOCKS and plate for name, _, plate in self._open[at:]):
                    self._end_line()
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if self._inline:
            self._dropped.append(data)
        else:
            self._text.append(data)
            if self._links:
                self._linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, bool, tuple[int, int], int]]:
        self.close()
        self._end_line()
        return self.lines


def _upper_cluster(values: np.ndarray) -> float:
    """Least value of the upper of two clusters of the positive values (one cluster if they are alike)."""
    positive = np.sort(values[values > 0])
    if not len(positive):
        return np.inf
    if positive[-1] < 4 * positive[0]:
        return float(positive[0])
    low, high = np.log(positive[0]), np.log(positive[-1])
    logs = np.log(positive)
    for _ in range(20):
        cut = (low + high) / 2
        new = logs[logs <= cut].mean(), logs[logs > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return float(positive[logs > (low + high) / 2][0])


def _stretches(open_: np.ndarray, groups: list[int]) -> np.ndarray:
    """Numbers the stretches between lines left out; those that share a group get one number."""
    stretch = np.cumsum(~open_)
    joined: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := joined.get(k, k)) != k:
            joined[k] = joined.get(up, up)
            k = up
        return k

    first: dict[int, int] = {}
    for k, group, is_open in zip(stretch.tolist(), groups, open_):
        if is_open:
            a, b = root(first.setdefault(group, k)), root(k)
            joined[max(a, b)] = min(a, b)
    return np.array([root(k) for k in stretch.tolist()])


def content(html: str) -> list[str]:
    """The content blocks of a page, in page order."""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return []
    texts, tags, linked, plates, holders, groups = map(list, zip(*lines))
    sure = max((h[0] for h, plate in zip(holders, plates) if not plate), default=0)
    open_ = np.array([not plate and h[0] == sure for h, plate in zip(holders, plates)])
    if not open_.any():
        return []
    ratio = np.maximum(0, np.array([len(t) for t in texts]) - linked) / np.maximum(1, tags)
    region = np.array([h[1] for h in holders]) if sure else _stretches(open_, groups)
    shown = np.flatnonzero(open_)
    shown = shown[np.argsort(region[shown], kind="stable")]
    regions = np.split(shown, np.flatnonzero(np.diff(region[shown])) + 1)
    smooth = np.zeros(len(lines))
    for own in regions:
        weight = np.convolve(np.ones(len(own)), _KERNEL)[_REACH : _REACH + len(own)]
        smooth[own] = np.convolve(ratio[own], _KERNEL)[_REACH : _REACH + len(own)] / weight
    least = _upper_cluster(smooth)
    rows = np.concatenate([own for own in regions if smooth[own].max() >= least] or [np.zeros(0, int)])
    return [texts[i] for i in np.sort(rows)]


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``id_column`` and the text of every page: its content blocks joined by two line feeds; and n_blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pages in chunks(batches, 1):
            blocks = [content(p.decode()) if p else [] for p in pages]
            texts = pa.array(["\n\n".join(b) for b in blocks], pa.string())
            counts = pa.array([len(b) for b in blocks], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), texts, counts], names=["id", "text", "n_blocks"])

    rows = pages.select(pages[id_column].alias("id"), pages[html_column].alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, text string, n_blocks long"
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_column)
