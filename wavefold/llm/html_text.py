"""Main text of web pages (operator 8).

A page is read as a stream of events of the standard library's HTML parser. The
events give lines, one for each block of text, with the number of tags and of characters
inside and outside of links, and the element that each stands in.

* The value of a line is its text-to-tag ratio (characters outside of links for each tag) times its evidence:
  the tags, classes, ids and roles around it that speak for furniture make it smaller, and none of them decides.
* The values are smoothed by a Gaussian over neighbouring lines. A threshold that splits the smoothed
  values into two clusters (two means) chooses the seeds.
* The region of a seed is the smallest element of several lines around it. It grows to the element around while what
  that adds is not mostly furniture: lines of links or of little value. An article or main
  without a seed is a region too, unless it is mostly furniture.
* A region is kept whole but for blocks inside of it that furniture is known by: elements with evidence
  whose text as a whole is in the lower cluster or mostly links, and runs of lines that are short links and nothing else.

Evidence against a line counts by strength. A class, id or role of mark words alone, one that names comments, and nav, footer,
aside, form and the like are strong, since comments and adverts can be prose, which no ratio tells apart; other marks are weak.
All steps are linear in the page: open elements are found by their tags, evidence and totals are added up along the tree once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that break a line, that have no end tag, that hold no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title svg annotation annotation-xml object iframe canvas audio video textarea select button".split())
FURNITURE = frozenset("nav footer aside form menu dialog header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(("article", "main"))
#: Words of a class, id or role that mark page furniture (fixed values).
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar widget related recommended share sharing social newsletter subscribe signup
    comment comments disqus reply replies respond discussion footer header masthead toolbar search login copyright skip complementary contentinfo hidden""".split()
)
#: Marks that are also words of prose: alone they mark only what reads like furniture.
VAGUE = frozenset("alert banner discussion hidden notice promotion recommended related respond search skip social".split())
#: Words that are a strong mark beside any others.
COMMENTS = frozenset("comment comments disqus".split())
#: Elements that are never marked themselves.
PLAIN = HEADINGS | frozenset("html body main".split())
#: An open p is closed by the start of these; other elements that their like closes.
_ENDS_P = BLOCKS - {"body", "html", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


@dataclass(frozen=True)
class HtmlConfig:
    #: Standard deviation of the Gaussian, in lines.
    sigma: float = 1.0
    #: What strong and weak evidence leaves of a ratio.
    strong: float = 0.001
    weak: float = 0.75
    #: Share of the threshold that a seed's own value must have, so that smoothing alone makes none.
    own: float = 0.5
    #: Share of the largest region's text that a region of one line must have.
    alone: float = 0.5
    #: A larger share of characters in links makes a marked element furniture.
    linked: float = 0.5
    #: Lines of links with fewer characters a tag are furniture, as are marked elements of a smaller value outside of links.
    bare: float = 5.0
    thin: float = 10.0
    #: As many lines a heading counts for where a region grows.
    heading: int = 5
    #: Which evidence is used: article and main, names of other elements, classes, ids and roles.
    containers: bool = True
    tags: bool = True
    marks: bool = True


class Line(NamedTuple):
    """A block of text: its tags, characters in links, element, innermost mark (0: none), whether it is in an article or main and in a heading."""

    text: str
    tags: int
    linked: int
    element: int
    mark: int
    inside: bool
    heading: bool


class _Open(NamedTuple):
    """An open element: its number, whether its text is hidden, innermost mark, container, in a link, in a heading, own tag."""

    element: int
    hides: bool
    mark: int
    container: int
    link: bool
    heading: bool
    tag: str


class _Lines(HTMLParser):
    """Lines from the parser's events, the tree of elements and the marks in it."""

    def __init__(self, cfg: HtmlConfig):
        super().__init__(convert_charrefs=True)
        self.cfg = cfg
        self.open = [_Open(0, False, 0, 0, False, False, "")]
        self.at: dict[str, list[int]] = {}  # where the open elements of a tag are in ``open``
        self.blocks: list[int] = []  # where the open blocks are
        self.parents = [-1]
        self.marks = [(0, 1.0, False)]  # the mark around, what it leaves of a ratio, strong or weak
        self.containers: list[tuple[int, int]] = [(0, 0)]  # element and innermost mark of each article or main
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.seen = self.linked = 0
        self.place: tuple = ()

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            element, mark, container, heading = self.place
            self.lines.append(Line(text, max(self.seen, 1), min(self.linked, len(text)), element, mark, container > 0, heading))
            self.seen = self.linked = 0
        self.parts = []

    def _last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def _mark(self, tag: str, attrs: list, container: int) -> tuple[bool, bool, bool]:
        """Whether the element has strong or weak evidence, and whether it is hidden."""
        strong = weak = hidden = False
        for name, value in attrs:
            if name in ("class", "id", "role"):
                for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value or "").lower().split():
                    if not re.match(r"(has|no|not|is|with|without)[-_]", name):
                        words = set(re.split(r"[^a-z0-9]+", name)) - {""}
                        strong = strong or bool(words & COMMENTS) or bool(words) and words <= MARKS and not words <= VAGUE
                        weak = weak or bool(words & MARKS)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I):
                hidden = True
        if tag in PLAIN or not self.cfg.marks:
            strong = weak = False
        return strong or self.cfg.tags and tag in FURNITURE, weak, hidden

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen += 1
        if tag in BLOCKS:
            self._end_line()
            if tag in _ENDS_P and self.blocks and self.open[self.blocks[-1]].tag == "p":
                self._pop_to(self.blocks[-1])
            for other in _ENDS.get(tag, ()):
                if (x := self._last(other)) > max(map(self._last, ("ul", "ol", "dl", "table", "select"))):
                    self._pop_to(x)
        if tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        up = self.open[-1]
        mark, container = up.mark, up.container
        strong, weak, hidden = self._mark(tag, attrs, container)
        if tag in HEADINGS and container and up.tag == "header":
            mark = self.containers[container][1]  # of an article's own header, the headings stay
        if strong or weak:
            self.marks.append((mark, self.cfg.strong if strong else self.cfg.weak, strong))
            mark = len(self.marks) - 1
        self.parents.append(up.element)
        element = len(self.parents) - 1
        if tag in CONTAINERS and self.cfg.containers:
            self.containers.append((element, mark))
            container = len(self.containers) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(_Open(element, up.hides or tag in HIDDEN or hidden, mark, container, up.link or tag == "a", up.heading or tag in HEADINGS, tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in BLOCKS:
            self._end_line()
        if (x := self._last(tag)) >= 0:
            self._pop_to(x)

    def handle_data(self, data: str) -> None:
        up = self.open[-1]
        if up.hides:
            return
        place = (up.mark, up.container, up.heading)
        if not self.parts or place != self.place[1:]:
            if self.parts:
                self._end_line()
            self.place = (up.element, *place)
        self.parts.append(data)
        if up.link:
            self.linked += len(" ".join(data.split()))

    def done(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of the ratios of neighbouring lines, weights renewed at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def two_means(values: np.ndarray) -> float:
    """The middle between the means of the two clusters of ``values``."""
    ordered, n = np.sort(values), len(values)
    sums = np.r_[0.0, np.cumsum(ordered)]
    cut = float(values.mean())
    seen: set[int] = set()  # sizes of the lower cluster; a cut moves one way, so none comes again but by rounding
    while 0 < (low := int(np.searchsorted(ordered, cut, side="right"))) < n and low not in seen:
        seen.add(low)
        cut = float(sums[low] / low + (sums[n] - sums[low]) / (n - low)) / 2
    return cut


def _totals(own: np.ndarray, parents: list[int]) -> np.ndarray:
    """What each node and all below it have; parents come before their children."""
    out = own.tolist()
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return np.array(out)


def _evidence(parser: _Lines) -> tuple[list[int], list[float]]:
    """The mark around each mark, and what all marks around something leave of its ratio.

    Marks around all articles and mains of a page are ones of layout and count for nothing.
    """
    around = [m[0] for m in parser.marks]
    held = np.array([mark for _, mark in parser.containers[1:]], int)
    layout = _totals(np.bincount(held, minlength=len(around)), around) == max(len(held), 1)
    left = [1.0]
    for i, (up, own, _) in enumerate(parser.marks[1:], 1):
        left.append(left[up] * (1.0 if layout[i] else own))
    return around, left


def main_text(html: str, cfg: HtmlConfig = HtmlConfig()) -> str:
    """Content blocks of a page, one a line; empty if there are none."""
    parser = _Lines(cfg)
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return ""
    chars, tags, linked = (np.array(x, float) for x in ([len(x.text) for x in lines], [x.tags for x in lines], [x.linked for x in lines]))
    element, mark = np.array([x.element for x in lines]), np.array([x.mark for x in lines])
    heading, inside = np.array([x.heading for x in lines]), np.array([x.inside for x in lines])
    around, left = _evidence(parser)
    factor = np.array(left)
    ratio = (chars - linked) / tags
    value = ratio * factor[mark]
    smooth = smoothed(value, cfg.sigma)
    cut = min(two_means(smooth), float(smooth.max())) * (1 - 1e-9)

    # Furniture: marked elements of little value or mostly links, and runs of short links.
    add = lambda x: np.bincount(mark, weights=x, minlength=len(left))
    c, t, k = (_totals(add(x), around) for x in (chars, tags, linked))
    strong = np.array([m[2] for m in parser.marks])
    low = (factor < 1) & ((k > cfg.linked * c) | ((c - k) * factor < np.where(strong, cfg.thin, min(cut, cfg.thin)) * np.maximum(t, 1)))
    of_strong, of_any = [False], [False]
    for i in range(1, len(left)):
        of_any.append(bool(low[i]) or of_any[around[i]])
        of_strong.append(bool(low[i]) and parser.marks[i][2] or of_strong[around[i]])
    furniture = np.where(heading & inside, np.array(of_strong)[mark], np.array(of_any)[mark])
    links = (linked > 0) & (ratio < 1) & ~heading
    run = np.cumsum(np.r_[True, (links[1:] != links[:-1]) | (element[1:] != element[:-1]) & ~(links[1:] & links[:-1])])
    per_tag = np.bincount(run, weights=chars) / np.maximum(np.bincount(run, weights=tags), 1)
    furniture |= links & (per_tag[run] < cfg.bare)
    seeds = (smooth >= cut) & (value >= cfg.own * cut) & ~furniture
    if not seeds.any():
        return ""

    # Regions: the smallest elements of several lines around seeds, grown while they do not take in furniture.
    parents = parser.parents
    weight = np.where(heading, cfg.heading, 1)
    at = lambda x: _totals(np.bincount(element, weights=x, minlength=len(parents)), parents)
    count, good, bad = at(np.ones(len(lines))), at(np.where(furniture | links, 0, weight)), at((furniture | links).astype(float))
    region = np.zeros(len(parents), bool)
    done: set[int] = set()
    for e in np.unique(element[seeds]).tolist():
        path = []
        while parents[e] >= 0 and e not in done and (count[e] < 2 or bad[parents[e]] - bad[e] <= good[parents[e]] - good[e]):
            path.append(e)
            e = parents[e]
        if e not in done:
            region[e] = True
        done.update(path, (e,))
    # A region that has not grown beyond one line counts only beside no larger ones.
    text = at(np.where(furniture, 0, chars))
    region &= (count > 1) | (text >= cfg.alone * text[region].max(initial=0))
    for e, around_it in parser.containers[1:]:
        region[e] |= not of_any[around_it] and good[e] > 0
    held = region.tolist()
    for i in range(1, len(held)):
        held[i] = held[i] or held[parents[i]]
    keep = np.array(held)[element] & ~furniture
    return "\n".join(lines[i].text for i in np.flatnonzero(keep))


def _extract(cfg: HtmlConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", cfg) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, cfg: HtmlConfig = HtmlConfig()) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of (page_id, url, html).

    Null or empty html gives an empty text, as does a page of furniture only. A
    page that breaks off is read to its end. Pages are read one by one where they
    lie; repeated and null ids are kept. An empty table gives no rows.
    """
    out = pages.select("page_id", "url", "html").mapInArrow(_extract(cfg), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
