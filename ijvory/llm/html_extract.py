"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams its events into lines, one for each block
of the page. A line's ratio is its characters over its tags; the ratios in page
order are smoothed by a Gaussian and clustered by a threshold, their standard
deviation. The content region is the article (or else the innermost container)
that holds the mass of the lines above the threshold, or the innermost container
around it and the shown titles and lines above the threshold elsewhere.

In the region the clusters decide again, whatever the elements are called: a line
of links, or of more markup than text, stays only if it, or half the lines of its
list or container, are above the threshold. Short lines of plain text stay. What
is page furniture by its element or by name is left out before that; names that
may also be those of an article's part count outside of articles alone.

What a page leaves open is ended as a browser does: a comment at the end of the
page, a tag without an end is not shown, one with an unclosed quote ends at the next
bracket. Time is linear in the length of the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.llm.common import slices

# Fixed sets of element names and of words in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head title script style noscript template nav footer aside form menu dialog button select option textarea label iframe object svg canvas audio video".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
REGIONS = frozenset("article main".split())
TITLES = ("h1", "h2")
LISTS = frozenset("ul ol dl".split())
CONTAINERS = REGIONS | LISTS | frozenset("body section div td table center".split())
#: Elements that may be furniture by name; titles and quotations never are.
NAMEABLE = frozenset("div section header table tr td ul ol li dl dt dd p span ins figure center details fieldset".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside related "
    "recommended recommendations share sharing comment comments commentlist disqus discussion respond replies toolbar skip complementary contentinfo".split()
)
#: Names that count outside of articles only: in one they may be those of its parts.
WEAK = frozenset("side search alert alerts login social widget widgets teaser teasers reactions copyright".split())
#: Words that may stand beside one of these in a name, as in site-header; any other word, as in article-header, makes it a name of its own.
BESIDE = frozenset("site top bottom left right main global primary secondary list box bar block area container wrapper inner links link buttons button posts items item slot unit thread form section panel col column user users reader readers visitor visitors holder wrap inline content area text".split())
#: Elements that a start tag ends if they are open, up to the elements that keep them open.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
SIGMA, RADIUS = 1.0, 2
#: The share of the content mass that the region must hold.
MASS = 0.8
JOIN = "\n\n"


#: Inline tags of a line from which on it may be more markup than text, and characters for each tag below which it is.
MARKS, DENSE = 6, 8


def named(mark: str, weak: bool = True) -> bool:
    """Whether a word of class, id or role is a name of page furniture, or one of the weak names; numbers and single letters in it mean nothing."""
    for word in mark.split():
        parts = [x for x in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if len(x) > 1 and not x.isdigit()]
        names = [x in NAMES or weak and x in WEAK for x in parts]
        if any(names) and all(n or x in BESIDE for n, x in zip(names, parts)):
            return True
    return False


class Line(NamedTuple):
    text: str
    tags: int
    place: int
    hidden: bool
    title: bool
    linked: bool
    dense: bool


class Lines(HTMLParser):
    """Collects a ``Line`` for each block with text, in page order.

    A line's place is the innermost container, a number; ``parent`` and ``kind`` have its parent, -1 for none, and its name.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool]] = []  # name, furniture
        self.names: defaultdict[str, list[int]] = defaultdict(list)  # where in it each name is open
        self.blocks: list[int] = []  # where in it elements are that are not inline
        self.parent: list[int] = []
        self.kind: list[str] = []
        self.inside = -1
        self.sections = True  # whether a section's end may still come
        self.words: list[str] = []
        self.tags = self.marks = self.hidden = self.linked = 0

    # Each of these reads to the end of the page once at most: what has no end is taken to be ended there.

    def parse_comment(self, i, report=1):
        found = re.compile("-?>").match(self.rawdata, i + 4) or re.compile(r"--!?\s*>").search(self.rawdata, i + 4)
        return found.end() if found else len(self.rawdata)

    def parse_html_declaration(self, i):
        page = self.rawdata
        if self.sections and page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            if end >= 0:
                return end + 3
            self.sections = False
        return page.find(">", i) + 1 or len(page)

    def parse_pi(self, i):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        return end if end > i else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_endtag(self, i):
        return super().parse_endtag(i) if self.rawdata.find(">", i) > 0 else len(self.rawdata)

    def _end_line(self):
        text = " ".join("".join(self.words).split())
        if text:
            title = any(self.names[name] for name in TITLES)
            dense = self.marks >= MARKS and len(text) < DENSE * self.marks
            self.lines.append(Line(text, max(1, self.tags), self.inside, self.hidden > 0, title, 2 * self.linked > len(text), dense))
            self.tags = 0
        self.words = []
        self.linked = self.marks = 0

    def _pop(self, depth: int):
        """End the open elements from ``depth`` on, the last first."""
        for name, furniture in reversed(self.open[depth:]):
            self.names[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            if furniture:
                self._end_line()
            self.hidden -= furniture
            if name in CONTAINERS:
                self.inside = self.parent[self.inside]
        del self.open[depth:]

    def _imply(self, tag: str):
        """End what a start tag ends without saying so."""
        if tag in ENDS:
            ended, keepers = ENDS[tag]
            kept = max((self.names[x][-1] for x in keepers if self.names[x]), default=-1)
            found = [self.names[x][k] for x in ended if (k := bisect_right(self.names[x], kept)) < len(self.names[x])]
            if found:
                self._pop(min(found))
        elif tag not in INLINE and self.blocks and self.open[self.blocks[-1]][0] == "p":
            # a block ends the paragraph that is open, with the inline elements in it
            self._pop(self.blocks[-1])

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        if tag not in INLINE:
            self._end_line()
        elif tag not in VOID:
            self.marks += 1
        if tag in VOID:
            return
        self._imply(tag)
        mark = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        article = any(self.names[x] for x in REGIONS)
        furniture = tag in FURNITURE or tag in NAMEABLE and named(mark, not article) or tag == "article" and "comment" in mark.lower()
        furniture = furniture or tag == "header" and not article
        if furniture:
            self._end_line()  # also for a span of furniture inside a block
        self.names[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, furniture))
        self.hidden += furniture
        if tag in CONTAINERS:
            self.parent.append(self.inside)
            self.kind.append(tag)
            self.inside = len(self.parent) - 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash on other than void elements means nothing

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if not self.names[tag]:
            return
        depth = self.names[tag][-1]
        if tag in INLINE and self.blocks and self.blocks[-1] > depth:
            return  # a block that is still open holds on
        self._pop(depth)

    def handle_data(self, data):
        self.words.append(data)
        if self.names["a"]:
            self.linked += len(data.strip())

    def close(self):
        super().close()
        self._end_line()


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside the page are made to sum to one."""
    k = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    full = lambda x: np.convolve(x, k)[RADIUS : RADIUS + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def gathered(values: np.ndarray, places: np.ndarray, parent: list[int]) -> np.ndarray:
    """The sum of the lines' values in each container and those inside it; the last sum is the page's."""
    held = np.zeros(len(parent) + 1)
    np.add.at(held, places, values)  # -1 stands for no container
    for c in range(len(parent) - 1, -1, -1):  # inner ones have higher numbers
        held[parent[c]] += held[c]
    return held


def inside_of(top: int, parent: list[int]) -> np.ndarray:
    """Whether each container is ``top`` or inside it; all are inside of the page, -1."""
    found = np.zeros(len(parent) + 1, bool)
    found[top] = True
    for c, up in enumerate(parent):
        found[c] |= found[up]
    return found


def main_text(html: str | None) -> str:
    """The blocks of the content region, joined by blank lines; empty if there is no text."""
    page = Lines()
    page.feed(html or "")
    page.close()
    lines = page.lines
    shown = np.array([not x.hidden for x in lines], bool)
    if not shown.any():
        return ""
    sizes = np.array([len(x.text) for x in lines], float)
    ratios = sizes / np.array([x.tags for x in lines])
    title, places = np.array([x.title for x in lines]), np.array([x.place for x in lines])
    linked = np.array([x.linked for x in lines])
    smoothed = smooth(ratios)
    content = (smoothed >= smoothed.std()) & shown
    mass = np.where(content & ~linked, sizes, 0.0)
    if not mass.any():
        mass = np.where(content if content.any() else shown, sizes, 0.0)
    held = gathered(mass, places, page.parent)
    enough = [c for c in range(len(page.parent)) if held[c] >= MASS * mass.sum() and page.kind[c] not in LISTS]
    # the innermost article; else the innermost container; else the page
    inner = max([c for c in enough if page.kind[c] in REGIONS] or enough, default=-1)
    own = inside_of(inner, page.parent)[places]
    # the innermost container of the region and of the shown titles and content lines elsewhere, which are so by their own ratio too
    needed = shown & ~own & (title | (mass > 0) & (ratios >= smoothed.std()) & ~linked)
    around = gathered(needed.astype(float), places, page.parent)
    region = inner
    while region >= 0 and around[region] < needed.sum():
        region = page.parent[region]
    within = inside_of(region, page.parent)[places]
    # lines of links or of mere markup stay where the clusters call them, or half of their list or container, content
    votes = np.where(shown, np.where(content, 1.0, -1.0), 0.0)
    vote = np.zeros(len(page.parent) + 1)
    np.add.at(vote, places, votes)
    elected = np.where(places == inner, content, vote[places] >= 0)
    plain = ~linked & ~np.array([x.dense for x in lines])
    kept = shown & within & (title | (plain | elected) & own | ~own & plain)
    return JOIN.join(x.text for x, k in zip(lines, kept) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` for every row.

    Null and empty pages, and pages without text, have the empty text; repeated rows come
    out as they are; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, len(keep))):
            texts = pa.array([main_text(h) for h in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.record_batch([*b.columns[:-1], texts], names=[*keep, "text"])

    both = pages.select(*keep, F.col(html_col).alias("html"))
    schema = ", ".join(f"`{k}` {dict(pages.dtypes)[k]}" for k in keep)
    return both.mapInArrow(run, f"{schema}, text string")
