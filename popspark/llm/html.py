"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams its events.  Each block of text is a line with a ratio: its
characters over the tags since the line before.  The ratios are smoothed by a Gaussian over the
lines, and lines above a threshold (the spread of the smoothed ratios) are content.  Elements and
names only exclude: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments; a header within an article is the article's.  A name that only holds such a word
among others excludes lines that are not content by their ratio; one that is such a word excludes all,
unless its element is a wrapper of the article (it holds most of the content lines' characters, and
the page's heading, its main element or nine tenths of its content).  Of the lines that are left,
content lines close to each other form clusters, and the clusters choose the regions of the page.
Where most of the main cluster (that with most characters) is in articles, these are all articles
that hold content lines; else the smallest part of the page around each cluster of some size, and
the lines without links that follow in the element around it.  All lines of these regions belong to
the text, short ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIGMA = 1.5  # lines
GAP = 8  # other lines between two content lines of a cluster at most
SIZE = 0.2  # of the main cluster's characters that another cluster has at least

# Elements of HTML by what they do to a text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object script search select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies "
    "discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager "
    "pagination popup promo promos promotion rail recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription toolbar topbar widget widgets".split()
)
# Of these, words that are part of other names too; they count alone, at the end, or before a word for a part of a page.
LOOSE = frozenset("discussion header login notice notices rail reply respond skip social".split())
PARTS = frozenset("area bar block body box button buttons container content feed icon icons inner item items left link links list media menu panel posts articles stories products videos primary right row secondary section top wrap wrapper".split())
STATES = frozenset("has no with without".split())  # the element has a menu, it isn't one
SEMANTIC = frozenset(("article", "main"))
UNNAMED = frozenset(("html", "body", "article", "main"))  # their names say something about the page
HEADINGS = frozenset(("h1",))
REGIONS = frozenset("article body center details dialog div html main section table td th".split())  # what can be a region of a page
# What an opening tag closes, up to the elements that bound the search.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

_JOINT = re.compile("[-_]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Page(HTMLParser):
    """Collects lines (text, tags before it, element, whether something else) and elements.

    Elements are numbered as they open, so what an element holds has the numbers after its own.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, number, something else, inside a block that is something else
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.opened: Counter[str] = Counter()  # by tag, of the stack
        self.parent = [0]
        self.tag_of = [""]
        self.named: list[int] = []  # elements that hold blocks and that a name marks as something else
        self.weak: set[int] = set()  # of these, those whose name has other words too
        self.linked: list[bool] = []  # lines that mostly are links
        self.in_links = self.in_all = 0  # characters of the line
        self.text: list[str] = []
        self.tags = 0
        self.blocks: list[tuple[str, int, int, bool]] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                self.blocks.append((text, self.tags, self.stack[-1][1], self.stack[-1][3]))
                self.linked.append(2 * self.in_links > self.in_all)
                self.tags = 0
            self.in_links = self.in_all = 0

    def pop_to(self, depth: int) -> None:
        self.opened.subtract(x[0] for x in self.stack[depth:])
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            self.close_for(tag)
        if tag in VOID:
            return
        self.parent.append(self.stack[-1][1])
        self.tag_of.append(tag)
        article = any(self.opened[x] for x in SEMANTIC)
        other = self.stack[-1][2] or tag in OTHER and not (article and tag == "header")
        if not other and attrs and tag not in UNNAMED:
            other = self.marked(attrs)
            name = "" if other else self.named_other(attrs, article)
            if name and tag in BLOCKS:
                self.named.append(len(self.tag_of) - 1)
                if name == "weak":
                    self.weak.add(len(self.tag_of) - 1)
            elif name == "whole":
                other = True
        self.stack.append((tag, len(self.tag_of) - 1, other, other if tag in BLOCKS else self.stack[-1][3]))
        self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def close_for(self, tag: str) -> None:
        """Elements that end because ``tag`` begins: an open paragraph, or a sibling of its kind."""
        ends, bounds = CLOSES.get(tag, (frozenset(), frozenset()))
        if not self.opened["p"] and not any(self.opened[x] for x in ends):
            return
        cut = len(self.stack)
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == "p" or name in ends:
                cut = i
            elif name in bounds or (name in BLOCKS and not ends):
                break
        self.pop_to(cut)

    @staticmethod
    def marked(attrs: list) -> bool:
        for name, value in attrs:
            if name == "role":
                if (value or "").strip().lower() in ROLES:
                    return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in (value or "").replace(" ", "").lower()):
                return True
        return False

    @staticmethod
    def named_other(attrs: list, article: bool = False) -> str:
        """``whole`` where a name is a word for something else, with words for a part of a page at most; ``weak`` where it
        has such a word among others; else empty.  Headers of an article are none."""
        found = ""
        for name, value in attrs:
            if name in ("class", "id"):
                for word in (value or "").split():
                    parts = [x.lower() for x in _PARTS.findall(word)]
                    joined = _JOINT.sub("", word).lower()
                    if article and (joined == "header" or set(parts) & NAMES == {"header"}):
                        continue
                    if joined in NAMES:
                        return "whole"
                    if parts and parts[0] in STATES:
                        continue
                    if any(x in NAMES and (x not in LOOSE or i == len(parts) - 1 or parts[i + 1] in PARTS | NAMES) for i, x in enumerate(parts)):
                        if all(x in PARTS | NAMES or x.isdigit() for x in parts):
                            return "whole"
                        found = "weak"
        return found

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS or tag in OTHER:
                    self.pop_to(i)
                else:
                    self.opened[tag] -= 1
                    del self.stack[i]
                return
            if tag not in BLOCKS and tag not in OTHER and self.stack[i][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        _, _, other, block = self.stack[-1]
        if other == block:  # else a script, a button or an advert within a line
            self.text.append(data)
            self.in_all += len(data)
            self.in_links += len(data) if self.opened["a"] else 0


def closed(html: str) -> str:
    """The page with comments and tags that nothing closes as text, for each of which the parser would look through the rest."""
    end = max(html.rfind("-->"), html.rfind("--!>")) + 1
    html = html[:end] + html[end:].replace("<!--", "&lt;!--")
    end = html.rfind(">") + 1
    return html[:end] + html[end:].replace("<", "&lt;")


def parse(html: str) -> _Page:
    page, html = _Page(), closed(html)
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # a marked section that the parser doesn't know: it is text
        page = _Page()
        page.feed(html.replace("<![", "&lt;!["))
        page.close()
    page.flush()
    return page


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian over the lines; the first and the last line go on beyond the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


class _Tree:
    """A page's elements and lines as arrays: what an element holds lies between its number and ``last``."""

    def __init__(self, page: _Page):
        parent, tag_of = page.parent, page.tag_of
        n = len(parent)
        last = list(range(n))
        for e in range(n - 1, 0, -1):
            last[parent[e]] = max(last[parent[e]], last[e])
        heading, main, article = [False] * n, [0] * n, [0] * n
        for e in range(1, n):
            up, tag = parent[e], tag_of[e]
            heading[e] = heading[up] or tag in HEADINGS
            main[e] = e if tag == "main" else main[up]
            article[e] = e if tag in SEMANTIC else article[up]
        self.parent, self.tag_of, self.last, self.article = parent, tag_of, np.array(last), article
        self.of = np.array([b[2] for b in page.blocks], np.int64)  # each line's element
        self.lengths = np.array([len(b[0]) for b in page.blocks], np.int64)
        self.heading, self.main = np.array(heading)[self.of], np.array(main)[self.of]
        self.named, self.weak = page.named, page.weak

    def inside(self, element: int) -> np.ndarray:
        return (self.of >= element) & (self.of <= self.last[element])

    def inside_any(self, elements: list[int]) -> np.ndarray:
        marks = np.zeros(len(self.last) + 1, np.int64)
        np.add.at(marks, elements, 1)
        np.add.at(marks, self.last[elements] + 1, -1)
        return np.cumsum(marks)[self.of] > 0

    def holds(self, element: int, line: int) -> bool:
        return element <= self.of[line] <= self.last[element]

    def around(self, lines: np.ndarray) -> int:
        """The smallest region of the page that holds all the lines."""
        a, b = int(self.of[lines].min()), int(self.of[lines].max())
        while a != b:  # what holds the first and the last holds all between
            if a > b:
                a = self.parent[a]
            else:
                b = self.parent[b]
        while a and self.tag_of[a] not in REGIONS:
            a = self.parent[a]
        return a

    def upto(self, lines: np.ndarray) -> np.ndarray:
        """Characters of the lines in elements numbered below each number, so an element's are a difference."""
        return np.r_[0, np.cumsum(np.bincount(self.of[lines], self.lengths[lines], len(self.last)))].astype(np.int64)

    def articles(self, main: np.ndarray, votes: np.ndarray) -> list[int]:
        """The articles (or main elements) with content lines, if those of the main cluster mostly are in any.

        Of nested ones the outer, if a good part of its content is its own, else those within it.
        """
        inside = np.array(self.article)[self.of[main]] > 0
        if 2 * self.lengths[main][inside].sum() <= self.lengths[main].sum():
            return []
        own = np.bincount(np.array(self.article)[self.of[votes]], self.lengths[votes], len(self.last))
        upto, out, opened = self.upto(votes), [], {0}
        for e in [e for e in range(1, len(self.last)) if self.tag_of[e] in SEMANTIC]:
            held = upto[self.last[e] + 1] - upto[e]
            if not held or self.article[self.parent[e]] not in opened:
                continue
            if own[e] >= SIZE * held:
                out.append(e)
            else:
                opened.add(e)
        return out


def _unmarked(tree: _Tree, rest: np.ndarray, chosen: np.ndarray, clear: np.ndarray) -> np.ndarray:
    """Of the lines ``rest`` those that no name marks as something else, without the names that the content lines overrule.

    ``chosen`` lines are content by the smoothed ratios, ``clear`` ones by their own as well.
    """
    content = rest[chosen[rest]]
    named = np.array(tree.named, np.int64)
    if len(named):
        weak = np.array([e in tree.weak for e in tree.named])
        held, text = (tree.upto(x)[tree.last[named] + 1] - tree.upto(x)[named] for x in (rest[clear[rest]], rest))
        named = named[~(weak & (2 * held > text))]
    marks = np.zeros(len(tree.last) + 1, np.int64)
    np.add.at(marks, named, 1)
    np.add.at(marks, tree.last[named] + 1, -1)
    marks = np.cumsum(marks[:-1])  # names around each element
    lengths, of = tree.lengths[content], tree.of[content]
    upto = tree.upto(content)
    total = upto[-1]
    named = named[2 * (upto[tree.last[named] + 1] - upto[named]) > total] if len(named) else named
    for e in named.tolist():  # each inside the one before
        inside = tree.inside(e)[rest]
        if 10 * lengths[marks[of] == 0].sum() < total or tree.heading[rest][inside].any() or (tree.main[rest][inside] > e).any():
            marks[e : tree.last[e] + 1] -= 1
    own = rest[marks[tree.of[rest]] == 0]
    return own if len(own) or not len(content) else rest


def content_lines(page: _Page) -> np.ndarray:
    """The numbers of the lines that belong to the main text."""
    none = np.zeros(0, np.int64)
    if not page.blocks:
        return none
    tree = _Tree(page)
    ratio = tree.lengths / np.maximum([b[1] for b in page.blocks], 1)
    smooth = smoothed(ratio)
    threshold = smooth.std()
    chosen = smooth > threshold
    clear = chosen & (ratio > threshold)
    own = _unmarked(tree, np.flatnonzero([not b[3] for b in page.blocks]), chosen, clear)
    if not len(own):
        return none
    # Lines whose own ratio is as high come first, as smoothing reaches beyond the ends of a region.
    votes = next(v for v in (clear[own], chosen[own], np.ones(len(own), bool)) if v.any())
    at = np.flatnonzero(votes)
    cluster = np.cumsum(np.r_[0, np.diff(at) > GAP + 1])
    size = np.bincount(cluster, tree.lengths[own[at]])
    regions = dict.fromkeys(tree.articles(own[at[cluster == size.argmax()]], own[at]))
    if not regions:
        for k in np.flatnonzero(size >= SIZE * size.max()):
            a, b = np.searchsorted(cluster, [k, k + 1])
            regions[tree.around(own[at[a:b]])] = int(own[at[b - 1]])  # the later cluster of one region counts
    inside = tree.inside_any(list(regions))
    free = np.zeros(len(page.blocks) + 1, bool)
    free[own] = True
    for e, i in regions.items():
        if i is not None:
            while i < len(inside) and tree.holds(e, i):
                i += 1
            while free[i] and tree.holds(tree.parent[e], i) and not page.linked[i]:
                inside[i] = True
                i += 1
    lines = own[inside[own]]
    if not tree.heading[lines].any():
        before = own[tree.heading[own] & (own < lines[0])]
        lines = np.r_[before[-1:], lines]
    return lines


def main_text(html: str) -> str:
    """The main text of a page: its lines, in page order, joined by two line breaks.

    Empty without text; of equal clusters the first is the main one; repeated lines stay.  Pages are
    parsed whole, in time that follows their length, however deep their elements are nested.
    """
    page = parse(html)
    return "\n\n".join(page.blocks[i][0] for i in content_lines(page).tolist())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text (empty if none) and n_chars (code points).

    Null html counts as empty.  Null ids and urls stay null, repeated rows give repeated rows, an
    empty table an empty one; other columns play no part.  Pages are parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
