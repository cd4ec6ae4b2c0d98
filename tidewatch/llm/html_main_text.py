"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser is fed a page and its events fill lines: a line is the text between
two block boundaries, with the number of tags met in it and the box (section, division, list …) it
lies in. A line's ratio is its counted text over its tags. Link text isn't counted, nor is text in
an element that HTML itself sets apart (navigation, footer, form, aside and so on, or such a role).
The ratios of all lines, in page order, are smoothed with a Gaussian, which does not reach over the
edge of a box that bears a mark (a class, an id), and cut at a share of their mean.

Runs of lines at or over the cut are the clusters of content. A box is content if a line of its own
is; a box without one is closed into the content around it only if it bears no mark. Where HTML says which element is the article, clusters in it count more. The region is the
smallest box that holds nearly all counted text of the clusters; of it come the lines of all content
boxes, short ones too. What has no cluster of its own (adverts, notices, menus without a name,
teasers, short comments) goes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table, with_arrow_columns

#: Elements whose content is never text of a page.
SILENT = frozenset("script style noscript template svg math iframe object select textarea button canvas audio video head".split())
#: Elements that hold something other than the article, and the roles that say the same.
ASIDE = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog menu menubar toolbar".split())
#: What a head may hold; any other element, or text, ends a head whose end tag is missing.
HEAD_OWN = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
#: Parts of an article, which belong to the container they are in.
PARTS = frozenset("ul ol dl table thead tbody tfoot tr caption blockquote pre figure figcaption details summary center address".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks of a line or two, which are no containers.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt td th option optgroup legend title br hr".split())
#: Elements without an end tag of their own when another of the kind, or their parent's end, comes.
LOOSE = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Whole names (a class or an id, in lower case without hyphens) that say reader comments: long ones have an article's ratios.
COMMENTS = frozenset("comment comments commentlist commentsection commentsarea usercomments readercomments userfeedback disqus replies".split())
_CUT = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_OPEN = re.compile(r"<[A-Za-z/!?]")
SIGMA = 1.0
#: Of the mean smoothed ratio; lines at or above it are content.
THRESHOLD = 0.8
#: Share of the content's text from which a container is the region rather than what it lies in.
DOMINANT = 0.75
#: How many times the text of an article or main element counts when the region is chosen.
TOLD = 4
#: Letters from which a line is taken for a paragraph.
PARAGRAPH = 80


@dataclass
class Box:
    """A container: what it lies in, its tag, whether HTML bars it, whether it has no class or id, and whether it is an article."""

    parent: int
    tag: str = ""
    barred: bool = False
    plain: bool = False
    article: bool = False


class _Lines(HTMLParser):
    """Collects the page's lines (text, tags, link characters, container) and containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.boxes = [Box(-1, plain=True)]
        #: tag, container, silent, in a main (1) or article (2) element, in a link
        self.stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]
        #: Where in the stack the elements of a tag, and blocks, are.
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self.text: list[str] = []
        self.tags = self.linked = 0

    def cut(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                self.lines.append((" ".join(words), self.tags, self.linked, self.stack[-1][1]))
            self.text = []
        self.tags = self.linked = 0

    def drop(self, to: int) -> None:
        """Close the elements from a place of the stack on."""
        while len(self.stack) > to:
            self.places[self.stack.pop()[0]].pop()
        while self.blocks[-1] >= to:
            self.blocks.pop()

    def end_head(self, surely: bool = False) -> None:
        """End an open head, unless something silent is open in it."""
        at = self.places.get("head")
        if at and (surely or max(self.places[t][-1] for t in SILENT if self.places.get(t)) == at[-1]):
            self.cut()
            self.drop(at[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack[-1][2] and tag not in HEAD_OWN:
            self.end_head(tag == "body")
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        loose = LOOSE.get(tag)
        if loose:
            while self.stack[-1][0] in loose:
                self.drop(len(self.stack) - 1)
        _, box, silent, article, link = self.stack[-1]
        silent = silent or tag in SILENT
        if not silent:
            made = self.box(tag, dict(attrs), box, article)
            if made is not None:
                self.boxes.append(made)
                box = len(self.boxes) - 1
            article = max(article, ("main", "article").index(tag) + 1 if tag in ("main", "article") else 0)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, box, silent, article, link or tag == "a"))

    @staticmethod
    def box(tag: str, attrs: dict[str, str | None], parent: int, article: int) -> Box | None:
        """The container that an element makes, if it makes one."""
        value = lambda name: (attrs.get(name) or "").lower()
        hidden = "hidden" in attrs or value("aria-hidden") == "true" or "display:none" in value("style").replace(" ", "")
        barred = tag in ASIDE or (tag == "header" and not article) or (tag == "article" and article == 2) or value("role") in ROLES
        names = {x.replace("-", "").replace("_", "") for x in f"{value('class')} {value('id')}".split()}
        barred = barred or hidden or (bool(names & COMMENTS) and tag not in ("html", "body", "main", "article"))
        if tag in ("html", "body") or (tag not in BLOCKS and not hidden):
            return None
        if (tag in FLOW or tag in PARTS) and not barred:
            return None
        return Box(parent, tag, barred, not names, tag in ("article", "main") and not barred)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        at = self.places.get(tag)
        if tag not in VOID and at and (tag in BLOCKS or at[-1] > self.blocks[-1]):
            self.drop(at[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.end_head()
        if not self.stack[-1][2]:
            self.text.append(data)
            if self.stack[-1][4]:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside are left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    inside = np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / inside


def smooth_runs(values: np.ndarray, key: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Smoothing within runs of lines of one key, so that an advert between long paragraphs doesn't take their ratios."""
    edges = np.flatnonzero(np.diff(key)) + 1
    return np.concatenate([smooth(x, sigma) for x in np.split(values, edges)])


def parsed(html: str) -> _Lines:
    """The lines and containers of a page.

    Scripts, styles and comments are cut out beforehand, each up to its end or the page's, and a tag
    that never ends is left out, as browsers do; the parser would look for those ends again and again.
    """
    html = _CUT.sub("", html)
    unfinished = _OPEN.search(html, html.rfind(">") + 1)
    html = (html[: unfinished.start()] if unfinished else html).replace("<![", "<!x[")  # a declaration ends at its first ">"
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser


def _up(boxes: list[Box], own: np.ndarray) -> np.ndarray:
    """Sums over each container and all in it, from the sums of the containers' own lines."""
    whole = own.copy()
    for i in range(len(boxes) - 1, 0, -1):
        whole[boxes[i].parent] += whole[i]
    return whole


def _first_last(boxes: list[Box], box: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of some lines in each container and all in it."""
    first, last = np.full(len(boxes), len(box)), np.full(len(boxes), -1)
    np.minimum.at(first, box[at], at), np.maximum.at(last, box[at], at)
    for i in range(len(boxes) - 1, 0, -1):
        up = boxes[i].parent
        first[up], last[up] = min(first[up], first[i]), max(last[up], last[i])
    return first, last


def main_text(html: str | None, threshold: float = THRESHOLD, sigma: float = SIGMA) -> str:
    """The article of a page: its blocks in order, joined by one space; empty if there is none.

    Character references are decoded and white space inside a block becomes one space. A page that
    is null, or whose lines are all links or barred, is empty.
    """
    page = parsed(html or "")
    lines, boxes = page.lines, page.boxes
    if not lines:
        return ""
    n = len(boxes)
    box = np.array([x[3] for x in lines])
    size, tags, linked = (np.array([f(x) for x in lines]) for f in (lambda x: len(x[0]), lambda x: max(x[1], 1), lambda x: x[2]))
    barred, told = np.zeros(n, bool), np.zeros(n, bool)
    for i, b in enumerate(boxes):
        up = b.parent >= 0
        barred[i] = b.barred or (up and barred[b.parent])
        told[i] = not barred[i] and (b.article or (up and told[b.parent]))
    links = 2 * linked >= size
    counted = np.where(barred[box] | links, 0, size - linked)
    if not counted.any():
        return ""
    marked = np.zeros(n, np.int64)
    for i in range(1, n):
        marked[i] = marked[boxes[i].parent] if boxes[i].plain and not barred[i] else i
    smoothed = smooth_runs(counted / tags, marked[box], sigma)
    over = (smoothed >= threshold * smoothed.mean()) & (counted > 0)

    # The region: from the page downwards, the container that holds nearly all text of the clusters.
    weight = _up(boxes, np.bincount(box, np.where(over, counted, 0) * np.where(told[box], TOLD, 1), n))
    best: dict[int, int] = {}
    for i in range(1, n):
        if boxes[i].parent not in best or weight[i] > weight[best[boxes[i].parent]]:
            best[boxes[i].parent] = i
    # What a container's own lines and its boxes without a mark weigh: such boxes are parts of one text.
    parts = np.bincount(box, np.where(over, counted, 0) * np.where(told[box], TOLD, 1), n)
    for i in range(1, n):
        if boxes[i].plain:
            parts[boxes[i].parent] += weight[i]
    holds = _up(boxes, np.bincount(box, told[box] & over, n)) > 0
    region = 0
    while not boxes[region].article and region in best:
        child = best[region]
        least = 0.5 if holds[child] else DOMINANT
        whole = holds[child] or parts[region] == (weight[child] if boxes[child].plain else 0)
        if not weight[child] or weight[child] < least * weight[region] or not whole:
            break
        region = child
    if boxes[region].tag == "main" and region in best and boxes[best[region]].article and 2 * weight[best[region]] > weight[region]:
        region = best[region]

    content = _up(boxes, np.bincount(box, over, n)) > 0
    begin, end = _first_last(boxes, box, np.flatnonzero(over))
    first, last = _first_last(boxes, box, np.arange(len(lines)))
    some = _up(boxes, np.bincount(box, counted > 0, n)) > 0
    prose = _up(boxes, np.bincount(box, np.where(counted > 0, size, 0), n)) * 2 > _up(boxes, np.bincount(box, size, n))
    stays, inside = np.zeros(n, bool), np.zeros(n, bool)
    stays[region] = inside[region] = True
    for i in range(region + 1, n):
        b = boxes[i]
        inside[i] = inside[b.parent]
        if not inside[i] or barred[i] or not stays[b.parent] or first[i] > last[i]:
            continue
        # A gap: a box without a mark in a box of content, or one with a boxed source between two lines of content.
        between = begin[b.parent] < first[i] and last[i] < end[b.parent]
        loose = b.plain and (region != 0 or between) and some[i] and prose[i]
        note = between and last[i] == first[i] and links[first[i]]
        stays[i] = (content[i] and prose[i]) or loose or note
    kept = stays[box]
    if not told[region]:
        # Menus at the ends of a region that HTML does not name: links before its first and after its last content.
        core = np.flatnonzero(kept & over)
        ends = (len(lines), -1) if not len(core) else (core[0], core[-1])
        kept &= ~(links & ((np.arange(len(lines)) < ends[0]) | (np.arange(len(lines)) > ends[1])))
        if region == 0:
            # The page itself is no container of one text: its own lines stay only between, and next to, content.
            loose_ = (box == 0) & ~over & ((np.arange(len(lines)) < ends[0] - 1) | (np.arange(len(lines)) > ends[1] + 1))
            kept &= ~loose_
    return " ".join(lines[i][0] for i in np.flatnonzero(kept))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append text and n_chars (code points) of every whole page; null and empty pages give "" and 0.

    Kept columns (all where not given) pass through, whatever their names, but for text and n_chars
    themselves, which are replaced. A broken page yields what its events yield.
    """

    def compute(batch: pa.RecordBatch) -> list:
        found = [main_text(x) for x in batch.column(0).to_pylist()]
        return [found, [len(x) for x in found]]

    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    return with_arrow_columns(pages, {"html": F.col(f"`{html}`")}, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute, kept)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
