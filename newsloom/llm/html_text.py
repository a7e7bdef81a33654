"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered by a threshold.

The events of the standard library's parser cut a page into lines, one per block of text, with the characters of the line, those inside links and
its number of tags. The ratios of characters to tags, smoothed by a Gaussian over neighbouring lines, are split by a
threshold into two clusters; the lines of the upper one are seeds. The element in which the seeds concentrate is the
content region, and its lines are the text, but for those inside elements that are marked as something else.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Standard deviation of the smoothing in lines.
SIGMA = 1.5
#: Share of the seeds' characters that the content region holds when it is found by descending from the page's root.
CONCENTRATION = 0.7

# Elements of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never text of a page.
UNSEEN = frozenset(
    "audio button canvas datalist dialog head iframe math menu noscript object script select style svg template textarea "
    "title video".split()
)
#: Beside the article; an article that begins inside these (an unclosed menu, a form around the page) still counts.
AROUND = frozenset("nav header footer form".split())
ASIDE = frozenset({"aside"})
ROLES_UNSEEN = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of class and id attributes that mark something else than the article.
MARKS_AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies disclaimer "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promotion search share sharing signin signup social sponsor sponsored subscribe subscription "
    "toolbar topbar".split()
)
MARKS_ASIDE = frozenset(
    "comment commentlist comments disqus recommendations recommended related reply replies respond sidebar sidebars teaser teasers "
    "trending widget widgets".split()
)
#: A name with one of these says what is around or missing, as in "has-sidebar".
NEGATIONS = frozenset("has with no without hide show".split())
#: An element of these kinds is the article's own unless it is marked as one of MARKS_ASIDE.
REGIONS = frozenset("article main".split())
#: Elements that can be the content region of a page without such an element.
CONTAINERS = frozenset("blockquote body center div html section table tbody td tr".split())
ROOTS = frozenset("html body".split())
#: An open element that a new one of the kind closes.
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
#: An end or start tag does not close elements beyond these for an unclosed p, li, cell or inline element.
FENCES = frozenset("article main section div table ul ol dl body html nav header footer aside form td th blockquote figure".split())

_MARK = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    """`line` is the exclusion of the block around; `titled`: inside an article's own header, whose headings count."""

    __slots__ = ("tag", "number", "excluded", "line", "titled", "region")

    def __init__(self, tag: str, number: int, excluded: int, line: int, titled: bool, region: bool):
        self.tag, self.number, self.excluded, self.line, self.titled, self.region = tag, number, excluded, line, titled, region


_OUTSIDE = _Element("", -1, 0, 0, False, False)


def _exclusion(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """0: may hold the article; 1: beside it; 2: never part of it."""
    if tag in UNSEEN or tag in ASIDE:
        return 2
    level = 1 if tag in AROUND else 0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if not value or tag in ROOTS:
            continue
        if name in ("class", "id"):
            names = ({w.lower() for w in _MARK.findall(name)} for name in value.split())
            words = set().union(*(n for n in names if not n & NEGATIONS))
            if words & MARKS_ASIDE:
                return 2
            if tag not in REGIONS and words & MARKS_AROUND:
                level = 1
        elif name == "role" and value in ROLES_UNSEEN:
            level = max(level, 1)
        elif name == "style" and _HIDDEN.search(value):
            return 2
    return level


class LineParser(HTMLParser):
    """Cuts a page into lines: (text, characters in links, tags, open elements' numbers, excluded, heading)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], int, bool]] = []
        self.kinds: list[str] = []
        self.open: list[_Element] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = 0

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                excluded = self.open[-1].line if self.open else 0
                heading = any(e.tag in HEADINGS for e in self.open)
                path = tuple(e.number for e in self.open)
                self.lines.append((text, min(self.linked, len(text)), max(1, self.tags), path, excluded, heading))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def _pop(self, at: int) -> None:
        for e in self.open[at:]:
            if e.tag == "a":
                self.in_link = max(0, self.in_link - 1)
        del self.open[at:]

    def _close_open(self, kinds: frozenset[str]) -> None:
        """Close the nearest open element of `kinds`, unless a fence stands before it."""
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.open[at].tag
            if tag in kinds:
                self._pop(at)
                return
            if tag in FENCES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close_open(frozenset({"p"}))
            if tag in CLOSES:
                self._close_open(CLOSES[tag])
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        outer = self.open[-1] if self.open else _OUTSIDE
        own, around = _exclusion(tag, attrs), outer.excluded
        if around == 1 and own == 0 and (tag in REGIONS or outer.titled and tag in HEADINGS):
            around = 0
        excluded = max(around, own)
        titled = outer.titled or tag == "header" and outer.region and around == 0 and own == 1
        line = excluded if tag in BLOCKS else outer.line
        region = outer.region or tag in REGIONS and excluded == 0
        self.open.append(_Element(tag, len(self.kinds), excluded, line, titled, region))
        self.kinds.append(tag)
        if tag == "a":
            self.in_link += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        if tag in VOID:
            return
        for at in range(len(self.open) - 1, -1, -1):
            found = self.open[at].tag
            if found == tag:
                self._pop(at)
                return
            if found in FENCES and tag not in FENCES:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        at = self.open[-1] if self.open else _OUTSIDE
        if at.excluded > at.line:  # an excluded element inside a line
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall outside are left out."""
    reach = max(1, math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, weights)[reach : reach + n] / np.convolve(np.ones(n), weights)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """The midpoint between the means of the two clusters that it separates."""
    cut = float(values.mean())
    for _ in range(100):
        upper, lower = values[values > cut], values[values <= cut]
        if not len(upper) or not len(lower):
            break
        moved = float(upper.mean() + lower.mean()) / 2
        if abs(moved - cut) < 1e-9:
            break
        cut = moved
    return cut


def main_text(html: str, sigma: float = SIGMA) -> str:
    """The article's blocks in page order, one line each."""
    parser = LineParser()
    parser.feed(html)
    parser.finish()
    lines = [line for line in parser.lines if line[4] < 2]
    if not lines:
        return ""
    # A page that is wholly inside a form or the like has no other text.
    free = [i for i, line in enumerate(lines) if not line[4]] or list(range(len(lines)))
    smoothed = smooth(np.array([len(line[0]) / line[2] for line in lines]), sigma)
    cut = threshold(smoothed)
    seeds = [i for i in free if smoothed[i] >= cut and 2 * lines[i][1] <= len(lines[i][0])] or free

    mass: dict[int, int] = defaultdict(int)
    for i in seeds:
        for number in lines[i][3]:
            mass[number] += len(lines[i][0])
    total = sum(len(lines[i][0]) for i in seeds)
    region, own = -1, None
    for kind in ("article", "main"):
        best = max((n for n in mass if parser.kinds[n] == kind), key=lambda n: (mass[n], -n), default=None)
        if best is not None and 3 * mass[best] >= total:
            own = best
            break
    if own is not None:
        region = own
    else:  # from the root down to the element below which the text no longer concentrates
        path = lines[max(seeds, key=lambda i: len(lines[i][0]))][3]
        for number in path:
            if parser.kinds[number] in CONTAINERS and mass[number] >= CONCENTRATION * total:
                region = number
            elif mass[number] < CONCENTRATION * total:
                break
    chosen = []
    for i in free:
        text, linked, _, path, _, heading = lines[i]
        if region >= 0 and region not in path:
            continue
        if own is None and 2 * linked > len(text) and not heading and smoothed[i] < cut:
            continue
        chosen.append(text)
    return "\n".join(chosen)


def extract_text(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text, n_chars of each row of `pages`.

    Null or empty html, and pages without any text of an article, give the empty text. Each whole page is parsed, a page at a time, however
    long; broken markup is read as far as the parser can. Null ids and urls and repeated rows are kept; other columns are not
    looked at; an empty table gives an empty result. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((h.as_py() or b"").decode("utf-8", "replace"), sigma) for h in batch.column(2)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.selectExpr(
        "cast(page_id as long) as page_id", "cast(url as string) as url", "cast(cast(html as string) as binary) as html"
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
