"""Main text of web pages.

The standard library's parser is fed as a stream; its events are turned into
lines, one per block element, with the characters and tags of each. The ratio
of text to tags per line is smoothed with a Gaussian. What tags, roles, classes
and ids say about a line raises or lowers its ratio: article and main elements
raise it, menus, headers, footers, sidebars, notices, adverts, forms and, most
of all, comments lower it. A mark on an element that holds most of the page's
dense text counts for nothing, unless it says comments. The logarithms of the
weighted ratios form two clusters, and the lines above their threshold are the
content; a lowered line must be above it by itself, not by its neighbours. With them come the other lines of the region they are in, unless
lowered: of the article or main element, else of the smallest element that
covers them all, else the short lines between them and the heading before.

Defined results: null html is empty; a page without text gives the empty
string; markup that the parser refuses is read as text, an unclosed comment is
a comment to the end; repeated pages each give their row; other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches

#: lines, for the Gaussian
SIGMA = 1.5
#: what a line's ratio is multiplied by: in an article or main element, in a lowered element, in comments
RAISED, LOWERED, COMMENT = 3.0, 0.02, 0.0005
#: share of the page's dense text that takes an element's mark away
SHARE = 0.5
#: logarithms closer than this are one cluster: a ratio four times another is no other kind of line
ALIKE = float(np.log(4))
#: lines between two regions of content, or a heading and one, that are joined with them
GAP = 3

#: fixed values: HTML elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "script style noscript template head title button select textarea option iframe object svg canvas audio video math applet map datalist".split()
)
LOW = frozenset("nav header footer aside form menu dialog".split())
SECTIONS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: fixed values: ARIA roles and words of class and id that mark boilerplate
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
MARKS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion "
    "sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "disqus respond share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager toolbar widget masthead copyright skip".split()
)
COMMENTS = frozenset("comment comments reply replies".split())
COMMENTS = frozenset("comment comments reply replies".split())
#: an end tag that was left out ends before these starts
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "dd", "dt"} | {"dd", "dt"},
    "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
}
#: elements that keep what was opened outside them open
SCOPES = frozenset("article section div body html td th table main aside nav header footer form ul ol dl blockquote figure".split())
_WORD = re.compile(r"[a-z0-9]+")


class _Element:
    """An open element: whether it shows no text, and what it says about its lines (a section, lowered, comments)."""

    __slots__ = ("tag", "number", "skipped", "says", "parent")

    def __init__(self, tag, number, skipped, says, parent):
        self.tag, self.number, self.skipped, self.says, self.parent = tag, number, skipped, says, parent


class Events(HTMLParser):
    """Lines (text, tags, element) of a page, from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", 0, False, "", None)
        self.open = [self.root]
        self.elements = 1
        self.lines: list[tuple[str, int, _Element]] = []
        self._text: list[str] = []
        self._tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._tags, self.open[-1] if self.open[-1].tag in BLOCK else self._block()))
            self._tags = 0
        self._text = []

    def _block(self) -> _Element:
        return next((e for e in reversed(self.open) if e.tag in BLOCK), self.root)

    @staticmethod
    def _hidden(tag: str, attrs) -> bool:
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _says(self, tag: str, attrs) -> str:
        """``section``, ``low``, ``comments`` or nothing."""
        if tag in ("html", "body"):
            return ""
        marks = {w for n, v in attrs if n in ("class", "id") and v for w in _WORD.findall(v.lower())}
        if marks & COMMENTS:
            return "comments"
        if tag in SECTIONS:
            return "section"
        if tag in LOW:  # an article may have a header of its own
            return "" if tag == "header" and any(e.says == "section" for e in self.open) else "low"
        if marks & MARKS or any(n == "role" and v and v.strip().lower() in ROLES for n, v in attrs):
            return "low"
        return ""

    def handle_starttag(self, tag, attrs):
        if not self.open[-1].skipped:
            self._tags += 1
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        self._close_implied(tag)
        if tag in VOID:
            return
        parent = self.open[-1]
        self.open.append(_Element(tag, self.elements, parent.skipped or tag in SKIPPED or self._hidden(tag, attrs), self._says(tag, attrs), parent))
        self.elements += 1

    def _close_implied(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            own = self.open[at].tag
            if tag in CLOSED_BY.get(own, ()):
                del self.open[at:]
                return
            if own in SCOPES:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        if not self.open[-1].skipped:
            self._tags += 1
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if tag not in BLOCK and self.open[at].tag in SCOPES:
                return

    def handle_data(self, data):
        if not self.open[-1].skipped:
            self._text.append(data)


def _fed(html: str) -> Events:
    events = Events()
    events.feed(html)
    if events.rawdata.startswith("<!--"):  # a comment that is never closed
        events.rawdata = ""
    events.close()
    events._flush()
    return events


def _fed(html: str) -> Events:
    events = Events()
    events.feed(html)
    if events.rawdata.startswith("<!--"):  # a comment that is never closed
        events.rawdata = ""
    events.close()
    events._flush()
    return events


def _lines(html: str) -> list[tuple[str, int, _Element]]:
    try:
        return _fed(html).lines
    except AssertionError:  # a marked section that the parser does not know
        return _fed(html.replace("<![", "&lt;![")).lines


def smoothed_ratios(lines, sigma: float = SIGMA) -> np.ndarray:
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines], float)
    reach = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach)
    ones = np.pad(np.ones(len(ratios)), reach)
    return np.convolve(padded, weights, "valid") / np.convolve(ones, weights, "valid")


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the values (two-means in one dimension); the least value if they are all alike."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        above = values >= cut
        if above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return min((low + high) / 2, float(values.max()))


def _path(element: _Element) -> list[_Element]:
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out


def _void_marks(lines, paths, dense: np.ndarray) -> set[int]:
    """Elements whose mark counts for nothing: they hold most of the dense text, with more than one line, and no section lies outside."""
    held: dict[int, int] = {}
    count: dict[int, int] = {}
    sections: list[set[int]] = []
    total = 0
    for (text, _, _), path, good in zip(lines, paths, dense):
        if any(e.says == "comments" for e in path):
            continue
        numbers = {e.number for e in path}
        if any(e.says == "section" for e in path):
            sections.append(numbers)
        if good:
            total += len(text)
        for e in path:
            if e.says == "low":
                held[e.number] = held.get(e.number, 0) + (len(text) if good else 0)
                count[e.number] = count.get(e.number, 0) + 1
    return {n for n, chars in held.items() if chars > SHARE * total and count[n] > 1 and all(n in s for s in sections)}


def _weight(path, void: set[int]) -> float:
    says = {e.says for e in path if e.number not in void}
    return COMMENT if "comments" in says else LOWERED if "low" in says else RAISED if "section" in says else 1.0


def _covering(paths) -> _Element:
    """The deepest element that is on all paths; paths lead from an element to the root."""
    common = set.intersection(*({e.number for e in p} for p in paths))
    return next(e for e in paths[0] if e.number in common)


def _joined(lines, content: list[int], fine: np.ndarray) -> set[int]:
    """Regions of content, with the short lines between them and the heading before each; nothing lowered comes between."""
    out = set(content)
    for a, b in zip(content, content[1:]):
        if b - a <= GAP + 1 and fine[a:b].all():
            out.update(range(a, b))
    for a in content:
        for i in range(a - 1, max(a - 1 - GAP, -1), -1):
            if i in out or not fine[i]:
                break
            if lines[i][2].tag in HEADINGS:
                out.update(range(i, a))
                break
    return out


def _void_marks(lines, paths, dense: np.ndarray) -> set[int]:
    """Elements whose mark counts for nothing: they hold most of the dense text, with more than one line, and no section lies outside."""
    held: dict[int, int] = {}
    count: dict[int, int] = {}
    sections: list[set[int]] = []
    total = 0
    for (text, _, _), path, good in zip(lines, paths, dense):
        if any(e.says == "comments" for e in path):
            continue
        numbers = {e.number for e in path}
        if any(e.says == "section" for e in path):
            sections.append(numbers)
        if good:
            total += len(text)
        for e in path:
            if e.says == "low":
                held[e.number] = held.get(e.number, 0) + (len(text) if good else 0)
                count[e.number] = count.get(e.number, 0) + 1
    return {n for n, chars in held.items() if chars > SHARE * total and count[n] > 1 and all(n in s for s in sections)}


def _weight(path, void: set[int]) -> float:
    says = {e.says for e in path if e.number not in void}
    return COMMENT if "comments" in says else LOWERED if "low" in says else RAISED if "section" in says else 1.0


def _covering(paths) -> _Element:
    """The deepest element that is on all paths; paths lead from an element to the root."""
    common = set.intersection(*({e.number for e in p} for p in paths))
    return next(e for e in paths[0] if e.number in common)


def _joined(lines, content: list[int], fine: np.ndarray) -> set[int]:
    """Regions of content, with the short lines between them and the heading before each; nothing lowered comes between."""
    out = set(content)
    for a, b in zip(content, content[1:]):
        if b - a <= GAP + 1 and fine[a:b].all():
            out.update(range(a, b))
    for a in content:
        for i in range(a - 1, max(a - 1 - GAP, -1), -1):
            if i in out or not fine[i]:
                break
            if lines[i][2].tag in HEADINGS:
                out.update(range(i, a))
                break
    return out


def main_blocks(html: str) -> list[str]:
    """The blocks of the main text, in page order."""
    lines = _lines(html)
    if not lines:
        return []
    paths = [_path(element) for _, _, element in lines]
    ratios = smoothed_ratios(lines)
    void = _void_marks(lines, paths, ratios >= threshold(ratios))
    weights = np.array([_weight(p, void) for p in paths])
    scores = np.log(np.maximum(ratios, 1e-9) * weights)
    cut = threshold(scores) if np.ptp(scores) > ALIKE else scores.min()
    own = np.log(np.array([len(text) / max(1, tags) for text, tags, _ in lines]) * weights)
    lifted = (weights < 1) & (own < cut)  # a dense neighbour does not lift what is lowered
    over = scores >= cut
    content = np.flatnonzero(over & ~lifted if (over & ~lifted).any() else over).tolist()
    fine = weights >= min(1.0, weights[content].max())  # where everything is lowered, nothing is
    chosen: set[int] = set()
    loose = []
    for i in content:
        section = next((e for e in reversed(paths[i]) if e.says == "section" and fine[i]), None)
        if section is None:
            loose.append(i)
        elif i not in chosen:
            chosen |= {k for k, p in enumerate(paths) if fine[k] and any(e is section for e in p)}
    loose = [i for i in loose if own[i] >= cut] or loose  # short lines come with their region, not by themselves
    if loose:
        around = _covering([paths[i] for i in loose])
        if around.tag in BLOCK - {"html", "body"} and around is paths[loose[0]][0] and around.parent is not None:
            around = around.parent  # one line alone: the element that it stands in
        if not chosen and around.tag not in ("", "html", "body"):
            chosen |= {k for k, p in enumerate(paths) if fine[k] and any(e is around for e in p)}
        else:
            chosen |= _joined(lines, loose, fine)
    return [lines[i][0] for i in sorted(chosen)]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html or ""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    rows = in_small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
