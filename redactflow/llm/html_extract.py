"""Main text of HTML pages: parser events give lines, their text-to-tag ratios
are smoothed and clustered, and the region around the content lines is kept.

1.  The standard library's parser streams events; block elements cut them into
    lines, each with its text, the tags met on it (but for those that only format
    text) and the elements around it.  Inline elements never end a line.
2.  Lines inside menus, footers, asides and what is hidden are never content.
    Elements that a role, class or id marks as sidebar, notice, advert, comments
    and the like, and forms, are suspects: the largest first, each is dropped
    unless it holds several times the text found outside all suspects (see
    ``WRAPS``), for then it wraps the article, whatever it is called.
3.  The ratio of text to tags of the other lines is smoothed with a Gaussian,
    and two-means clustering of the smoothed ratios gives the threshold over
    which a line is content.
4.  The region is the smallest element that holds all content lines (text-level
    elements, lists and tables are never the region).  If article or main elements hold most of the content
    lines' text, it is all the elements of these that hold any, and content lines outside them stay too.  All lines of
    the region that step 2 leaves are the text, short ones as well.

Null or empty html gives the empty text; unclosed and stray tags are repaired
as browsers do; rows repeat as often as they come; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from redactflow.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold text of the article.
SKIP = frozenset("head title script style noscript template iframe object svg canvas form button select textarea option label dialog nav menu aside footer".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot legend title".split())
#: An element that the same or a kindred start tag closes, and where the search for it stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Words of a class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promoted promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall "
    "sidebar side aside widget widgets related recommended recirc "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar skip "
    "footer foot masthead topbar siteheader copyright legal "
    "comment comments commentlist disqus respond reply replies discussion share sharing social login search searchbox form".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: A suspect wraps the article if it holds so many times the text outside suspects: marked by a class or id with
#: further words, plainly marked (or a form), marked as comments, which may well be longer than the article.
WRAPS = {"weak": 1, "other": 4, "comment": 20}
#: Characters that a suspect must hold if there is no text outside.
LEAST_WRAPPED = 100
#: Elements that only format text; they don't count as tags of a line.
FORMATTING = frozenset("abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words that make a mark beside them in a class say what the element has, not what it is.
QUALIFIERS = frozenset("with has have no without not open opened closed enabled disabled show hide".split())
#: A suspect without any of these is no article.
PROSE = frozenset("p h1 h2 h3 blockquote pre article main".split())
#: Elements that are never the region: those of text, and the parts of lists and tables.
INNER = frozenset("p li td th tr tbody thead tfoot table caption ul ol dl dt dd blockquote pre address figure figcaption summary legend hgroup h1 h2 h3 h4 h5 h6".split())


def _marked(attrs: list[tuple[str, str | None]]) -> str:
    """'' or how an element's attributes mark it: 'hidden', 'comment', 'other', or 'weak' if a class or id has further words."""
    marks = set()
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.split():
                words = {x.lower() for x in _WORDS.findall(token)}
                if not (found := words & MARKS):
                    continue
                if words & QUALIFIERS or words - MARKS and not found & COMMENTS:
                    marks.add("weak")
                else:
                    marks.add("comment" if found & COMMENTS else "other")
        elif name == "role" and value and value.strip().lower() in ROLES:
            marks.add("other")
        elif name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "style" and value and _HIDDEN.search(value):
            return "hidden"
    return next((m for m in ("comment", "other", "weak") if m in marks), "")


class Lines(HTMLParser):
    """Collects ``lines``: (text, tags, boxes), boxes being the ids of the block elements around the line.
    ``inside`` has, for each line, those of them that are suspects."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...]]] = []
        self.names: list[str] = ["html"]  # of the boxes, by id
        self.suspects: dict[int, str] = {}  # how they are marked
        self.inside: list[tuple[int, ...]] = []
        self.stack: list[tuple[str, bool, tuple[int, ...], tuple[int, ...]]] = [("", False, (), ())]  # element, outside the article for certain, boxes, suspects
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self.stack[-1][2]))
                self.inside.append(self.stack[-1][3])
                self.tags = 0
            self.parts = []

    def leave(self, names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of ``names`` unless one of ``stops`` comes first; only blocks end a line."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in names:
                if any(x[0] in BLOCK for x in self.stack[k:]):
                    self.cut()
                del self.stack[k:]
                return
            if self.stack[k][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += tag not in FORMATTING
        if tag in BLOCK:
            if tag in CLOSES_P:
                self.leave({"p"}, BLOCK - {"p"})
            if tag in SIBLINGS:
                self.leave(*SIBLINGS[tag])
            self.cut()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, out, boxes, suspects = self.stack[-1]
        mark = _marked(attrs) if attrs and tag not in ("html", "body") else ""
        if tag in ("main", "article"):
            # neither is a suspect but for comments; an unclosed menu or advert doesn't swallow it
            if not mark and not any(self.suspects[b] == "comment" for b in suspects):
                out, suspects = False, ()
            mark = mark if mark in ("comment", "hidden") and tag == "article" else ""
        elif tag == "form" and not mark:
            mark = "other"
        if tag == "header" and not any(x[0] in ("article", "main") for x in self.stack) or tag in SKIP and tag != "form" or mark == "hidden":
            out = True
        elif mark and tag not in BLOCK:
            out = True  # a few marked words within a line
        if tag in BLOCK:
            if mark and not out:
                self.suspects[len(self.names)] = mark
                suspects = (*suspects, len(self.names))
            boxes = (*boxes, len(self.names))
            self.names.append(tag)
        self.stack.append((tag, out, boxes, suspects))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.leave({tag}, BLOCK)

    def handle_endtag(self, tag: str) -> None:
        self.tags += tag not in FORMATTING
        if tag in BLOCK:
            self.cut()
        if tag not in VOID:
            self.leave({tag}, frozenset() if tag in BLOCK else BLOCK)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.parts.append(data)

    def wrappers(self) -> set[int]:
        """The suspects that wrap the article: judged from the largest to the smallest, each against the text outside all others."""
        sizes: dict[int, int] = {}
        groups: dict[tuple[int, ...], int] = {}
        prose: set[int] = set()
        for (text, _, boxes), inside in zip(self.lines, self.inside):
            groups[inside] = groups.get(inside, 0) + len(text)
            for box in inside:
                sizes[box] = sizes.get(box, 0) + len(text)
            if inside and not PROSE.isdisjoint(self.names[b] for b in boxes):
                prose.update(inside)
        outer = {inside[k]: inside[:k] for inside in groups for k in range(len(inside))}
        kept: set[int] = set()
        outside = groups.get((), 0)
        for box in sorted(sizes, key=lambda b: (-sizes[b], b)):
            least = WRAPS[self.suspects[box]] * outside
            if box in prose and kept.issuperset(outer[box]) and sizes[box] > least and (outside or sizes[box] >= LEAST_WRAPPED):
                kept.add(box)
                outside = sum(n for inside, n in groups.items() if kept.issuperset(inside))
        return kept

    def left(self) -> list[tuple[str, int, tuple[int, ...]]]:
        """The lines that no suspect but a wrapper holds."""
        kept = self.wrappers() if self.suspects else set()
        out, tags = [], 0
        for (text, n, boxes), inside in zip(self.lines, self.inside):
            tags += n
            if kept.issuperset(inside):
                out.append((text, tags, boxes))
                tags = 0
        return out


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios smoothed with a Gaussian of ``sigma`` lines; the ends use what there is."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach:reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """Half way between the centres of two clusters (two-means on the line, from its ends)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        up = values > cut
        if not up.any() or up.all():
            return cut
        now = float(values[~up].mean()), float(values[up].mean())
        if now == (low, high):
            return cut
        low, high = now
    return (low + high) / 2


def extract(html: str | None, sigma: float = 1.0, share: float = 0.6) -> str:
    """The main text of one page; article and main elements are the region from ``share`` of the content lines' text on."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.stack.append(p.stack[-1])
    p.cut()
    lines = p.left()
    if not lines:
        return ""
    sizes = np.array([len(t) for t, _, _ in lines], float)
    ratios = smoothed(sizes / np.maximum(1, [n for _, n, _ in lines]), sigma)
    content = ratios >= threshold(ratios)
    held = [boxes for (_, _, boxes), kept in zip(lines, content) if kept]
    # an element's id is smaller than those of the elements in it, so the first article or main of a line is its outermost
    outermost = [next((box for box in boxes if p.names[box] in ("article", "main")), None) for boxes in held]
    named = {box for box in outermost if box is not None}
    if sum(size for size, box in zip(sizes[content], outermost) if box is not None) >= share * sizes[content].sum():
        return "\n".join(t for (t, _, boxes), kept in zip(lines, content) if kept or named.intersection(boxes))
    common = set(held[0]).intersection(*held)
    region = max((box for box in common if p.names[box] not in INNER), default=None)
    return "\n".join(t for t, _, boxes in lines if region is None or region in boxes)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = pd.Series([extract(x) for x in b["html"]], index=b.index, dtype=object)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": text.map(len).astype("int64")})

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
