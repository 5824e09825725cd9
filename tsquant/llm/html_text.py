"""Main text of HTML pages from parser events and text-to-tag ratios.

The standard library's parser streams its events; a page becomes a sequence of
lines, one for each block of text, with the number of tags met in it and the region
(article, main part, or container) that holds it. The ratio of characters to tags of
every line is smoothed with a Gaussian over its neighbours, and a threshold between
the means of two clusters of ratios tells dense lines from sparse ones. An article or
main part that holds dense lines is content, with its short lines too; pages that mark
none keep the stretch from the first to the last dense line of each container, with the
headings right before it. Scripts, styles and the elements of menus, headers, footers and
sidebars never become lines. What only a name, a role or a form says to be beside the
article is doubted: its lines count for nothing, unless nearly all dense lines of the
page are in it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tsquant.llm.arrow import map_batches, refuse_repeats, text_slices

SIGMA = 1.0
#: Characters handed to the parser at a time.
FEED = 1 << 16

# Element names of HTML by what they do to the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head script style noscript template title iframe object svg math canvas audio video select textarea button "
    "nav header footer aside dialog menu datalist".split()
)
DOUBTED = frozenset(("form",))
DOUBTED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
# Names of parts beside the article, as words of class and id attributes.
DOUBTED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social "
    "header masthead footer copyright login signup form search pagination pager hidden".split()
)
# In a name, what follows these is only mentioned.
REMARKS = frozenset("no not non without with has have".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond replies disqus discussion reviews".split())
REGIONS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("body div section td blockquote".split())
# A start tag closes an open element of these kinds that is not inside one of the others.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
NAME = re.compile(r"[a-z]+")
INNERMOST = frozenset(("td", "th", "table", "caption", "button", "object", "template", "html"))

#: Dense lines that an element must hold to be no mere part beside the article, and the
#: percentage of its dense text that may stand elsewhere.
DENSE_LINES, ELSEWHERE = 2, 10

Region = tuple[str, int]


class _Part(NamedTuple):
    """An open element: whether its text is never content, where it stands, and which doubted elements hold it."""

    tag: str
    hidden: bool
    region: Region
    doubts: tuple[int, ...]


class _Line(NamedTuple):
    """A block of text: its pieces, each with the doubted elements around it, its tags, its region, whether it is a heading."""

    pieces: list[tuple[str, tuple[int, ...]]]
    tags: int
    region: Region
    heading: bool

    def text(self, trusted: set[int] | None = None) -> str:
        """What stands in no doubted element but trusted ones; None trusts all."""
        return " ".join("".join(t for t, doubts in self.pieces if trusted is None or trusted.issuperset(doubts)).split())


class _Lines(HTMLParser):
    """Collects the lines of a page that may be content, and the elements to be doubted.

    `doubted` has for each such element whether it is for comments, and its region;
    `around` those that hold an article.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[_Part] = []
        self.pieces: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 0
        self.regions = 0
        self.doubted: list[tuple[bool, Region]] = []
        self.around: set[int] = set()

    @property
    def top(self) -> _Part:
        return self.stack[-1] if self.stack else _Part("", False, ("page", 0), ())

    def flush(self) -> None:
        if self.pieces:
            line = _Line(self.pieces, self.tags, self.top.region, self.top.tag in HEADINGS)
            self.pieces = []
            if line.text():
                self.lines.append(line)
        self.tags = 0

    def close_to(self, at: int) -> None:
        self.flush()
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.handle_data(" ")
            return
        if tag in BLOCKS:
            self.flush()
            self.tags = 1
            self.close_implied(tag)
        if tag in REGIONS:
            self.leave_open_parts()
        hidden, region, doubts = self.top.hidden, self.top.region, self.top.doubts
        hidden = hidden or tag in HIDDEN and not (tag == "header" and region[0] in REGIONS)
        comment = None if hidden else self.doubt(tag, attrs)
        if comment is not None:
            doubts = (*doubts, len(self.doubted))
            self.doubted.append((comment, region))
        if tag in REGIONS:
            self.regions += 1
            region = (tag, self.regions)
        elif tag in CONTAINERS and region[0] not in REGIONS:
            self.regions += 1
            region = ("container", self.regions)
        self.stack.append(_Part(tag, hidden, region, doubts))

    def doubt(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """Whether an element is to be doubted: True for comments, False as a part beside the article."""
        beside = False if tag in DOUBTED else None
        for name, value in attrs:
            if name in ("class", "id") and tag not in ("html", "body"):
                value = (value or "").lower()
                if COMMENT_NAMES.intersection(NAME.findall(value)):
                    return True
                if tag not in REGIONS and any(map(self.names_beside, value.split())):
                    beside = False
            elif name == "role" and (value or "").lower() in DOUBTED_ROLES or name == "hidden":
                beside = False
        return beside

    def names_beside(self, token: str) -> bool:
        """Whether one class or id names a part beside the article, and not the article's headline or a layout."""
        words = NAME.findall(token)
        remark = next((at for at, word in enumerate(words) if word in REMARKS), len(words))
        hidden = DOUBTED_NAMES.intersection(words[:remark])
        if words and words[-1] in ("result", "results"):
            hidden -= {"search"}
        return bool(hidden - {"header"} if self.top.region[0] in REGIONS else hidden)

    def close_implied(self, tag: str) -> None:
        """Elements whose end tag may be left out end where the next one starts."""
        for at in range(len(self.stack) - 1, -1, -1):  # any block ends a paragraph
            name = self.stack[at].tag
            if name == "p":
                self.close_to(at)
                break
            if name in BLOCKS or name in INNERMOST:
                break
        closes, within = CLOSES.get(tag, ((), ()))
        for at in range(len(self.stack) - 1, -1, -1) if closes else ():
            name = self.stack[at].tag
            if name in closes:
                self.close_to(at)
                break
            if name in within:
                break

    def leave_open_parts(self) -> None:
        """An article does not stand inside a menu: that was left open. A doubted element
        around an article is one by name only, unless it is for comments."""
        if any(self.doubted[d][0] for d in self.top.doubts):
            return
        self.around.update(self.top.doubts)
        for at, part in enumerate(self.stack):
            if part.hidden:
                self.close_to(at)
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            part = self.stack[at]
            if part.tag == tag:
                if tag in BLOCKS or part.hidden:
                    self.close_to(at)
                else:
                    del self.stack[at:]
                return
            if part.tag in REGIONS and tag not in ("body", "html"):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.top.hidden:
            self.pieces.append((data, self.top.doubts))


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean over neighbours up to three deviations away; the edge repeats."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-reach, reach + 1)]
    total, last = sum(weights), len(values) - 1
    return [
        sum(w * values[min(max(i + k, 0), last)] for k, w in zip(range(-reach, reach + 1), weights)) / total
        for i in range(len(values))
    ]


def threshold(ratios: list[float]) -> float:
    """Middle between the means of two clusters; none if the means are not twice apart."""
    low, high = min(ratios), max(ratios)
    for _ in range(20):
        middle = (low + high) / 2
        below, above = [r for r in ratios if r < middle], [r for r in ratios if r >= middle]
        means = math.fsum(below) / max(len(below), 1), math.fsum(above) / len(above)
        if not below or means == (low, high):
            break
        low, high = means
    return (low + high) / 2 if high > 2 * low else 0.0


def dense(sizes: list[int], tags: list[int]) -> list[bool]:
    """Lines whose smoothed ratio of text to tags lies in the higher of two clusters."""
    ratios = smooth([size / max(count, 1) for size, count in zip(sizes, tags, strict=True)])
    least = threshold(ratios)
    return [ratio >= least for ratio in ratios]


def trusted_parts(parser: _Lines) -> set[int]:
    """Doubted elements that are part of the article whatever their names say.

    Those around an article are; so are those that hold nearly all dense lines of the
    page, the one that holds most first. Comments are, where the article they stand in
    has no dense line beside them.
    """
    trusted = set(parser.around)
    if len(trusted) == len(parser.doubted):
        return trusted
    lines = [(sorted({d for _, doubts in line.pieces for d in doubts}), len(line.text()), line) for line in parser.lines]
    high = dense([size for _, size, _ in lines], [line.tags for _, _, line in lines])
    lines = [(doubts, size, line.region) for (doubts, size, line), is_dense in zip(lines, high, strict=True) if is_dense]
    inside: dict[int, list[int]] = {}
    for doubts, size, _ in lines:
        for d in doubts:
            inside.setdefault(d, []).append(size)
    for d in sorted(inside, key=lambda d: (-sum(inside[d]), d)):
        comment, region = parser.doubted[d]
        if d in trusted or len(inside[d]) < DENSE_LINES or comment and region[0] not in REGIONS:
            continue
        beside = [size for doubts, size, where in lines if trusted.issuperset(doubts) and (not comment or where == region)]
        if sum(beside) * 100 <= sum(inside[d]) * (0 if comment else ELSEWHERE):
            trusted.add(d)
    return trusted


def main_text(html: str) -> str:
    """Blocks of the main text of a page, in page order, joined by line breaks."""
    parser = _Lines()
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    parser.close()
    parser.flush()
    trusted = trusted_parts(parser)
    lines = [(text, line) for line in parser.lines if (text := line.text(trusted))]
    if not lines:
        return ""
    spans: dict[Region, list[int]] = {}
    for at, is_dense in enumerate(dense([len(text) for text, _ in lines], [line.tags for _, line in lines])):
        if is_dense:
            spans.setdefault(lines[at][1].region, [at, at])[1] = at
    marked = {region for region in spans if region[0] in REGIONS}
    if marked:
        return "\n".join(text for text, line in lines if line.region in marked)
    for region, span in spans.items():
        while span[0] and lines[span[0] - 1][1].heading and lines[span[0] - 1][1].region == region:
            span[0] -= 1
    kept = sorted({at for first, last in spans.values() for at in range(first, last + 1)})
    return "\n".join(lines[at][0] for at in kept)


def extract_text(
    pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)
) -> DataFrame:
    """Main text of every page.

    Returns the id column, the columns of `keep` unchanged, `text` and `n_chars` (its
    code points): one row for each row of `pages`, repeated and null ids included;
    other columns are not read. A null or empty page, and one without text, has the
    empty text and 0 characters.
    """
    refuse_repeats([id_column, *keep, "text", "n_chars"])
    kept = [pages[name].alias(f"k{i}") for i, name in enumerate((id_column, *keep))]
    kinds = [pages.schema[name].dataType.simpleString() for name in (id_column, *keep)]
    names = [f"k{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(page or "") for page in part.column(part.num_columns - 1).to_pylist()]
            out = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*names, "text", "n_chars"])

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", text string, n_chars long"
    rows = map_batches(pages.select(*kept, pages[html_column].alias("html")), run, schema)
    return rows.toDF(id_column, *keep, "text", "n_chars")
