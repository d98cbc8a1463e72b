"""Main text of web pages by line-block distribution.

Markup is stripped into a sequence of lines, one per block element.  A line weighs as many characters as its text
has outside links, and nothing if half of it is links; lines in regions that are boilerplate by element or class weigh
nothing.  Lines inside an ``article`` or ``main`` element weigh several times as much.  The weights are summed over
sliding windows of lines that don't reach over the edge of such an element; text is kept from each point where the sum
surges over a threshold to the point where it dives to zero, lines made of links between them too.

A null page counts as empty; an empty page has the empty text.  Truncated markup ends at the end of the page; a tag
without its end is dropped.  Nothing is cut off long pages, and open elements are counted by name, so that end tags
without a start cost nothing however deep the nesting is.  Rows that repeat are extracted alike, null ids stay null,
only the named columns are read, whatever others are called, and an empty table gives no rows.  There are no ties: at
each line the windows of its region alone decide.
"""

from __future__ import annotations

import collections
import html
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.shared import clash_free, small

#: Lines in a window, the weight at which text surges, and how many times as much a line inside an article weighs.
WINDOW, SURGE, INSIDE = 3, 86, 8

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video head title select noframes xmp".split())
DROPPED = frozenset("nav header footer aside form menu dialog button".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_MARK = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Words of class names, ids and roles that mark boilerplate, and whole names that do.
_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|comments?|commentlist|disqus|replies|related|recommend\w*|share|sharing|social|widget|login|signin|signup|search|toolbar|pagination|pager|complementary|contentinfo|alert)(?=$|[\s_-])",
    re.I,
)
_NAMES = frozenset(("header", "site-header", "page-header", "masthead", "topbar", "top-bar", "side", "reply"))
_SPACES = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    weight: int
    dropped: bool
    inside: bool  # of an article or main element


def _is_marked(attributes: str) -> bool:
    for m in _MARK.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        if _WORD.search(value) or not _NAMES.isdisjoint(value.lower().split()):
            return True
    return False


def lines_of(page: str, dropped: frozenset[str] = DROPPED) -> list[Line]:
    """Blocks in page order, those without text too."""
    lines: list[Line] = []
    #: Open elements: name, cause of being dropped ('' if it isn't), depth of article or main, whether in a link.
    stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]
    opened: collections.Counter[str] = collections.Counter()  # of the stack, by name
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
        _, cause, depth, _ = stack[-1]
        solid = len(text) - text.count(" ")
        lines.append(Line(text, 0 if cause or 2 * linked >= solid else len(text) - linked, bool(cause), depth > 0))
        parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        data = page[at : m.start()] if m else page[at:]
        if data:
            parts.append(data)
            if stack[-1][3]:
                linked += len(_SPACES.sub("", data))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if opened[name]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                if any(x[0] in BLOCKS for x in stack[depth:]):
                    flush()
                opened.subtract(x[0] for x in stack[depth:])
                del stack[depth:]
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in BLOCKS:
            flush()
            if stack[-1][0] == "p":  # a new block ends an open paragraph
                stack.pop()
                opened["p"] -= 1
        elif name == "br":
            parts.append(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        _, cause, depth, link = stack[-1]
        if not cause and name in dropped and not (name == "header" and depth) or not cause and name not in ("body", "html", "main") and _is_marked(attributes):
            cause = name
        elif cause == "form" and name in ("article", "main"):
            cause = ""
        opened[name] += 1
        stack.append((name, cause, depth + (name in ("article", "main") and not cause), link or name == "a"))
    flush()
    return lines


def main_text(page: str) -> str:
    """The kept text; if that is none, the page is read again as one whose form is a frame around all of it."""
    return _between(lines_of(page)) or (_between(lines_of(page, DROPPED - {"form"})) if "<form" in page.lower() else "")


def _between(lines: list[Line]) -> str:
    regions = [list(region) for _, region in itertools.groupby((x for x in lines if x.text), key=lambda x: x.inside)]
    weights = [[x.weight * (INSIDE if x.inside else 1) for x in region] for region in regions]
    sums = [[sum(weight[k : k + WINDOW]) for k in range(len(weight))] for weight in weights]
    surge = min(SURGE, max((s for ahead in sums for s in ahead), default=0) / 2)
    kept: list[str] = []
    for region, weight, aheads in zip(regions, weights, sums, strict=True):
        running = False
        for line, own, ahead in zip(region, weight, aheads, strict=True):
            if not running and own and ahead >= surge:
                running = True
            elif running and not ahead:
                running = False
            if running and not line.dropped:
                kept.append(line.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_column``, the ``keep`` columns, ``text`` and ``n_chars`` of every page."""

    last = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, last):
            texts = [main_text(x or "") for x in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    wanted = clash_free(pages, [id_column, *keep, html_column])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema[:-1])
    return wanted.mapInArrow(run, f"{fields}, text string, n_chars bigint")
