"""Main text of HTML by the distribution of text over lines.

Markup is stripped to lines, one a block; elements that cannot hold the article (menus, forms, notices and the like) leave
empty lines: by their name, or by a class, id or role one of whose words is a mark (``sidebar``, ``cookie-notice``, ``ad_slot``;
not ``has-sidebar`` or ``job-search-guide``). Text lengths are summed over windows of consecutive lines: where the sum rises above a threshold
is a surge, where it falls to zero a dive, and the text between them is a stretch. The lines of every page are searched
alike. Text in an article or main element counts as a surge however short it is, and the element's edges are
dives, so that short lines beside it aren't taken along; what lies outside is kept where it surges by itself. An
excluded element is no dive where the text on both sides of it has a container in common (an element below body that holds
both sides and the excluded one, or the nearest block of both other than a paragraph or list). All stretches are kept.
Marks are evidence only: if they leave nothing of a page, it is searched again without them.

Defined results: null HTML is empty and gives an empty text; unclosed elements end with their parents; an unclosed script,
style or comment runs to the end. Line breaks within a block are white space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, long_texts

WINDOW = 3
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+>""")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.I)
_UNSEEN = re.compile(r"""aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_TURN = re.compile(r"([a-z])([A-Z])")
_PART = re.compile(r"[a-z]+|[0-9]+")
#: Elements whose content isn't shown as text.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select head".split())
#: Elements that hold no article text.
ASIDE = frozenset("nav footer aside form menu dialog button fieldset datalist".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Words of class, id or role names that tell an element from the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments "
    "disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "widget toolbar masthead topbar search form pagination pager complementary contentinfo hidden".split()
)
#: Blocks that hold one paragraph, item or cell of a container's text.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd figure figcaption table tbody thead tfoot tr td th address details summary center".split())
#: Words for a box, which say nothing of what is in it; and words that turn what follows into a mere property.
BOXES = frozenset("area bar block box center container content group holder inner item items left line link links list main outer panel right row section slot space text title top unit wrap wrapper zone".split())
PROPERTIES = frozenset("has have is no non not with without hide show can open close closed toggle".split())
_CLOSES_P = frozenset("p div ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 section article aside nav footer header form pre blockquote hr figure main address details fieldset".split())
_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def mark(word: str) -> bool:
    """Whether one word of a class, id or role names something beside the article: its last part that isn't a box does, and no part makes it a property."""
    parts = _PART.findall(_TURN.sub(r"\1 \2", word).lower())
    if not PROPERTIES.isdisjoint(parts):
        return False
    named = [x for x in parts if x not in BOXES and not x.isdigit()]
    return bool(named) and (named[-1] in MARKS if named[-1] != "hidden" else len(parts) == 1)


def _marked(attributes: str) -> bool:
    if not attributes:
        return False
    if _UNSEEN.search(attributes) or _HIDDEN.search(_QUOTED.sub("=", attributes)):
        return True
    return any(mark(word) for m in _NAMES.finditer(attributes) if m.start() == 0 or attributes[m.start() - 1].isspace() for word in m[1].strip("\"'").split())


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of tags; comments and the like have an empty name. Each character is looked at a bounded number of times."""
    at, end, tries = 0, len(page), 8 * len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            close = "-->" if page[start + 2] == "-" else "]]>"
            stop = page.find(close, start + (4 if page[start + 2] == "-" else 9))
            at = end if stop < 0 else stop + 3
            at = yield start, at, False, "", ""
            continue
        m = _NAME.match(page, start + 1)
        if m is None and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        stop = page.find(">", start)
        if stop < 0:
            return  # no tag can end any more
        if m is None:
            at = yield start, stop + 1, False, "", ""
            continue
        if tries > 0 and ('"' in page[m.end() : stop] or "'" in page[m.end() : stop]):  # a quoted value may hold the sign
            if whole := _ATTRIBUTES.match(page, m.end()):
                stop = whole.end() - 1
            else:
                tries -= end - start  # a quote that is never closed
        at = yield start, stop + 1, bool(m[1]), m[2].lower(), page[m.end() : stop]


class _Open:
    """The elements that are open at a place of a page."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, int, int]] = []  # name, excluded, in an article, number, number of the innermost container
        self.places: dict[str, list[int]] = {}  # of each name, where it stands in the stack
        self.blocks: list[int] = []  # where blocks stand in the stack
        self.numbers: set[int] = set()  # of open blocks

    def push(self, name: str, excluded: bool, main: bool, number: int) -> None:
        held = self.stack[-1][4] if self.stack else 0
        if name not in INLINE:
            self.blocks.append(len(self.stack))
            self.numbers.add(number)
            if name not in PARAGRAPHS:
                held = 0 if name in ("html", "body") else number
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, excluded, main, number, held))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, _, _, number, _ = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
                self.numbers.discard(number)

    def state(self) -> tuple[bool, bool]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)

    def container(self) -> int:
        """Number of the innermost block that isn't a paragraph, 0 if that is the body."""
        return self.stack[-1][4] if self.stack else 0


def lines_of(page: str, marks: bool = True) -> tuple[list[str], list[bool]]:
    """(lines, whether each is in an article or main element). Edges of an article, and excluded elements whose sides share no container, become WINDOW empty lines."""
    lines: list[str] = []
    inside: list[bool] = []
    held: list[str] = []
    opened = _Open()
    count = 0
    apart: list[int] = []  # for each excluded element since the last line the number of the block around it, 0 if that is the body
    last = (0, 0)  # of the last line: the count of elements begun before it, and its container
    out, main, at, end = False, False, 0, len(page)

    def flush() -> None:
        nonlocal last
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            if inside and (inside[-1] != main or apart and not together()):
                lines.extend([""] * WINDOW)
                inside.extend([main] * WINDOW)
            lines.append(text)
            inside.append(main)
            apart.clear()
            last = count, opened.container()

    def together() -> bool:
        """Whether the last line and this place share a container, or the block around whatever was left out between them."""
        return last[1] == opened.container() or all(n and n <= last[0] and n in opened.numbers for n in apart)

    def leave_out() -> None:
        held.append(" ")
        name, _, _, number, _ = opened.stack[opened.blocks[-1]] if opened.blocks else ("body", False, False, 0, 0)
        apart.append(0 if name in ("html", "body") else number)

    found = tokens(page)
    token = next(found, None)
    while token is not None:
        start, stop, closing, name, attributes = token
        if not out and start > at:
            held.append(page[at:start])
        at = stop
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = _closing(name).search(page, at)
                at = end if close is None else close.start() if close[0].lower() == "<body" else close.end()
            if not out:
                held.append(" ")
        elif name in VOID:
            if not out and name != "wbr":
                held.append(" ")
        elif closing:
            if places := opened.places.get(name):
                depth = places[-1]
                if name not in INLINE and not out:
                    flush()
                if name not in INLINE or not opened.blocks or opened.blocks[-1] < depth:  # else it was closed with its block
                    opened.cut(depth)
                    out, main = opened.state()
        elif name in INLINE:
            count += 1
            if marks and attributes and not out and _marked(attributes):
                opened.push(name, True, main, count)
                out = True
            elif out or not attributes.endswith("/"):
                opened.push(name, out, main, count)
        elif name:
            if not out:
                flush()
            count += 1
            if (name in _CLOSES_P or name in _SAME) and opened.blocks:
                depth = opened.blocks[-1]
                around = opened.stack[depth][0]
                if around in _SAME.get(name, ()) or around == "p" and name in _CLOSES_P:
                    opened.cut(depth)
                    out, main = opened.state()
            excluded = out or name in ASIDE or name == "header" and not main or marks and name not in ("body", "html", "main") and _marked(attributes)
            if excluded and not out:
                leave_out()
            out = excluded
            main = main or name in ("article", "main") and not excluded
            opened.push(name, out, main, count)
        try:
            token = found.send(at)
        except StopIteration:
            break
    if not out:
        held.append(page[at:])
        flush()
    return lines, inside


@lru_cache(32)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>" if name != "head" else r"</head\s*>|<body", re.I)


def stretches(lengths: np.ndarray, surge: int, sure: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ranges of lines between surge and dive points of the window sums. sure: lines that are surges if they have any text."""
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of a line and the next ones
    out, start, k = [], None, 0
    while k < len(lengths):
        if start is None and lengths[k] and (sums[k] >= surge or sure is not None and sure[k]):
            start = k
        elif start is not None and not lengths[k : k + WINDOW].any():
            out.append((start, k))
            start = None
        k += 1
    return out if start is None else [*out, (start, len(lengths))]


def main_text(page: str | None, surge: int = 60) -> str:
    """Blocks of the main text, joined by two line feeds."""
    if not page:
        return ""
    lines, inside = lines_of(page)
    if not lines:
        lines, inside = lines_of(page, marks=False)
    lengths = np.array([len(x) for x in lines], np.int64)
    sure = np.array(inside, bool)
    found = stretches(lengths, surge, sure) or stretches(lengths, 1)
    return "\n\n".join(lines[k] for a, b in found for k in range(a, b) if lengths[k])


def extract(pages: DataFrame, page: str) -> DataFrame:
    """Adds ``main_text`` (a clashing name gets a leading underscore). No shuffle."""
    long_texts(pages.sparkSession)
    (name,) = fresh(pages, "main_text")

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([main_text(t) for t in texts], dtype="object")

    return pages.withColumn(name, extracted(col(page)))
