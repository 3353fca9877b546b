"""Main text of web pages (operator 4).

The page is fed in pieces to the standard library's streaming parser. Its events make lines:
one per text block, with the block's characters, its tags and the characters inside links.
A line's text-to-tag ratio counts its characters outside links. Elements that are no content by
HTML itself (nav, aside, footer, script, hidden ones, ...) are closed: their lines count nothing.
Ratios are smoothed by a Gaussian, and lines above a threshold (a share of the deviation of
the smoothed ratios) form the content clusters.

Names are a prior that clusters overrule. A class, id or role names a part of a page (menu, advert,
notice, comments, form, ...) only if the whole name or its head noun does: `share-buttons`, not
`share-prices`. A container so named is left out if its lines are cold or the lesser share of the
page's clustered text, or if an article or main element elsewhere has text; readers' comments, which
may outgrow an article, unless no clustered text but headings stands outside named parts. Else the
name counts for nothing.

Clusters choose the region. A container is worth the characters of its clustered lines less
those of its other open lines; the region is the container worth most, widened to the article
around it or to ancestors that add next to nothing. So an article element is the region only
if its text is the page's content; a page with several articles, or with a story around a
small article, gets the container of them all. From the region come all clustered lines and,
since short lines belong to an article too, the other open ones; where the region is the
whole page, these only from containers that hold clustered lines, and no lists of links.
Headings right before the region belong to it. If no container is worth anything, the clustered
lines alone are the text.

Work and memory are linear in the page: open elements are found by tag, containers are summed
up once from the last to the first.

Defined results: null html is empty, and pages without content text give an empty text;
tags that are never closed end with their parent; a comment or tag that is cut off by the
page's end is no text; the text of unknown elements counts as
content; repeated rows are all returned; an empty input gives an empty result; only page_id,
url and html are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty

# Element names, and the words of class, id and role that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button canvas dialog footer head iframe input menu nav noscript object option script select style svg template textarea title".split())
MARKED = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup popover promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Of these, the words that mark even an article element.
NO_ARTICLE = frozenset("advert advertisement comment comments promo promoted recommended related replies reply respond sponsor sponsored teaser".split())
READERS = frozenset("comment comments disqus replies reply respond".split())
# Words behind the noun that say no more than that it is a box, where it stands, or what it lists.
GENERIC = frozenset("area articles bar block body bottom box button buttons column container content desktop first for form global group holder icons inner item items last left link links list main media mobile module networks outer panel post posts primary right row secondary section site slot stories text top trail tray unit wrap wrapper you zone".split())
# Names such as has-sidebar or without-ads tell of a container that holds or lacks such a part.
HOLDS = frozenset("has is no with without".split())
HEADINGS = frozenset(("header", "masthead", "topbar"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A comment, declaration or tag that the page does not end goes on to the page's end.
_UNENDED = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PIECE = 1 << 16
#: What a name says of a container: nothing, a part of the page, readers' comments.
PLAIN, PART, COMMENTS = range(3)


def head_noun(name: str) -> str:
    """The noun that a class or id ends with, generic words and numbers behind it left out; "" if it has none."""
    words = [w.lower() for w in _WORD.findall(name)]
    if words and words[0] in HOLDS:
        return ""
    while words and (words[-1] in GENERIC or words[-1].isdigit()):
        words.pop()
    return words[-1] if words else ""


class Open(NamedTuple):
    """An open element; `block` and `solid` are the stack places of the nearest block and nearest
    block other than p at or below it, -1 if there is none."""

    tag: str
    number: int
    closed: bool
    block: int
    solid: int
    #: Whether the nearest block is closed.
    shut: bool
    #: What the names of inline elements around say, inside the nearest block.
    named: int


_GROUND = Open("", 0, False, -1, -1, False, PLAIN)
#: Open elements that a start tag ends, and those that protect them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ("body",)),
}


class Lines(HTMLParser):
    """Events to lines: (text, tags, link characters, closed, number of the container)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        #: Places of the open elements of each tag.
        self.at: dict[str, list[int]] = defaultdict(list)
        self.kind, self.parent, self.named = ["page"], [0], [PLAIN]
        self.lines: list[tuple[str, int, int, bool, int]] = []
        #: Text, and what the names of inline elements around it say.
        self.parts: list[tuple[str, int]] = []
        self.tags = self.linked = 0

    def _top(self) -> Open:
        return self.open[-1] if self.open else _GROUND

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def _cut(self, place: int) -> None:
        """Close the elements from `place` on."""
        for element in self.open[place:]:
            self.at[element.tag].pop()
        del self.open[place:]

    def _container(self, kind: str, parent: int, named: int) -> int:
        self.kind.append(kind)
        self.parent.append(parent)
        self.named.append(named)
        return len(self.kind) - 1

    def _flush(self) -> None:
        text = " ".join("".join(d for d, _ in self.parts).split())
        if text:
            top = self._top()
            number, named = self.open[top.block].number if top.block >= 0 else 0, max(n for _, n in self.parts)
            if named:  # named inline text leaves its line, or makes it a container if it is most of it
                plain = " ".join("".join(d for d, n in self.parts if not n).split())
                if 2 * len(plain) >= len(text):
                    text = plain
                else:
                    number = self._container("span", number, named)
            self.lines.append((text, self.tags, min(self.linked, len(text)), top.closed, number))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _closes(self, tag: str, attributes: dict) -> bool:
        if tag in DROPPED or tag == "header" and not (self.at["article"] or self.at["main"]):
            return True
        return "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true" or "display:none" in (attributes.get("style") or "").replace(" ", "").lower()

    def _names(self, tag: str, attributes: dict) -> int:
        """What the names of an element say of it."""
        if tag in ("html", "body", "main"):
            return PLAIN
        nouns = {head_noun(name) for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split()}
        if tag == "article":
            nouns &= NO_ARTICLE
        if nouns & READERS:
            return COMMENTS
        inside = bool(self.at["article"] or self.at["main"])
        role = (attributes.get("role") or "").lower() in ROLES and tag != "article"
        return PART if tag == "form" or role or nouns & MARKED or not inside and nouns & HEADINGS else PLAIN

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._flush()
            self._imply(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append(("\n", PLAIN))
            return
        if tag == "a" and self.at["a"] and self.at["a"][-1] > self._top().block:
            self._cut(self.at["a"][-1])  # links do not nest
        top, attributes = self._top(), dict(attrs)
        closed, says = top.closed or self._closes(tag, attributes), self._names(tag, attributes)
        place, number, block, solid, shut, named = len(self.open), top.number, top.block, top.solid, top.shut, max(top.named, says)
        if tag in BLOCK or says:
            number = self._container(tag if tag in BLOCK else "span", number, says)
        if tag in BLOCK:
            block, shut, named = place, closed, PLAIN
            solid = solid if tag == "p" else place
        self.at[tag].append(place)
        self.open.append(Open(tag, number, closed, block, solid, shut, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, where the slash has no meaning

    def _imply(self, tag: str) -> None:
        """Ends that HTML lets an author leave out."""
        paragraph = self._last(("p",))
        if paragraph > self._top().solid:
            self._cut(paragraph)
        ends, guards = _ENDS.get(tag, ((), ()))
        place = self._last(ends)
        if place > self._last(guards):
            # the lowest of the ended kinds above the guard: a cell goes with its row
            guard = self._last(guards)
            self._cut(min(self.at[t][-1] for t in ends if self.at[t] and self.at[t][-1] > guard))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCK:
            self._flush()
        place, block = self._last((tag,)), self._top().block
        if place < 0 or tag not in BLOCK and place < block:
            return  # an inline end does not close blocks
        if block >= place:
            self._flush()
        self._cut(place)

    def handle_data(self, data: str) -> None:
        top = self._top()
        if top.tag in ("script", "style"):
            return
        # closed inline elements (buttons, hidden spans) do not close the block around them
        if top.closed and not top.shut and top.tag not in BLOCK:
            return
        self.parts.append((data, top.named))
        if self.at["a"]:
            self.linked += len(data.strip())

    def done(self) -> list[tuple[str, int, int, bool, int]]:
        if _UNENDED.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = max(1, round(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    sums, weights = np.convolve(ratios, kernel)[reach:-reach], np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return sums / weights


def clusters(lines: list, sigma: float = 1.0, share: float = 0.5) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio is above the threshold."""
    ratios = np.array([0.0 if closed else (len(text) - linked) / max(1, tags) for text, tags, linked, closed, _ in lines])
    if not ratios.any():  # all open text is links: then it counts
        ratios = np.array([0.0 if closed else len(text) / max(1, tags) for text, tags, _, closed, _ in lines])
    smooth = smoothed(ratios, sigma)
    return (smooth > share * smooth.std()) & (ratios > 0)


def _summed(parent: list[int], values: list) -> list:
    """The values of each container with all inside it; parents have lower numbers."""
    for i in range(len(values) - 1, 0, -1):
        values[parent[i]] += values[i]
    return values


def without_parts(parser: Lines, lines: list) -> list:
    """The lines with those of the page's parts closed, as far as the clusters let names say so."""
    kind, parent, named, n = parser.kind, parser.parent, parser.named, len(parser.kind)
    if not any(named):
        return lines
    hot, own, content = clusters(lines).tolist(), [0] * n, [0] * n
    around = [-1] * n  # the innermost article or main element
    for i in range(n):
        around[i] = i if kind[i] in ("article", "main") and not named[i] else around[parent[i]] if i else -1
    suspect = list(named)  # containers inside named ones
    for i in range(1, n):
        suspect[i] = max(named[i], suspect[parent[i]])
    for (text, _, _, closed, number), inside in zip(lines, hot, strict=True):
        own[number] += len(text) if inside else 0
        content[number] += around[number] >= 0 and not closed and not suspect[number]
    total, elsewhere = sum(own), sum(content)
    story = any(own[i] and not suspect[i] and kind[i] not in _HEADINGS for i in range(n))
    own, content = _summed(parent, own), _summed(parent, content)
    out = [False] * n
    for i in range(1, n):
        share = not story if named[i] == COMMENTS else 2 * own[i] > total
        void = own[i] > 0 and share and elsewhere == (content[around[i]] if around[i] >= 0 else 0)
        out[i] = out[parent[i]] or bool(named[i]) and not void
    return [(text, tags, linked, closed or out[number], number) for text, tags, linked, closed, number in lines]


#: Containers that are parts of a text rather than regions of a page.
_PARTS = frozenset("blockquote caption center dd dl dt figcaption h1 h2 h3 h4 h5 h6 hgroup li menu ol p pre span table tbody td tfoot th thead tr ul".split())
_WHOLE = frozenset(("page", "html", "body"))
#: Shares of the best worth that an article, or another ancestor, has to have to become the region.
ARTICLE_SHARE, WIDER_SHARE = 0.5, 0.9


def main_blocks(html: str | None) -> list[str]:
    parser = Lines()
    for at in range(0, len(html or ""), _PIECE):
        parser.feed(html[at : at + _PIECE])
    lines = parser.done()
    if lines:
        lines = without_parts(parser, lines)
    if all(closed for _, _, _, closed, _ in lines):
        return []
    hot = clusters(lines)
    if not hot.any():
        return []
    kind, parent, n = parser.kind, parser.parent, len(parser.kind)
    worth, warm, last = [0] * n, [False] * n, list(range(n))  # characters, whether it holds clustered lines, last container inside
    for (text, _, _, closed, number), inside in zip(lines, hot.tolist(), strict=True):
        worth[number] += len(text) if inside else 0 if closed else -len(text)
        warm[number] |= inside
    direct = [warm[i] for i in range(n)]
    for i in range(n - 1, 0, -1):  # parents have lower numbers
        up = parent[i]
        worth[up] += worth[i]
        warm[up] |= warm[i]
        last[up] = max(last[up], last[i])
        direct[up] |= direct[i] and kind[i] in _PARTS
    region = max((i for i in range(n) if kind[i] not in _PARTS and warm[i]), key=lambda i: (worth[i], i))
    best, at = worth[region], region
    if best <= 0:
        return [line[0] for line, inside in zip(lines, hot.tolist(), strict=True) if inside]
    linked = lambda line: 2 * line[2] >= len(line[0])
    idle = [0] * n  # open lists of links
    for line in lines:
        idle[line[4]] += not line[3] and linked(line)
    for i in range(n - 1, 0, -1):
        idle[parent[i]] += idle[i]
    while kind[at := parent[at]] not in _WHOLE:
        if kind[at] == "article" and worth[at] >= ARTICLE_SHARE * best or worth[at] >= WIDER_SHARE * best and idle[at] == idle[region]:
            region = at
    named = [False] * n  # whether an article or main element is around
    for i in range(1, n):
        named[i] = named[parent[i]] or kind[i] in ("article", "main")
    home = list(range(n))  # the region-like container that a part of a text belongs to
    for i in range(1, n):
        if kind[i] in _PARTS:
            home[i] = home[parent[i]]

    def belongs(line: tuple, inside: bool) -> bool:
        text, _, _, closed, number = line
        if inside or closed:
            return inside
        if named[number]:
            return True
        return not linked(line) and (kind[region] not in _WHOLE or direct[home[number]])

    chosen = [i for i, line in enumerate(lines) if region <= line[4] <= last[region] and belongs(line, bool(hot[i]))]
    first = chosen[0]
    while first and kind[lines[first - 1][4]] in ("h1", "h2", "h3") and not lines[first - 1][3] and not linked(lines[first - 1]):
        first -= 1  # headings right before the region are its own
    return [lines[i][0] for i in [*range(first, chosen[0]), *chosen]]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""

    def make():
        def apply(pages: list, columns: dict) -> dict:
            texts = [main_text(p) for p in pages]
            return {"id": columns["id"], "url": columns["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    rows = pages.select(text_or_empty(html_col).alias("html"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return map_texts(rows, make, "id long, url string, text string, n_chars long", rows=64).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op4_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
