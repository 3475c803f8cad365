"""Main text of web pages by composite text density.

Every element of the page's mended tree gets its characters C, tags T, link characters LC and link tags LT, and a density:
characters per tag, adjusted for links by a logarithm whose base grows with the element's link characters and with the share
of links in the body. An element's density sum adds the densities of its children. The element of the largest sum under the
body holds the main text; the smallest density on its path up to the body is the threshold, and every other element of that
density or more gives its own largest-sum subtree. An element around the chosen one is the article as a whole if it is no
less than half as dense and has nothing but text in it.

Scripts, styles, form controls and what is hidden are no part of the tree. Elements that name themselves menu, footer,
sidebar, notice, advert, form or reader comments (by tag, role, class or id) count for the densities around them, but are not
chosen and are left out of what is chosen. Such a class or id gives way to density: an element that holds the largest sum,
beside which little is left, is a wrapper, whatever it is called. Names decide nothing else: article and main are elements
like others.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = RAW | frozenset("template head button select option input svg object embed canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body head html title td th tr tbody thead tfoot optgroup option".split())
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
SCOPES = ("table", "article", "main", "body")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks that are a part of a text and never the whole of it.
PARTS = HEADINGS | frozenset("p li td th tr thead tbody tfoot ul ol dl dd dt blockquote table pre".split())
#: What names itself as no article: always by tag or role, by class or id unless density says otherwise.
NAMED = frozenset("nav footer aside menu search dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer masthead menu menubar nav navbar navigation newsletter notice notices pagination popup promo promotion respond sidebar sponsor sponsored subscribe".split())
#: These words mark an element only if its text is mostly links.
LINK_MARKS = frozenset("related share sharing social widget widgets".split())
ABOUT_LAYOUT = ("with", "has", "no", "without")
#: A marked element is a wrapper if the largest sum outside of marks is a smaller part than this of the sum within.
WRAPPER = 0.2

_tail = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+>").match
_name = re.compile(r"[A-Za-z][^\s/>]*").match
_attribute = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))").finditer
_hidden = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])", re.I).search
_words = re.compile(r"[a-z]+").findall
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I).search for t in RAW}
NONE, HEADER, LINKS, MARKED, OUT = range(5)


class Node:
    """An element; parts are its children and texts in order, out how it names itself (NONE to OUT)."""

    __slots__ = ("tag", "parent", "parts", "skip", "out", "link", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, out: int = NONE):
        self.tag, self.parent, self.skip, self.out = tag, parent, skip, out
        self.link = tag == "a" or (parent is not None and parent.link)
        self.parts: list[Node | str] = []

    def kids(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str) and not p.skip]


def _read_attributes(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is invisible, and how it names itself."""
    if tag in INVISIBLE:
        return True, NONE
    out = OUT if tag in NAMED else MARKED if tag == "form" else HEADER if tag == "header" else NONE
    if attributes and not attributes.isspace():
        if _hidden(attributes):
            return True, NONE
        for m in _attribute(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
            if name == "aria-hidden" and value == "true":
                return True, NONE
            if name == "role" and value in ROLES:
                out = max(out, MARKED if value == "form" else OUT)
            elif name in ("class", "id") and tag not in ("body", "html", "article", "main"):
                for token in value.split():
                    words = _words(token)
                    if words and words[0] not in ABOUT_LAYOUT:
                        found = MARKED if not MARKS.isdisjoint(words) else LINKS if not LINK_MARKS.isdisjoint(words) else HEADER if "header" in words else NONE
                        out = max(out, found)
    return False, out


class _Open:
    """The open elements, with their places by tag, so that each look-up takes time that does not grow with the depth."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.places[node.tag].append(k)
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(k)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.stack) > place:
            k, node = len(self.stack) - 1, self.stack.pop()
            self.places[node.tag].pop()
            if self.blocks and self.blocks[-1] == k:
                self.blocks.pop()

    def start(self, tag: str) -> None:
        """Closes what a start tag implies the end of."""
        if tag in SIBLINGS:
            closes, stops = (x.split() for x in SIBLINGS[tag])
            stop = self.last(*stops)
            within = [p[bisect_right(p, stop)] for p in (self.places[t] for t in closes) if p and p[-1] > stop]
            if within:
                self.cut(min(within))
        elif tag in CLOSES_P:
            p = self.last("p")
            if p and p > (self.blocks[-1] if self.blocks else 0):
                self.cut(p)

    def end(self, tag: str) -> None:
        place = self.last(tag)
        if place and (tag in BLOCKS or place >= self.last(*SCOPES)):
            self.cut(place)


def parse(page: str) -> Node:
    """A tree of the page, in time linear in its length.

    Unclosed and crossing tags are mended: a block start closes an open paragraph, an end tag closes what it encloses, and a
    stray end tag is passed over. A tag without an end is text; where quotes are not closed, tags end at the next ">".
    """
    root = Node("#root", None)
    open_ = _Open(root)
    at, look, n = 0, 0, len(page)
    quoted = cdata = True

    def text(to: int) -> None:
        if to > at:
            part = page[at:to]
            open_.stack[-1].parts.append(html.unescape(part) if "&" in part else part)

    while True:
        lt = page.find("<", look)
        if lt < 0 or lt + 1 >= n:
            break
        c = page[lt + 1]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            text(lt)
            at = look = end + 3 if end >= 0 else n
            continue
        if c in "!?" or (c == "/" and not page[lt + 2 : lt + 3].isalpha()):
            end = -1
            if cdata and page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt) + 2
                cdata = end > 1
            if end < 2:
                end = page.find(">", lt)
            if end < 0:
                look = lt + 1
                if page.find(">", look) < 0:
                    break
                continue
            text(lt)
            at = look = end + 1
            continue
        name = _name(page, lt + (2 if c == "/" else 1))
        if not name:
            look = lt + 1
            continue
        tail = _tail(page, name.end()) if quoted else None
        if tail:
            end = tail.end()
        else:
            quoted = False
            end = page.find(">", name.end()) + 1
            if not end:
                break
        text(lt)
        at = look = end
        tag = name[0].lower()
        if c == "/":
            open_.end(tag)
            continue
        open_.start(tag)
        attributes = page[name.end() : end - 1]
        skip, out = _read_attributes(tag, attributes)
        new = Node(tag, open_.stack[-1], skip, out)
        open_.stack[-1].parts.append(new)
        if tag not in VOID and not attributes.endswith("/"):
            if tag in RAW:
                close = _raw_end[tag](page, at)
                at = look = close.end() if close else n
            else:
                open_.push(new)
    text(n)
    return root


def measure(root: Node) -> tuple[list[Node], Node]:
    """Fills in counts and densities; returns all visible nodes in page order, and the body (the root if there is none)."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += reversed(x.kids())
    for x in reversed(order):
        kids = x.kids()
        x.chars = sum(len("".join(p.split())) for p in x.parts if isinstance(p, str)) + sum(k.chars for k in kids)
        x.tags = sum(k.tags + 1 for k in kids)
        x.link_chars = x.chars if x.link else sum(k.link_chars for k in kids)
        x.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for x in order:
        c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
        base = math.log(c / max(c - x.link_chars, 1) * lc + share * c + math.e)
        x.density = c / t * max(math.log(c / lc * t / lt) / math.log(base), 0.0) if c else 0.0
    return order, body


def sums(order: list[Node], left_out: int) -> None:
    """Fills in total, the sum of the children's densities (of an element without children its own), and best, the block of the largest total in the subtree; what names itself left_out or worse is no child."""
    for x in reversed(order):
        kids = [k for k in x.kids() if k.out < left_out]
        x.total = sum(k.density for k in kids) or x.density
        x.best = x if x.chars and (x.tag in BLOCKS or x.parent is None) else None
        for k in kids:
            if k.best is not None and (x.best is None or k.best.total > x.best.total):
                x.best = k.best


def _path(x: Node, top: Node) -> Iterator[Node]:
    """The elements around x, up to top."""
    while x is not top and x.parent is not None:
        x = x.parent
        yield x


def _mostly_links(x: Node) -> bool:
    """Whether over half of an element's characters are in links."""
    return x.link_chars * 2 > x.chars


def _settle_marks(order: list[Node], body: Node) -> None:
    """Lets density overrule marks.

    A word of LINK_MARKS counts where the text is mostly links. An element that holds the largest sum of the page is a wrapper
    if nothing, or for a sum of several blocks little, is left outside of marks; an article or main there counts as something.
    """
    for x in order:
        if x.out == LINKS:
            x.out = MARKED if _mostly_links(x) else NONE
    if not any(x.out in (HEADER, MARKED) for x in order):
        return
    sums(order, OUT)
    inner = body.best or body
    at, around = inner.total, [x for x in (inner, *_path(inner, body)) if x.out in (HEADER, MARKED)]
    if not around:
        return
    within: set[int] = set()
    said = stated = False
    for x in order:
        if x.out >= HEADER or id(x.parent) in within:
            within.add(id(x))
        else:
            said |= any(isinstance(p, str) and not p.isspace() for p in x.parts)
            stated |= x.tag in ("article", "main")
    sums(order, HEADER)
    little = any(k.tag in BLOCKS and k.chars for k in inner.kids()) and body.best is not None and body.best.total < WRAPPER * at
    if not stated and (little or not said):
        for x in around:
            x.out = NONE


def _article_of(best: Node, body: Node) -> Node:
    """The element that is the article as a whole: the chosen one, or one around it about as dense that holds nothing else than text."""
    while best.tag in PARTS and best is not body and best.parent is not None:
        best = best.parent
    while best is not body and best.parent not in (None, body, body.parent):
        up = best.parent
        if up.density * 2 < best.density or any(k.chars and (k.out > HEADER or _mostly_links(k)) for k in up.kids()):
            break
        best = up
    return best


def choose(root: Node) -> list[Node]:
    """The elements that make up the main text, in page order, none within another."""
    order, body = measure(root)
    _settle_marks(order, body)
    sums(order, HEADER)
    if body.best is None:
        return []
    best = body.best
    threshold = min(x.density for x in (best, *_path(best, body)))
    best = _article_of(best, body)
    path = {id(x) for x in _path(best, body)}
    kept, tops, todo = {id(best)}, [], [body]
    while todo:
        x = todo.pop()
        if id(x) not in path and id(x) not in kept and x.density >= threshold and x.best is not None and not _mostly_links(x.best):
            kept.add(id(x.best))
        if id(x) in kept:
            tops.append(x)
        else:
            todo += [k for k in reversed(x.kids()) if k.out == NONE]
    return _without_holes(order, tops)


def _without_holes(order: list[Node], tops: list[Node]) -> list[Node]:
    """tops with what stands between them side by side, and with the headings just before them."""
    held: dict[int, int] = defaultdict(int, {id(x): 1 for x in tops})
    common = order[0]
    for x in reversed(order):
        held[id(x)] += sum(held[id(k)] for k in x.kids())
    for x in order:
        if held[id(x)] == len(tops):
            common = x
    full = {id(x) for x in tops}
    if len(tops) > 1:
        kids = common.kids()
        places = [k for k, x in enumerate(kids) if held[id(x)]]
        full |= {id(x) for x in kids[places[0] : places[-1]] if not held[id(x)] and x.out == NONE and not _mostly_links(x)}
    for x in order:
        kids = [k for k in x.kids() if k.chars and k.out == NONE] if held[id(x)] else []
        for k, after in zip(kids[-2::-1], kids[:0:-1], strict=True):
            if k.tag in HEADINGS and id(after) in full:
                full.add(id(k))
    out, todo = [], [order[0]]
    while todo:
        x = todo.pop()
        if id(x) in full:
            out.append(x)
        else:
            todo += reversed(x.kids())
    return out


def _is_left_out(x: Node, article: bool) -> bool:
    """Whether an element within a chosen one is no part of its text: what names itself otherwise, and the header of a page, not of an article."""
    if x.out != HEADER or article:
        return x.out > HEADER
    return x.parent is None or x.parent.tag in ("body", "html", "#root") or any(k.tag in ("nav", "footer") for k in x.parent.kids())


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one space; empty if the page has none."""
    out: list[str] = []
    for top in choose(parse(page or "")):
        article = any(x.tag in ("article", "main") for x in (top, *_path(top, None)))
        todo: list[tuple[Node | str, bool]] = [(top, article)]
        while todo:
            x, article = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif not x.skip and (x is top or not _is_left_out(x, article)):
                article = article or x.tag in ("article", "main")
                if x.tag in BLOCKS or x.tag == "br":
                    out.append(" ")
                    todo.append((" ", article))
                todo += [(p, article) for p in reversed(x.parts)]
        out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, into: str = "text") -> DataFrame:
    """Adds the main text (column into) to pages (html, ...), row by row.

    Null html counts as empty, and a page without an article has empty text. Repeated rows stay, each with its text; an empty
    table gives an empty table. Other columns stay as they are, but one named like into is replaced.
    """

    @F.pandas_udf("string")
    def main(pages_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in pages_:
            yield pd.Series([main_text(x) for x in p], dtype="object")

    return pages.withColumn(into, main("html"))
