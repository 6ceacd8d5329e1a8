"""Main text of web pages by tree scoring.

1. One pass over the page makes a tree of elements and its blocks of text. What is boilerplate by tag, by
   role or because it is hidden leaves with all below it; a ``header`` stays inside an article or main.
2. Names in class and id attributes only flag an element: a name counts if all of its words are boilerplate or
   layout words and one is boilerplate (``left-sidebar``, but not ``has-sidebar``). A flagged element leaves unless it
   holds more than ``SHARE`` of the page's points; comments and adverts leave in any case.
3. Each block earns points for its length and commas, discounted by the share of its characters that are links.
   They go to the container that holds it, and each element passes half of its points to its parent.
4. The container with the most points is the article; an enclosing ``article`` or ``main`` stands for it, and
   without one it grows to the ancestor that isn't just a wrapper around it. Beside it stay siblings that are headings,
   paragraphs, lists, tables and the like, and containers with points of their own, unless they are mostly links.

All steps take time in proportion to the page, however deep its tags nest and whatever isn't closed.

Defined cases: null and empty pages have an empty text; plain text is one block; a tag without its ``>`` ends the
page, a comment or script without its end runs to the page's end, a quote without its end is no quote; elements
that aren't closed end with the page; white space of any kind becomes one space; of containers with equal points the
first in page order wins; a page without anything but boilerplate has an empty text; repeated rows are read each.
Very long pages are read whole. Input columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot "
    "tr td th caption pre blockquote figure figcaption form fieldset address hr details summary center dialog menu hgroup".split()
)
#: Their content isn't markup, or none that is text.
RAW = frozenset("script style noscript template iframe textarea svg math object title".split())
BOILER_TAGS = frozenset("nav footer aside form head button select option fieldset dialog menu label audio video canvas".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that flag an element by a name of its class or id.
BOILER_WORDS = frozenset(
    "ad ads sponsor banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar rail menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar "
    "copyright share sharing social related recommended recommendations widget search form pager pagination toolbar skip".split()
)
#: Those that tell a reader's comment or an advert, however long.
STRICT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion adv advert adverts advertisement advertising sponsored promo promotion".split())
#: Words that say nothing beside one of the others.
LAYOUT_WORDS = frozenset(
    "site page left right top bottom side main box list container wrapper wrap inner outer area section block bar row col column "
    "panel group link links item items post posts article articles story stories content primary secondary global fixed sticky "
    "module region slot unit zone buttons icons message thread form body media the".split()
)
CONTAINERS = frozenset("div section article main body html td center".split())
#: Siblings of the article that are content of their own.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hgroup header address details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BONUS = {"article": 10.0, "main": 8.0, "section": 2.0, "div": 1.0}
#: Share of the page's points that no boilerplate holds; share of links that no content holds; points of a container of its own.
SHARE, LINKS, OWN = 0.8, 0.5, 2.0
_SCOPES = frozenset("html body table td th button caption object".split())
_STRONG_END = frozenset("html body table tr div article main section".split())
#: What an open tag ends: (open tags, elements that shield them).
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_NAME = re.compile(r"[^\s/>\"'<]*+")
_ATTR = re.compile(r"[\s/]*+([^\s/>=]++=?|=)")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_WORD = re.compile(r"[a-z]+")
_HIDING = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WATCHED = frozenset("class id role style hidden aria-hidden".split())


class _Node:
    __slots__ = ("tag", "parent", "boiler", "flag", "holder", "inline", "points", "score", "size", "links", "chosen")

    def __init__(self, tag: str, parent: _Node | None, boiler: bool, flag: int):
        self.tag, self.parent, self.boiler, self.flag = tag, parent, boiler, flag
        self.holder: _Node = self if parent is None or tag in BLOCK else parent.holder
        #: The outermost flagged element around text within a block.
        self.inline: _Node | None = None if self.holder is self or parent is None else parent.inline or (self if flag else None)
        self.points = self.score = 0.0
        self.size = self.links = 0
        self.chosen = False


def _flag(names: str) -> int:
    """2 for comments and adverts, 1 for other boilerplate, 0 for none, by names of a class or id."""
    found = 0
    for name in names.split():
        words = _WORD.findall(name)
        strict = any(w in STRICT_WORDS for w in words)
        if (strict or any(w in BOILER_WORDS for w in words)) and all(w in STRICT_WORDS or w in BOILER_WORDS or w in LAYOUT_WORDS for w in words):
            found = max(found, 2 if strict else 1)
    return found


class _Page:
    """The elements in page order, parents before children, and the blocks: (element, [(text, link characters, flagged)])."""

    def __init__(self, html: str):
        self.html = html
        self.root = _Node("html", None, False, 0)
        self.nodes = [self.root]
        self.stack = [self.root]
        self.open_at: dict[str, list[int]] = {"html": [0]}
        self.scopes = [0]
        self.blocks: list[tuple[_Node, list[tuple[str, int, _Node | None]]]] = []
        self.pieces: list[tuple[str, int, _Node | None]] = []
        self.last = {c: html.rfind(c) for c in "\"'>"}
        at, n = 0, len(html)
        while at < n:
            i = html.find("<", at)
            if i < 0:
                self._text(html[at:])
                break
            if i > at:
                self._text(html[at:i])
            at = self._markup(i)
        self._flush()

    def _markup(self, i: int) -> int:
        """Reads what begins with the ``<`` at ``i``; returns where it ends."""
        html, n = self.html, len(self.html)
        c = html[i + 1 : i + 2]
        if c == "!" and html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            return n if end < 0 else end + 3
        if c and c in "!?" or c == "/" and not html[i + 2 : i + 3].isalpha():
            end = html.find(">", i) if self.last[">"] > i else -1
            return n if end < 0 else end + 1
        if not (c == "/" or c.isalpha()):
            self._text("<")
            return i + 1
        if self.last[">"] < i:
            return n
        if c == "/":
            m = _NAME.match(html, i + 2)
            self._close(m[0].lower())
            return html.find(">", m.end()) + 1
        m = _NAME.match(html, i + 1)
        tag = m[0].lower()
        end, attrs, whole = self._attributes(m.end())
        if end < 0:
            return n
        if tag in RAW and not whole:
            close = _RAW_END[tag].search(html, end)
            if not close:
                return n
            gt = html.find(">", close.end()) if self.last[">"] >= close.end() else -1
            return n if gt < 0 else gt + 1
        self._open(tag, attrs, whole)
        return end

    def _attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        """(end of the tag or -1, the attributes that are looked at, whether it closes itself)."""
        html, found, whole = self.html, {}, False
        while True:
            m = _ATTR.match(html, at)
            if not m:
                end = html.find(">", at) if self.last[">"] >= at else -1
                return (end + 1 if end >= 0 else -1), found, end > 0 and html[end - 1] == "/"
            name, at = m[1], m.end()
            value = ""
            if name.endswith("=") and len(name) > 1:
                name, has = name[:-1], True
                while at < len(html) and html[at].isspace():
                    at += 1
            else:
                e = _EQUALS.match(html, at)
                has = e is not None
                at = e.end() if e else at
            if has:
                q = html[at : at + 1]
                if q and q in "\"'" and self.last[q] > at:
                    end = html.find(q, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    b = _BARE.match(html, at)
                    value, at = b[0].strip("\"'"), b.end()
            name = name.lower()
            if name in _WATCHED and name not in found:
                found[name] = value.lower()

    def _text(self, raw: str) -> None:
        if not self.stack[-1].boiler:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append((text, len(text.strip()) if self.open_at.get("a") else 0, self.stack[-1].inline))

    def _flush(self) -> None:
        if self.pieces:
            self.blocks.append((self.stack[-1].holder, self.pieces))
            self.pieces = []

    def _innermost(self, tags: tuple[str, ...]) -> int:
        """Depth of the innermost open element of ``tags``, or -1."""
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=-1)

    def _pop_to(self, depth: int) -> None:
        for node in reversed(self.stack[depth:]):
            self.open_at[node.tag].pop()
        del self.stack[depth:]
        while self.scopes[-1] >= depth:
            self.scopes.pop()

    def _open(self, tag: str, attrs: dict[str, str], whole: bool) -> None:
        if tag == "br":
            self.pieces.append((" ", 0, None))
            return
        if tag in ("html", "body") and self.open_at.get(tag):
            return
        if tag in BLOCK:
            self._flush()
            if (d := self._innermost(("p",))) > self.scopes[-1]:
                self._pop_to(d)
            if tag in _ENDS:
                tags, shields = _ENDS[tag]
                if (d := self._innermost(tags)) > max(0, self._innermost(shields)):
                    self._pop_to(d)
            if tag == "body" and (d := self._innermost(("head",))) > 0:
                self._pop_to(d)
        if tag in VOID:
            return
        parent = self.stack[-1]
        boiler = parent.boiler or tag in BOILER_TAGS or tag == "header" and not (self.open_at.get("article") or self.open_at.get("main"))
        flag = 0
        if attrs and not boiler and tag not in ("html", "body"):
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or ("style" in attrs and _HIDING.search(attrs["style"]))
            boiler = bool(hidden) or not BOILER_ROLES.isdisjoint(attrs.get("role", "").split())
            flag = max(_flag(attrs.get("class", "")), _flag(attrs.get("id", "")))
        node = _Node(tag, parent, boiler, flag)
        self.nodes.append(node)
        if not whole:
            if tag in _SCOPES:
                self.scopes.append(len(self.stack))
            self.open_at.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append((" ", 0, None))
            return
        d = self._innermost((tag,))
        if d <= 0 or (self.scopes[-1] > d and tag not in _STRONG_END):
            return
        if tag in BLOCK:
            self._flush()
        self._pop_to(d)


def points(text: str, links: int) -> float:
    """Points of a block of text."""
    return (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - min(1.0, links / len(text)))


def _joined(pieces: list[tuple[str, int, _Node | None]]) -> tuple[str, int]:
    """The text and the link characters of some pieces of a block."""
    return " ".join("".join([p[0] for p in pieces]).split()), sum(p[1] for p in pieces)


def _without_flagged(page: _Page) -> list[tuple[_Node, str, int]]:
    """(element, text, link characters) of the blocks, without what a flagged element takes away."""
    whole = [(node, pieces, *_joined(pieces)) for node, pieces in page.blocks]
    total = 0.0
    for node, pieces, text, links in whole:
        if text:
            node.points += (p := points(text, links))
            total += p
            for raw, some, flagged in pieces:
                if flagged is not None and raw.strip():
                    flagged.points += points(raw, some)
    for node in reversed(page.nodes[1:]):  # children before parents
        if node.inline is None:
            node.parent.points += node.points
    for node in page.nodes[1:]:
        node.boiler = node.parent.boiler or node.flag == 2 or (node.flag == 1 and node.points <= SHARE * total)
    out = []
    for node, pieces, text, links in whole:
        if any(f is not None and f.boiler for _, _, f in pieces):
            text, links = _joined([p for p in pieces if p[2] is None or not p[2].boiler])
        if text and not node.boiler:
            out.append((node, text, links))
    return out


def _article(nodes: list[_Node]) -> _Node:
    """The element that the article is taken from."""
    for node in nodes:
        if node.score > 0:
            node.score += BONUS.get(node.tag, 0.0)
    best = max(nodes, key=lambda n: n.score)
    up: _Node | None = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        return up
    while best.parent is not None and best.parent.parent is not None and best.parent.size == best.size:
        best = best.parent  # a wrapper
    return best


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Page(html)
    blocks = _without_flagged(page)
    if not blocks:
        return ""
    nodes = page.nodes
    for node, text, links in blocks:
        own = node if node.tag in CONTAINERS else node.parent or node
        own.score += points(text, links)
        node.size += len(text)
        node.links += links
    for node in reversed(nodes[1:]):
        node.parent.score += node.score / 2
        node.parent.size += node.size
        node.parent.links += node.links
    best = _article(nodes)
    named = best.tag in ("article", "main")
    best.chosen = True
    for node in nodes[1:]:
        if node is best:
            continue
        if node.parent.chosen:
            node.chosen = True
        elif node.parent is best.parent and node.size and node.links < LINKS * node.size:
            if named and best.parent.tag in ("body", "html"):
                node.chosen = node.tag not in HEADINGS and node.score >= max(10.0, 0.2 * best.score) and node.tag not in ("ul", "ol", "table")
            else:
                node.chosen = node.tag in CONTENT or (node.tag in CONTAINERS and node.score >= OWN)
    out = []
    for node, text, links in blocks:
        beside = node is best.parent and (len(text) > 80 or text[-1] in ".!?") and links < LINKS * len(text)
        if node.chosen or beside:
            out.append(text)
    return "\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h) for h in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(texts, pa.string())], names=["doc", "main_text"])


def main_text(pages: DataFrame, html_col: str = "html", keep_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named input columns as a struct ``doc`` and ``main_text`` of each page."""
    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), F.struct(*[F.col(f"`{c}`") for c in keep_cols]).alias("doc"))
    return rows.mapInArrow(_extracted, f"doc {rows.schema['doc'].dataType.simpleString()}, main_text string")
