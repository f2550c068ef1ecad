"""Leaf blocks of an HTML page: the text between two borders of block elements, with the elements around it."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style head title noscript template iframe object svg math canvas audio video map select datalist textarea noframes".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HEAD = frozenset("html head meta link title style script base noscript template".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre figcaption caption".split())
NAMED_BY = ("class", "id", "role", "itemprop", "aria-label")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([a-zA-Z-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
MOST_NAME = 200


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    around: tuple[str, ...]
    near: tuple[str, ...]
    linked: int
    inside: int


@dataclass(slots=True)
class _Open:
    tag: str
    names: tuple[str, ...]
    number: int
    links: int = 0


class BlockParser:
    """Collects blocks. known: the names around a block that count; all of them if None.

    Time is linear in the length of a page, whatever is left open in it: the names around a block are counted as elements open and close.
    """

    def __init__(self, known: frozenset[str] | None = None):
        self.known = known
        self.blocks: list[Block] = []
        self.stack = [_Open("", (), 0)]
        self.tags: Counter[str] = Counter()
        self.around: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links = self.linked = self.hidden = self.opened = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                own = self.stack[-1]
                near = tuple(n for e in self.stack[-2:] for n in e.names)
                self.blocks.append(Block(text, own.tag, tuple(self.around), near, self.linked, self.stack[-2].number if own.tag in LEAVES else own.number))
            self.parts = []
        self.linked = 0

    def pop(self) -> None:
        e = self.stack.pop()
        self.links -= e.links
        self.tags[e.tag] -= 1
        self.hidden -= e.tag in HIDDEN
        for n in e.names:
            self.around[n] -= 1
            if not self.around[n]:
                del self.around[n]

    def start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a" and not self.stack[-1].links:
                self.stack[-1].links = 1
                self.links += 1
            return
        self.flush()
        if tag in VOID:
            return
        if self.tags["head"] and tag not in HEAD:
            self.shut("head")
        if self.stack[-1].tag == "p":
            self.pop()
        if tag in CLOSED_BY_SAME and self.tags[tag]:
            self.shut(tag, CLOSED_BY_SAME[tag])
        names = ["in:" + tag]
        for key, value in _ATTR.findall(attrs):
            if key.lower() in NAMED_BY:
                names += {"name:" + n.lower() for n in _NAME.findall(value[:MOST_NAME])}
        names = tuple(n for n in names if self.known is None or n in self.known)
        self.opened += 1
        self.stack.append(_Open(tag, names, self.opened))
        self.tags[tag] += 1
        self.hidden += tag in HIDDEN
        self.around.update(names)

    def shut(self, tag: str, within: set[str] | None = None) -> None:
        """Pop up to the open element `tag`, unless one of `within` lies above it."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if within and self.stack[k].tag in within:
                return

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a" and self.stack[-1].links:
                self.stack[-1].links = 0
                self.links -= 1
            return
        self.flush()
        if tag not in VOID and self.tags[tag]:
            self.shut(tag)

    def data(self, data: str) -> None:
        if not self.hidden:
            text = unescape(data)
            self.parts.append(text)
            if self.links:
                self.linked += len(text)

    def feed(self, page: str) -> None:
        at, n, last = 0, len(page), page.rfind(">")
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or lt > last and page[lt + 1 : lt + 2].isalpha():  # a tag that the page's end cuts off is no text
                self.data(page[at : lt if lt >= 0 else n])
                return
            after = page[lt + 1 : lt + 2]
            if after in ("!", "?") and after:
                self.data(page[at:lt])
                end = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
                at = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
                continue
            tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)  # the second one where a quote never closes
            if tag is None:  # a < that begins no tag is text
                self.data(page[at : lt + 1])
                at = lt + 1
                continue
            self.data(page[at:lt])
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                self.end(name)
                continue
            self.start(name, tag[3])
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}[\\s/>]", re.IGNORECASE).search(page, at)
                if close is None:
                    return
                at = close.start()


def blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    p = BlockParser(known)
    p.feed(page or "")
    p.flush()
    return p.blocks
