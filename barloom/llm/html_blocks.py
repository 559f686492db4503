"""Leaf text blocks of an HTML page with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-zA-Z]+")
#: fixed values: elements whose content is not text of the page
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "textarea", "select", "datalist", "audio", "video"}
#: where each raw element ends, found in the source itself: lower-casing a whole page can change its length
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
BODY = re.compile("<body", re.I | re.A)
#: fixed values: elements that run on inside a block
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
#: fixed values: elements without an end
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Element:
    """An open element: tag with the words of its class, id and role; elements inside it share it as their parent, so paths take no room of their own."""

    __slots__ = ("depth", "known", "name", "parent", "tag")

    def __init__(self, tag: str, name: str, parent: Element | None):
        self.tag, self.name, self.parent, self.depth = tag, name, parent, parent.depth + 1 if parent else 1
        self.known: dict = {}


def inherited(element: Element | None, key: str, first, step):
    """Value of `element` that follows from its parent's: step(value above, element), `first` above the outermost one. Kept with each
    element, found without recursion."""
    waiting = []
    while element is not None and key not in element.known:
        waiting.append(element)
        element = element.parent
    value = first if element is None else element.known[key]
    for e in reversed(waiting):
        value = e.known[key] = step(value, e)
    return value


@dataclass
class Block:
    """Text with references decoded and white space as single spaces; innermost element; characters inside links."""

    text: str
    element: Element | None
    linked: int

    @property
    def depth(self) -> int:
        return self.element.depth if self.element else 0

    @property
    def path(self) -> tuple[str, ...]:
        """Names from the outermost element on."""
        out, e = [], self.element
        while e:
            out.append(e.name)
            e = e.parent
        return tuple(reversed(out))


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    inner: Element | None = None
    open: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    anchors: int = 0
    linked: int = 0

    def close(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.blocks.append(Block(text, self.inner, self.linked))
        self.parts, self.linked = [], 0

    def pop(self) -> None:
        self.open[self.inner.tag] -= 1
        self.inner = self.inner.parent

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.anchors += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in INLINE:
            return
        self.close()
        self.anchors = 0
        while self.inner and self.inner.tag == "p":  # a block ends an open paragraph
            self.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.inner and self.inner.tag == tag:
            self.pop()
        if tag not in VOID:
            words = [w.lower() for m in NAMES.finditer(attributes) for w in WORD.findall(m[1] or m[2] or m[3] or "")] if attributes else []
            self.inner = Element(tag, " ".join([tag, *words]), self.inner)
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        if tag in INLINE:
            return
        self.close()
        if self.open[tag]:
            while self.inner.tag != tag:
                self.pop()
            self.pop()


def blocks(source: str) -> list[Block]:
    """Text between block elements, in page order. Comments, scripts, styles and other raw elements hold none; an unknown or
    broken tag counts as a tag, a lone "<" as text. Time and memory grow with the page's length, however deep it nests."""
    page, at, last_close, absent = Page(), 0, source.rfind(">"), set()

    def search(pattern: re.Pattern, start: int) -> int | None:
        """Where the pattern comes next. One that was not found once is not looked for again."""
        if pattern in absent:
            return None
        found = pattern.search(source, start)
        if not found:
            absent.add(pattern)
        return found.start() if found else None

    while at < len(source):
        if source[at] == "<" and at > last_close and not source.startswith("<!--", at):  # no tag can end any more
            token, tag, at = "<", "", at + 1
        else:
            m = TOKEN.match(source, at)
            at, token, tag = m.end(), m[0], (m[2] or "").lower()
        if token[0] != "<" or token == "<":
            page.parts.append(token)
            if page.anchors:
                page.linked += len(token)
        elif tag in RAW and not m[1] and not token.endswith("/>"):
            page.close()
            found = search(RAW_END[tag], at)
            if tag == "head":  # heads may lack their end
                at = min((x for x in (found, search(BODY, at)) if x is not None), default=at)
            else:
                at = len(source) if found is None else found
        elif tag:
            page.end(tag) if m[1] else page.start(tag, m[3])
    page.close()
    return page.blocks
