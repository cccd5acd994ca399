"""Cutting raw HTML into leaf blocks of text, each with the path of tags above it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

#: A comment, a declaration, or a tag whose quoted attributes may hold ">".
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
#: The same for a tag with an unclosed quote.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Fixed values of HTML: elements without an end tag, elements whose content is no text of
#: the page, elements whose tags don't end a run of text, and end tags that a start tag implies.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template svg iframe title textarea select datalist audio video canvas".split())
#: Of these, the ones that go to the end of the page without an end tag.
ENDLESS = frozenset(("script", "style"))
_MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom semantics annotation"
INLINE = frozenset(f"a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr {_MATH}".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in SILENT}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    """An element above a run of text: its label, the element that holds it, and room for what a reader derives from both."""

    __slots__ = ("parent", "label", "depth", "derived")

    def __init__(self, parent: Node | None, label: str) -> None:
        self.parent, self.label, self.derived = parent, label, None
        self.depth: int = parent.depth + 1 if parent else 1

    def up(self) -> Iterator[Node]:
        """The element and those that hold it."""
        node: Node | None = self
        while node:
            yield node
            node = node.parent


@dataclass
class Block:
    """A run of text between block-level tags; blocks share the elements above them, so that deep pages stay small."""

    node: Node | None
    text: str
    linked: int = 0

    @property
    def path(self) -> tuple[str, ...]:
        """Labels of the elements above, the outermost first."""
        return tuple(n.label for n in self.node.up())[::-1] if self.node else ()


@dataclass
class _Cutter:
    """Open elements as a stack, with the places of each name and of all block-level ones, so that none is searched for."""

    stack: list[tuple[str, Node | None]] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    levels: list[int] = field(default_factory=list)
    run: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        if raw:
            t = unescape(raw) if "&" in raw else raw
            self.run.append(t)
            if self.places["a"]:
                self.linked += len(t)

    def cut(self) -> None:
        if self.run:
            whole = " ".join("".join(self.run).split())
            if whole:
                self.blocks.append(Block(self.stack[-1][1] if self.stack else None, whole, self.linked))
            self.run, self.linked = [], 0

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, -1 without one."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.run.append(" ")
            return
        if name not in INLINE:
            self.cut()
            if self.places["p"]:
                self.close("p")
            if name in IMPLIED:
                at = self.last(IMPLIED[name])
                if at > self.last(SCOPES[name]):
                    self.leave(at)
        if name in VOID:
            return
        node = self.stack[-1][1] if self.stack else None
        if name not in INLINE:
            node = Node(node, name + marks(attributes))
            self.levels.append(len(self.stack))
        self.places[name].append(len(self.stack))
        self.stack.append((name, node))

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.cut()
        at = self.last((name,))
        if at >= 0 and (name not in INLINE or not self.levels or at > self.levels[-1]):
            self.leave(at)

    def leave(self, at: int) -> None:
        for name, _ in self.stack[at:]:
            self.places[name].pop()
        while self.levels and self.levels[-1] >= at:
            self.levels.pop()
        del self.stack[at:]


def marks(attributes: str) -> str:
    """Words of a tag's class, id and role, each behind a dot."""
    if not attributes or "=" not in attributes:
        return ""
    words: list[str] = []
    for m in _MARK.finditer(attributes):
        words += [w.lower() for w in _PARTS.findall(m[2] or m[3] or m[4] or "")]
    return "".join("." + w for w in words[:12])


def cut_blocks(html: str | None) -> list[Block]:
    """The page's runs of text in page order, white space made single spaces; any input gives some result.

    Scripts, styles and other silent elements are skipped up to their end tag;
    without one, scripts and styles to the end of the page, of others the tag
    alone. A head has no text but that of silent elements, so it needs no end. A
    tag that the page's end cuts off is dropped.
    """
    c, html, at = _Cutter(), html or "", 0
    unclosed: set[str] = set()
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            c.text(html[at:])
            break
        m = _MARKUP.match(html, lt) or _LOOSE.match(html, lt)
        if m is None:
            rest = html[lt + 1 : lt + 3]
            if rest[:1].isalpha() or rest[:1] == "/" and rest[1:].isalpha():
                c.text(html[at:lt])  # cut off by the end of the page
                break
            c.text(html[at : lt + 1])
            at = lt + 1
            continue
        c.text(html[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            c.close(name)
            continue
        if name == "head":
            c.cut()
            continue
        if name in SILENT:
            if not m[3].rstrip().endswith("/"):
                c.cut()
                end = None if name in unclosed else _END[name].search(html, at)
                if end is not None:
                    stop = html.find(">", end.end())
                    at = len(html) if stop < 0 else stop + 1
                elif name in ENDLESS:
                    break
                else:
                    unclosed.add(name)  # nor has any later one an end
            continue
        c.open(name, m[3])
    c.cut()
    return c.blocks
