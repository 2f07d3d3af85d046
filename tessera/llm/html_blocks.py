"""HTML into leaf blocks: runs of text between the edges of block elements, with where they stand."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark noscript object picture q s samp small span strike strong sub sup time tt u var".split())
#: Inside these every element is part of the line.
FOREIGN = frozenset(["math", "svg"])
#: Elements of drawings that stand apart from the text before them.
APART = frozenset(["desc", "text", "title", "tspan"])
SECTIONS = frozenset("article main nav aside header footer form section table body".split())
#: An opening element closes these if they are open in the same container.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article main nav aside header footer form body html".split())

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
MARKED = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true)""", re.I)
TOKEN = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    kinds: frozenset[str]  # tags of the open elements
    leaf: str  # the innermost tag
    section: str  # the innermost of SECTIONS
    names: frozenset[str]  # words of their class, id and role
    linked: float  # share of characters inside links
    bold: bool = False
    index: int = 0
    hidden: bool = False


@dataclass
class _Open:
    tag: str
    kinds: frozenset[str] = frozenset()
    section: str = ""
    names: frozenset[str] = frozenset()
    hidden: bool = False


class _Stack:
    """Open elements, with the places of each tag: any end tag is found at once, however deep the page is."""

    def __init__(self):
        self.items, self.at = [_Open("")], {}

    def push(self, item: _Open) -> None:
        self.at.setdefault(item.tag, []).append(len(self.items))
        self.items.append(item)

    def last(self, tags) -> int:
        """The place of the innermost element with one of the tags; 0: none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        for item in self.items[place:]:
            self.at[item.tag].pop()
        del self.items[place:]


def blocks(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks with text, in page order. Never fails: what is no tag is text, what has no end runs to the end.

    known: the tags and names that matter to the caller (null: all). With it, time and
    memory are in proportion to the page, at any depth.
    """
    html = html or ""
    found: list[Block] = []
    stack = _Stack()
    parts: list[tuple[str, bool]] = []
    links = bolds = foreign = 0
    quotes, pos, size = True, 0, len(html)

    def close_block() -> None:
        if not parts:
            return
        text = " ".join(unescape("".join(p for p, _ in parts)).split())
        if text:
            total = sum(len(p) for p, _ in parts)
            top = stack.items[-1]
            found.append(Block(text, top.kinds, top.tag, top.section, top.names, sum(len(p) for p, in_link in parts if in_link) / total, bolds > 0, len(found), top.hidden))
        parts.clear()

    while pos < size:
        at = html.find("<", pos)
        if at < 0:
            at = size
        if at > pos:
            parts.append((html[pos:at], links > 0))
        if at == size:
            break
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        name = NAME.match(html, at + 1)
        if not name:
            parts.append(("<", links > 0))
            pos = at + 1
            continue
        tag, closing = name[1].lower(), html[at + 1] == "/"
        end = ATTRIBUTES.match(html, name.end()) if quotes else None
        if end:
            stop = end.end()
        else:
            quotes = False  # a quotation mark has no partner: from here on a tag ends at the next >
            stop = html.find(">", name.end()) + 1 or size
        attributes, pos = html[name.end() : stop], stop
        if tag in RAW and not closing:
            if not attributes.rstrip(">").endswith("/"):
                m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
                pos = m.end() if m else size
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                parts.append((" ", links > 0))
            continue
        if tag in FOREIGN:
            foreign = max(0, foreign + (-1 if closing else 0 if attributes.rstrip(">").endswith("/") else 1))
            continue
        if foreign and tag not in CONTAINERS and tag != "p":  # one of those ends what was left open
            if tag in APART:
                parts.append((" ", links > 0))
            continue
        if tag in INLINE:
            step = -1 if closing else 1
            if tag == "a":
                links = max(0, links + step)
            elif tag in ("b", "strong"):
                bolds = max(0, bolds + step)
            continue
        close_block()
        if tag in VOID:
            continue
        links = foreign = 0
        if closing:
            if place := stack.last([tag]):
                stack.cut(place)
            continue
        if stack.items[-1].tag == "p":
            stack.cut(len(stack.items) - 1)
        if tag in CLOSES and (place := stack.last(CLOSES[tag])) > stack.last(CONTAINERS):
            stack.cut(place)
        top, names, hidden = stack.items[-1], frozenset(), False
        if attributes and "=" in attributes or "hidden" in attributes:
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in MARKED.finditer(attributes)}
            names = frozenset(TOKEN.findall(" ".join(v for k, v in values.items() if k != "style").lower()))
            names = names if known is None else names & known
            hidden = bool(HIDDEN.search(attributes)) or "display:none" in values.get("style", "").replace(" ", "").lower()
        bolds = 0
        new = tag not in top.kinds and (known is None or tag in known)
        stack.push(_Open(tag, top.kinds | {tag} if new else top.kinds, tag if tag in SECTIONS else top.section, top.names if names <= top.names else top.names | names, top.hidden or hidden))
    close_block()
    return found
