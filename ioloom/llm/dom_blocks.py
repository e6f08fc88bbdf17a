"""Leaf blocks of an HTML page: the text runs between block-level tags, with their ancestors.

Tags are read by HTML's attribute states, so a stray quote or angle bracket costs no text. Time is
linear in the page: what a page lacks (the end of a comment, a second quote) is looked for once.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# How HTML treats its elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text without tags, and never a block.
RAW = frozenset("script style title".split())
#: Their content may hold tags, and is never a block. One that is never closed counts as absent.
SKIPPED = frozenset("noscript template iframe svg object canvas audio video math".split())
#: Opening one of these ends an open element of the listed kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: A search for an element to end stops at these.
SCOPE = frozenset("ul ol dl table article section aside nav div main body header footer form blockquote".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: White space and slashes, then the tag's end, or an attribute's name and what opens its value.
_STEP = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*([\"']?))?)")
_BARE = re.compile(r"[^\s>]*")
_PAIRED = re.compile(rf"<(/?)({'|'.join(sorted(SKIPPED))})(?=[\s/>])[^<>]*>", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
_MARKUP = re.compile(r"<[a-zA-Z/!]")


class Node:
    """An open element: its tag, the words of its class, id and role, its label and its parent."""

    __slots__ = ("label", "parent", "said", "tag", "words")

    def __init__(self, tag: str, words: str, label: str | None, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.label = label if label is not None or parent is None else parent.label
        self.said: object = None  # room for what a reader derives from the element and its ancestors


@dataclass
class Block:
    text: str
    node: Node | None  # the innermost block-level element
    link_chars: int = 0

    @property
    def label(self) -> int | None:
        return None if self.node is None or self.node.label is None else int(self.node.label)


@dataclass
class _Open:
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0


class _Reader:
    def __init__(self, page: str):
        self.page = page
        self.lacking: set[str] = set()
        self.ends: dict[int, int] | None = None

    def find(self, what: str, at: int) -> int:
        """page.find, looking once only for what isn't there to the page's end."""
        if what in self.lacking:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.lacking.add(what)
        return found

    def tag(self, at: int) -> tuple[int, list[tuple[str, str]], bool] | None:
        """(end, attributes, self-closing) of the tag whose name ends at at; None if the page ends in it.

        A quote that no other one follows doesn't hide the rest: the tag then ends at the next >.
        """
        begin, attributes = at, []
        while m := _STEP.match(self.page, at):
            at = m.end()
            if m[1]:
                return at, attributes, self.page[at - 2] == "/"
            name, quote = m[2].lower(), m[3]
            if quote is None:
                attributes.append((name, ""))
                continue
            if quote:
                after = self.find(quote, at)
                if after < 0:
                    end = self.find(">", begin)
                    return None if end < 0 else (end + 1, attributes, False)
                attributes.append((name, self.page[at:after]))
                at = after + 1
            else:
                value = _BARE.match(self.page, at)
                attributes.append((name, value[0]))
                at = value.end()
        return None

    def skip(self, begin: int, at: int) -> int:
        """Where the skipped element that begins at begin ends; at, where its tag ends, if it is never closed."""
        if self.ends is None:
            self.ends, open_ = {}, {}
            for m in _PAIRED.finditer(self.page):
                tag = m[2].lower()
                if not m[1]:
                    if not m[0].endswith("/>"):
                        open_.setdefault(tag, []).append(m.start())
                elif open_.get(tag):
                    self.ends[open_[tag].pop()] = m.end()
        return self.ends.get(begin, at)

    def raw_end(self, tag: str, at: int) -> int:
        """Where a raw element's content ends; without an end tag, at the next markup."""
        if f"</{tag}" not in self.lacking:
            if m := _RAW_END[tag].search(self.page, at):
                return m.end()
            self.lacking.add(f"</{tag}")
        m = _MARKUP.search(self.page, at)
        return m.start() if m else len(self.page)


def _described(attributes: list[tuple[str, str]]) -> tuple[str, str | None]:
    words, label = [], None
    for name, value in attributes:
        if name in ("class", "id", "role"):
            words.append(value)
        elif name == "data-main":
            label = value
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value == "true":
            words.append("hidden")
    return " ".join(words), label


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order. Comments, scripts, styles and the like hold no blocks; white space in a
    block is one space; character references are decoded; a page may be malformed anywhere. A hidden inline element is a
    block of its own, before the one that goes on around it."""
    page = page or ""
    out: list[Block] = []
    read = _Reader(page)
    stack: list[Node] = []
    depth: dict[str, int] = {}  # open elements by tag
    now, links = _Open(), 0
    unseen: list[list] = []  # hidden inline elements: tag, how many of its kind are open in it, what was read around it

    def close():
        nonlocal now
        text = " ".join(html.unescape("".join(now.pieces)).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, now.link_chars))
        now = _Open()

    def show(k: int):
        """Ends the hidden inline elements from the k-th on; what was read around them goes on."""
        nonlocal now
        while len(unseen) > k:
            close()
            tag, _, now = unseen.pop()
            stack.pop()
            depth[tag] -= 1

    def text(piece: str):
        now.pieces.append(piece)
        if links:
            now.link_chars += len(piece)

    def pop_to(k: int):
        for node in stack[k:]:
            depth[node.tag] -= 1
        del stack[k:]

    at, kept = 0, 0  # the text from kept to at isn't taken yet
    while (at := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", at):
            # A comment that opens with --> or ---> is over at once.
            end = next((at + len(x) for x in ("<!-->", "<!--->") if page.startswith(x, at)), 0) or read.find("-->", at + 4) + 3
            end = end if end > at else read.find(">", at) + 1 or len(page)
            text(page[kept:begin])
            kept = at = end
            continue
        if page.startswith(("<!", "<?"), at):
            text(page[kept:begin])
            kept = at = read.find(">", at) + 1 or len(page)
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            at += 1
            continue
        found = read.tag(name.end())
        text(page[kept:begin])
        if found is None:
            kept = at = len(page)
            break
        (at, attributes, alone), tag = found, name[0].lower()
        kept = at
        if tag in RAW or tag in SKIPPED:
            if not closing and not (alone and tag not in RAW):
                kept = at = read.raw_end(tag, at) if tag in RAW else read.skip(begin, at)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            now.pieces.append(" ")
            continue
        if tag in INLINE:
            opens = not closing and not alone and tag not in VOID
            if opens and attributes and "hidden" in _described(attributes)[0].split():
                unseen.append([tag, 1, now])
                now = _Open()
                stack.append(Node(tag, *_described(attributes), stack[-1] if stack else None))
                depth[tag] = depth.get(tag, 0) + 1
            elif unseen and unseen[-1][0] == tag and (opens or closing):
                unseen[-1][1] += 1 if opens else -1
                if not unseen[-1][1]:
                    show(len(unseen) - 1)
            continue
        show(0)
        close()
        links = 0
        if closing:
            if depth.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            continue
        ends = {"p"} | ENDS.get(tag, set())
        if any(depth.get(e) for e in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    pop_to(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag not in VOID and not alone:
            stack.append(Node(tag, *_described(attributes), stack[-1] if stack else None))
            depth[tag] = depth.get(tag, 0) + 1
    text(page[kept:])
    show(0)
    close()
    return out
