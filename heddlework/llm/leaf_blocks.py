"""Leaf blocks of an HTML page: one scan over the text, in linear time on any input.

A leaf block is a run of text between two borders of block elements, with what is open around
it. Unclosed paragraphs, list items and cells end where the next one begins; an end tag without its start
is ignored. Scripts, styles and other elements without shown text are passed over.
"""

from __future__ import annotations

import re
from html import unescape

# HTML's element kinds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option optgroup p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template textarea title iframe noembed noframes xmp svg math canvas audio video object".split())
#: An element that begins ends an open one of the second group, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
MARKED = frozenset(t for ended, stops in ENDS.values() for t in ended | stops)
#: Inside a paragraph these do not end it.
IN_PARAGRAPH = frozenset("button label option select noscript".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"[>\"']")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """text; the element it stands in; names around it; how many of its characters are links; what holds its
    element, as a number, and what holds that (-1 for the page itself)."""

    __slots__ = ("text", "tag", "around", "linked", "container", "outer", "wanted")

    def __init__(self, text, tag, around, linked, container, outer, wanted):
        self.text, self.tag, self.around, self.linked, self.wanted = text, tag, around, linked, wanted
        self.container, self.outer = container, outer


def tokens(attributes: str) -> set[str]:
    """Words of the class, id and role of a tag."""
    found = set()
    for m in NAMED.finditer(attributes):
        found.update(TOKEN.findall(CASES.sub(" ", m[2] or m[3] or m[4] or "").lower()))
    return found


class Scanner:
    def __init__(self, html: str, known=None, mark: str = ""):
        """``known``: names to tell apart, all if None. ``mark``: an attribute that labels what is wanted."""
        self.html, self.known, self.mark = html, known, mark
        self.open: list[tuple] = []  # (tag, names, is a block, number, what its mark adds)
        self.blocks_open: list[int] = []  # places of block elements in ``open``
        self.inline: list[dict[str, int]] = [{}]  # open inline elements inside each open block
        self.counts: dict[str, int] = {}
        self.marks: list[int] = []
        self.names: dict[str, int] = {}
        self.around: tuple | None = ()
        self.links = self.wanted = self.number = self.linked = 0
        self.parts: list[str] = []
        self.out: list[Block] = []

    def scan(self) -> list[Block]:
        html, at, n = self.html, 0, len(self.html)
        unclosed: set[str] = set()
        while at < n:
            sign = html.find("<", at)
            if sign < 0:
                self._text(at, n)
                break
            if sign > at:
                self._text(at, sign)
            after = html[sign + 1 : sign + 2]
            if html.startswith("<!--", sign):
                end = html.find("-->", sign + 4)
                at = n if end < 0 else end + 3
                continue
            if after in ("!", "?") and after:
                end = html.find(">", sign)
                at = n if end < 0 else end + 1
                continue
            closing = after == "/"
            name = NAME.match(html, sign + 1 + closing)
            if not name:
                if closing and html[sign + 2 : sign + 3]:
                    end = html.find(">", sign)
                    at = n if end < 0 else end + 1
                else:
                    self._text(sign, sign + 1)
                    at = sign + 1
                continue
            end = self._tag_end(name.end(), unclosed)
            tag = name[0].lower()
            at = min(end + 1, n)
            if closing:
                self._close(tag)
            elif tag in HIDDEN_TAGS:
                if html[end - 1 : end] != "/" or tag in ("script", "style", "title", "textarea"):
                    at = self._past(tag, at, unclosed)
            else:
                self._start(tag, html[name.end() : end])
        self._flush()
        return self.out

    def _tag_end(self, at: int, unclosed: set[str]) -> int:
        """The place of the > that ends a tag; one inside a quoted value does not."""
        html, n = self.html, len(self.html)
        start = at
        while True:
            m = TAG_END.search(html, at)
            if not m:
                return n
            if m[0] == ">":
                return m.start()
            at = m.end()
            if html[max(start, m.start() - 64) : m.start()].rstrip()[-1:] == "=":
                if m[0] in unclosed:
                    continue
                quote = html.find(m[0], at)
                if quote < 0:
                    unclosed.add(m[0])
                else:
                    at = quote + 1

    def _past(self, tag: str, at: int, unclosed: set[str]) -> int:
        """Behind the end tag of an element whose content is not shown."""
        if tag in unclosed:
            return len(self.html)
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(self.html, at)
        if m:
            return m.end()
        unclosed.add(tag)
        return len(self.html)

    def _text(self, start: int, end: int) -> None:
        part = self.html[start:end]
        if "&" in part:
            part = unescape(part)
        if self.links:
            self.linked += len(part)
        self.parts.append(part)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                if self.around is None:
                    self.around = tuple(self.names)
                block = self.open[self.blocks_open[-1]] if self.blocks_open else ("", (), True, -1, 0)
                container, outer = self._holder(2), self._holder(3)
                self.out.append(Block(text, block[0], self.around, min(self.linked, len(text)), container, outer, self.wanted > 0))
            self.parts = []
        self.linked = 0

    def _holder(self, up: int) -> int:
        """The number of the block element so many steps up, -1 for the body and beyond."""
        if up > len(self.blocks_open):
            return -1
        tag, _, _, number, _ = self.open[self.blocks_open[-up]]
        return -1 if tag in ("body", "html") else number

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        block = tag in BLOCK_TAGS
        if block:
            self._flush()
            if tag not in IN_PARAGRAPH and self.blocks_open and self.open[self.blocks_open[-1]][0] == "p":
                self._pop_to(self.blocks_open[-1])
            if tag in ENDS:
                ended, stops = ENDS[tag]
                while self.marks and self.open[self.marks[-1]][0] in ended:
                    self._pop_to(self.marks[-1])
        if tag in VOID_TAGS:
            return
        names = {f"<{tag}"} if block else set()
        if attributes and (block or "class" in attributes or "id" in attributes):
            names |= tokens(attributes)
        if self.known is not None:
            names &= self.known
        self.number += 1
        # What a marked element says no to, it says for all that is inside.
        marked = 0 if not self.mark or self.mark not in attributes else 1 if f'{self.mark}="1"' in attributes else -1_000_000
        self.wanted += marked
        place = len(self.open)
        self.open.append((tag, names, block, self.number, marked))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag == "a":
            self.links += 1
        for name in names:
            if not self.names.get(name):
                self.around = None
            self.names[name] = self.names.get(name, 0) + 1
        if block:
            self.blocks_open.append(place)
            self.inline.append({})
            if tag in MARKED:
                self.marks.append(place)
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
            if self.counts.get(tag):
                while self.open[self.blocks_open[-1]][0] != tag:
                    self._pop_to(self.blocks_open[-1])
                self._pop_to(self.blocks_open[-1])
        elif self.inline[-1].get(tag):
            while self.open[-1][0] != tag:
                self._pop_to(len(self.open) - 1)
            self._pop_to(len(self.open) - 1)

    def _pop_to(self, place: int) -> None:
        """Close everything from a place of the stack on."""
        while len(self.open) > place:
            tag, names, block, _, marked = self.open.pop()
            self.counts[tag] -= 1
            self.wanted -= marked
            if tag == "a":
                self.links -= 1
            for name in names:
                self.names[name] -= 1
                if not self.names[name]:
                    del self.names[name]
                    self.around = None
            if block:
                self.blocks_open.pop()
                self.inline.pop()
                if self.marks and self.marks[-1] == len(self.open):
                    self.marks.pop()
            else:
                self.inline[-1][tag] -= 1


def leaf_blocks(html: str | None, known=None, mark: str = "") -> list[Block]:
    return Scanner(html or "", known, mark).scan()
