"""Leaf blocks of HTML pages: runs of text between the borders of block elements, with what stands above them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass, field
from html import unescape

#: Elements that begin and end a block; all others run inside one.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template iframe svg canvas title textarea xmp noembed noframes object audio video".split())
#: Of these, what has no end tag takes the rest of the page.
_TO_THE_END = frozenset("script style textarea title xmp".split())
#: Elements without content.
_VOID = frozenset("hr".split())
#: Elements that hold one block as a rule; the element above them is its container.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption summary option legend button".split())
#: Elements that say something about what is below them.
_CUES = frozenset("address article aside blockquote button details dialog dl fieldset figure footer form header main menu nav ol option pre search section select table ul".split())
#: An open element of the second kind ends where one of the first begins.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
         "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "option": ("option",)}

_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_QUOTE = re.compile(r"=\s*([\"'])")
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?=\s|=|/?$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Block:
    """A leaf block: its text with single spaces, its element, and the names of elements, classes and roles above it."""
    text: str
    tag: str
    cues: frozenset[str]
    near: tuple[str, ...]
    container: int
    linked: float
    part: str = ""


@dataclass
class _Frame:
    tag: str
    cues: frozenset[str]
    near: tuple[str, ...]
    number: int
    part: str = ""


def names(attributes: str, known: Collection[str] | None = None) -> tuple[str, ...]:
    """Words of class, id, role and itemprop in the singular, and "hidden"; with ``known``, only those, taken apart if two of them are run together."""
    found: list[str] = []
    for m in _NAMED.finditer(attributes):
        for part in _PARTS.findall(m[1] or m[2] or m[3] or ""):
            word = _singular(part.lower())
            if known is None or word in known:
                found.append(word)
            else:
                found += next(([a, b] for i in range(2, min(len(word) - 1, 40)) if (a := _singular(word[:i])) in known and (b := _singular(word[i:])) in known), [])
    if _HIDDEN.search(attributes):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 2 and word[-1] == "s" and word[-2] != "s" else word


@dataclass
class _Reader:
    """Walks over the tags of one page; ``known`` bounds the names it keeps, so that what a block carries is bounded too."""
    html: str
    known: Collection[str] | None
    cache: dict[str, tuple[str, ...]]
    parts_of: Mapping[str, str]
    stack: list[_Frame] = field(default_factory=lambda: [_Frame("", frozenset(), (), 0)])
    open: Counter = field(default_factory=Counter)
    gone: set[str] = field(default_factory=set)
    parts: list[str] = field(default_factory=list)
    numbers: int = 0
    linked: int = 0
    link: int | None = None

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` that ends a tag; quoted values may hold that sign, unless the quote is never closed."""
        end = self.html.find(">", at)
        while end >= 0 and (m := _QUOTE.search(self.html, at, end)):
            close = -1 if m[1] in self.gone else self.html.find(m[1], m.end())
            if close < 0:
                self.gone.add(m[1])
                break
            at = close + 1
            if close > end:
                end = self.html.find(">", at)
        return end + 1

    def text(self, run: str) -> None:
        if run:
            run = unescape(run) if "&" in run else run
            self.parts.append(run)
            if self.link is not None:
                self.linked += len(run.strip())

    def flush(self) -> Iterator[Block]:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                container = self.stack[-2] if top.tag in _LEAVES and len(self.stack) > 1 else top
                yield Block(text, top.tag, top.cues, top.near, container.number, min(1.0, self.linked / len(text)), top.part)
            self.parts.clear()
            self.linked = 0

    def push(self, tag: str, attributes: str) -> None:
        top = self.stack[-1]
        if attributes not in self.cache:
            if len(self.cache) > 10_000:
                self.cache.clear()
            self.cache[attributes] = names(attributes, self.known) if attributes.strip("/ ") else ()
        own = [f"c:{name}" for name in self.cache[attributes]]
        if tag in _CUES:
            own.append(f"t:{tag}")
        cues = top.cues if top.cues.issuperset(own) else top.cues.union(own)
        self.numbers += 1
        parts = sorted({self.parts_of[x] for x in own if x in self.parts_of}, key=lambda part: (part == "main", part))
        self.stack.append(_Frame(tag, cues, tuple(f"n:{x}" for x in own) or top.near, self.numbers, parts[0] if parts else top.part))
        self.open[tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        if self.link is not None and self.link > len(self.stack):
            self.link = None
        return tag

    def start(self, tag: str, attributes: str) -> Iterator[Block]:
        if tag in BLOCKS:
            yield from self.flush()
            if self.stack[-1].tag == "p":
                self.pop()
            for ended in _ENDS.get(tag, ()):
                if self.stack[-1].tag == ended:
                    self.pop()
            if tag not in _VOID:
                self.push(tag, attributes)
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = len(self.stack)

    def end(self, tag: str) -> Iterator[Block]:
        if tag in BLOCKS:
            yield from self.flush()
            if self.open[tag]:
                while self.pop() != tag:
                    pass
        elif tag == "a":
            self.link = None
        elif tag == "br":
            self.parts.append(" ")

    def blocks(self) -> Iterator[Block]:
        html, at = self.html, 0
        while m := _MARKUP.search(html, at):
            self.text(html[at:m.start()])
            kind = m[0]
            if kind == "<!--":
                end = html.find("-->", m.start() + 2)
                at = end + 3 if end >= 0 else len(html)
                continue
            end = self.tag_end(m.start())
            if not end:
                at = len(html)
                break
            at = end
            if kind in ("<!", "<?"):
                continue
            closing = kind[1] == "/"
            name = _NAME.match(html, m.start() + 1 + closing)
            tag = name[0].lower()
            if closing:
                yield from self.end(tag)
            elif tag in DROPPED:
                after = None if tag in self.gone or html[end - 2] == "/" and tag not in _TO_THE_END else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, end)
                if after:
                    at = self.tag_end(after.start()) or len(html)
                elif tag in _TO_THE_END:
                    at = len(html)
                elif html[end - 2] != "/":
                    self.gone.add(tag)
            else:
                yield from self.start(tag, html[name.end():end - 1])
        self.text(html[at:])
        yield from self.flush()


def leaf_blocks(html: str, known: Collection[str] | None = None, cache: dict[str, tuple[str, ...]] | None = None, parts: Mapping[str, str] = {}) -> list[Block]:
    """The leaf blocks of a page in page order. ``parts``: of what part of a page a name ("c:") or element ("t:") speaks; the innermost counts, "main" least.

    Tags need not be closed or nested well; comments, scripts, styles and the
    like hold no text. Character references are decoded in each run of text,
    white space (as of ``str.split``) becomes single spaces, ``<br>`` is one.
    Work and memory follow the length of the page, however deep its elements.
    """
    return list(_Reader(html, known, {} if cache is None else cache, parts).blocks())
