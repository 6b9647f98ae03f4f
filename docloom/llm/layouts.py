"""Labelled pages to learn extraction from: texts of marked pages put into other layouts."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import replace
from html import escape

from docloom.llm.dom import Block, leaf_blocks, names

#: Signs in front of a text that tell its label; they are taken off again before anything is learned.
_MARKS = ("\ue000", "\ue001")
#: What elements of each part of a page are called.
_NAMES = {
    "main": "content main-content post-content entry-content article-body story article post entry story-body page-content post-body text body-text articleBody blog-post news-text",
    "menu": "nav menu navbar navigation main-menu nav-links breadcrumbs breadcrumb topnav tabs pagination pager toolbar site-nav skip-links toc-menu dropdown",
    "header": "header site-header masthead top-bar banner page-header branding logo topbar head",
    "footer": "footer site-footer page-footer bottom copyright colophon legal credits footer-links imprint",
    "side": "sidebar side-bar aside widget widget-area right-column rail secondary related related-posts recommended trending popular most-read more-stories teaser archive tag-cloud categories author-box",
    "notice": "notice cookie-notice cookie-banner consent gdpr alert message popup modal overlay announcement warning paywall disclaimer toast info-bar",
    "advert": "ad ads advert advertisement ad-slot ad-container banner-ad sponsored sponsor promo promotion adsbygoogle promoted commercial partner-content",
    "form": "form search search-form login newsletter newsletter-signup subscribe signup contact-form register feedback poll",
    "comments": "comments comment-list reader-comments discussion responses replies respond comment thread disqus user-comments reactions",
    "share": "share social share-buttons social-links follow-us sharing tools print-links",
}
_PLAIN = "wrapper container row col inner box section block page layout wrap column grid clearfix outer area".split()
#: All words of these names.
CLASSES = frozenset(w for x in [*_NAMES.values(), " ".join(_PLAIN), "hidden navigation main complementary contentinfo banner search alert dialog"] for w in names(f'class="{x}"'))
_OF = {part: {w for w in names(f'class="{x}"')} for part, x in _NAMES.items()}
#: The part of a page that a name ("c:") or an element ("t:") speaks of, if it is one.
PARTS = {f"c:{w}": part for part, own in _OF.items() for w in own if w not in _PLAIN and sum(w in x for x in _OF.values()) == 1} | {
    **dict.fromkeys(("t:article", "t:main", "c:content", "c:post", "c:entry", "c:article", "c:story"), "main"),
    "t:nav": "menu", "t:header": "header", "t:footer": "footer", "t:aside": "side", "t:form": "form", "t:dialog": "notice", "c:navigation": "menu", "c:contentinfo": "footer", "c:complementary": "side"}
_ROLES = {"main": "main", "menu": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "notice": "alert", "form": "search"}
_TAGS = {"main": ["article", "main", "section", "div"], "menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"],
         "notice": ["div", "dialog", "section", "aside"], "advert": ["div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div"], "share": ["div", "section"]}


def labels_of(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page that marks its main text by ``article`` or ``main``, and whether each is below such a mark."""
    page = leaf_blocks(html, parts=PARTS)
    mark = "t:article" if any("t:article" in b.cues for b in page) else "t:main"
    return page, [int(mark in b.cues) for b in page]


def invented(rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of made-up words, for tables in which no page marks its main text."""
    words = ["".join(rng.choice("bdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(4, 25))).capitalize() + "."
    texts = [" ".join(rng.choices(words, k=rng.randint(2, 9))).capitalize()] + [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12]))]
    if rng.random() < .4:
        texts.append(rng.choice(["", texts[0] + " "]) + " ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice(["", ".", "!!!", "***"]))
    rest = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(8)] + [sentence() for _ in range(4)]
    return [Block(t, "p", frozenset(), (), 0, 0.0) for t in texts + rest], [1] * len(texts) + [0] * len(rest)


class _Layout:
    """Writes one page with labelled texts; ``bare``: without class names, ``nameless``: with elements of no meaning too."""

    def __init__(self, main: Sequence[str], rest: Sequence[str], rng: random.Random, semantic: bool, bare: bool):
        self.main, self.rng, self.semantic, self.bare = main, rng, semantic, bare
        self.short = [t for t in rest if t.count(" ") < 4] or ["menu", "home"]
        self.long = [*(t for t in rest if t.count(" ") >= 4), *main[1:]] or list(main) or ["more"]

    def text(self, value: str, label: int) -> str:
        return _MARKS[label] + escape(value, quote=False)

    def open(self, part: str) -> tuple[str, str]:
        rng = self.rng
        tag = rng.choice(_TAGS[part] if self.semantic or part == "form" else ["div"])
        if part == "form" and rng.random() < .6:
            tag = "form"
        attributes = ""
        if not self.bare or tag in ("div", "section"):
            attributes += f' {rng.choice(["class", "class", "id"])}="{" ".join(dict.fromkeys([rng.choice(_NAMES[part].split()), *rng.sample(_PLAIN, rng.randint(0, 1))]))}"'
        if part in _ROLES and rng.random() < .15:
            attributes += f' role="{_ROLES[part]}"'
        return f"<{tag}{attributes}>", f"</{tag}>"

    def within(self, part: str, inner: str) -> str:
        begin, end = self.open(part)
        if self.rng.random() < .3:
            begin, end = f'{begin}<div class="{self.rng.choice(_PLAIN)}">', f"</div>{end}"
        return begin + inner + end

    def links(self, n: int) -> str:
        rng = self.rng
        made = [f'<a href="/{i}">{self.text(rng.choice(self.short if rng.random() < .8 else self.long), 0)}</a>' for i in range(n)]
        style = rng.random()
        if style < .6:
            return "<ul>" + "".join(f"<li>{a}</li>" if rng.random() < .9 else f"<li>{a}" for a in made) + "</ul>"
        return " | ".join(made) if style < .8 else "".join(f"<p>{a}</p>" for a in made)

    def said(self) -> str:
        return self.text(self.rng.choice(self.long if self.rng.random() < .7 else self.short), 0)

    def paragraphs(self, n: int) -> str:
        rng = self.rng
        return "".join(f"<p>{self.said()}</p>" if rng.random() < .7 else f"<div>{self.said()}</div>" if rng.random() < .5 else self.said() + "<br>" for _ in range(n))

    def part(self, part: str) -> str:
        rng = self.rng
        heading = f"<h{(k := rng.randint(2, 4))}>{self.text(rng.choice(self.short), 0)}</h{k}>" if rng.random() < .5 else ""
        if part == "menu":
            inner = self.links(rng.randint(2, 9))
        elif part == "header":
            inner = (f"<a href='/'>{self.text(rng.choice(self.short), 0)}</a>" if rng.random() < .6 else "") + (f"<h1>{self.text(rng.choice(self.short), 0)}</h1>" if rng.random() < .3 else "") + (self.paragraphs(1) if rng.random() < .4 else "") + (self.part("menu") if rng.random() < .4 else "") + self.text("site", 0)
        elif part == "footer":
            inner = rng.choice(["", self.links(3)]) + rng.choice([f"<p>{self.text('© 2020', 0)} {escape(rng.choice(self.long))}</p>", self.text("© ", 0) + escape(rng.choice(self.long)), self.paragraphs(1)])
        elif part == "side":
            inner = heading + rng.choice([self.links(rng.randint(2, 6)), self.paragraphs(rng.randint(1, 3)), self.links(3) + self.paragraphs(1)])
        elif part == "form":
            inner = heading + f'<label for="q">{self.text(rng.choice(self.short), 0)}</label><input name="q" value="v">' + rng.choice(["", self.paragraphs(1)]) + rng.choice(["", f"<select><option>{self.said()}<option>{self.said()}</select>"]) + f"<button>{self.text(rng.choice(self.short), 0)}</button>"
        elif part == "comments":
            tag, inside = rng.choice([("li", "p"), ("div", "p"), ("article", "p"), ("div", "div"), ("p", "span")]), ""
            for _ in range(rng.randint(1, 4)):
                inside += f'<{tag[0]}{rng.choice(["", f" class={chr(34)}comment{chr(34)}"])}><{tag[1]}>{self.text(rng.choice(self.short), 0)} {self.rng.randint(1, 28)}</{tag[1]}>' + "".join(f"<{tag[1]}>{self.said()}</{tag[1]}>" for _ in range(rng.randint(1, 2))) + f"</{tag[0]}>"
            inner = heading + (f"<ol>{inside}</ol>" if tag[0] == "li" else inside) + (self.part("form") if rng.random() < .3 else "")
        elif part == "share":
            inner = self.links(rng.randint(1, 4))
        else:  # notices and adverts
            inner = heading + rng.choice([self.said(), self.paragraphs(rng.randint(1, 2)), self.paragraphs(1) + f"<button>{self.text(rng.choice(self.short), 0)}</button>", f'<a href="#">{self.said()}</a>'])
        return self.within(part, inner)

    def body(self) -> str:
        """The main text, with other parts between its paragraphs at times."""
        rng, out = self.rng, []
        for i, t in enumerate(self.main):
            marked = self.text(t, 1)
            style = rng.random()
            if not i and style < .7:
                out.append(f"<h1>{marked}</h1>")
            elif t.count(" ") < 10 and style < .3:
                out.append(f"<h2>{marked}</h2>")
            elif style < .06:
                cut = t.find(" ", len(t) // 2)
                out.append(f"<ul><li>{marked}</li></ul>" if cut < 0 else f"<ul><li>{self.text(t[:cut], 1)}</li><li>{self.text(t[cut + 1:], 1)}</li></ul>")
            elif style < .1:
                out.append(f"<blockquote>{marked}</blockquote>")
            elif style < .13:
                out.append(f"<table><tr><td>{marked}</td></tr></table>")
            elif style < .16:
                out.append(f"<figure><img src='x'><figcaption>{marked}</figcaption></figure>")
            elif style < .19:
                out.append(f"<pre>{marked}</pre>")
            elif style < .28:
                out.append(f"{marked}<br><br>")
            elif style < .36:
                out.append(f"<div>{marked}</div>")
            elif style < .45:
                out.append(f"<p><a href='#'>{marked[:12]}</a>{marked[12:]}")
            elif style < .55:
                out.append(f"<p><b>{marked}<br>")
            else:
                out.append(f"<p>{marked}</p>")
            if rng.random() < .15:
                out.append(self.part(rng.choice(["advert", "side", "form", "share", "notice"])))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        begin, end = self.open("main")
        if self.semantic and rng.random() < .3:
            begin, end = f"<main>{begin}", f"{end}</main>"
        for _ in range(rng.randint(0, 2)):
            begin, end = f'<div class="{rng.choice(_PLAIN)}">{begin}', f"{end}</div>"
        comments = self.part("comments") if rng.random() < .4 else ""
        inside = rng.random() < .5
        core = begin + self.body() + (self.part("share") if rng.random() < .2 else "") + (comments if inside else "") + end + ("" if inside else comments)
        if rng.random() < .1:
            return core
        ahead = [self.part(p) for p in ("notice", "header", "menu", "advert", "form", "side") if rng.random() < (.6 if p in ("header", "menu") else .3)]
        after = [self.part(p) for p in ("side", "advert", "share", "form", "notice", "footer") if rng.random() < (.75 if p == "footer" else .35)]
        rng.shuffle(ahead)
        return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(ahead) + core + "".join(after) + ("</body></html>" if rng.random() < .8 else "")


def labelled_copies(main: Sequence[str], rest: Sequence[str], rng: random.Random) -> list[tuple[list[Block], list[int]]]:
    """The texts of a page in three other layouts: with elements of meaning and class names, with either alone."""
    out = []
    for semantic, bare in ((True, False), (False, False), (True, True)):
        shown = main[1:] if len(main) > 1 and rng.random() < .2 else main
        page = leaf_blocks(_Layout(shown, rest, rng, semantic, bare).page(), parts=PARTS)
        labels = [int(_MARKS[1] in b.text) for b in page]
        out.append(([replace(b, text=b.text.replace(_MARKS[0], "").replace(_MARKS[1], "") or "x") for b in page], labels))
    return out
