"""A small Markdown to HTML renderer for the flattened text of Markdown files.

Covers the core rules: headings, lists, paragraphs, block quotes, rules,
indented code, emphasis, code spans, links, images, automatic links, backslash
escapes and entities, links and images by label with their definitions, and
lets raw HTML through. Fences are code spans and
tables are text, as they are without extensions of the core rules.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CODE = re.compile(r"(?<![\\`])(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_ESCAPED = re.compile(r"\\([\\`*_{}\[\]()>#+\-.!])")
_LINK = re.compile(r"<((?:https?|ftp)://[^<>]*)>", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>@ ]*(?: [^<>]*)?|!--.*?--)>", re.S)
_BARE_AMPERSAND = re.compile(r"&(?!(?:#[0-9]+|#x[0-9a-f]+|[0-9a-z]+);)", re.I)
#: A definition of a link: its label; what follows is the address and perhaps a title.
_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]]+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|\S+)(?:[ \t]*\n?[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$\n?", re.M)
#: An image or link by label: its text, and its label if that is another.
_REFERENCE = re.compile(r"(!?)\[([^\[\]]*)\](?:[ ]?\n?\[([^\[\]]*)\])?(?![(:])")
_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), lambda m: f'<img alt="{m[1]}">'),
    (re.compile(r"\[([^\]]*)\]\([^)]*\)"), lambda m: f"<a>{m[1]}</a>"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S), lambda m: f"<strong>{m[2]}</strong>"),
    (re.compile(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", re.S), lambda m: f"<em>{m[2]}</em>"),
)


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _referred(text: str, labels: frozenset[str]) -> str:
    """Links and images by the labels that the document defines; other brackets stay."""
    def put(m: re.Match) -> str:
        if _label(m[3] or m[2]) not in labels:
            return m[0]
        return f'<img alt="{m[2]}">' if m[1] else f"<a>{m[2]}</a>"
    return _REFERENCE.sub(put, text) if labels else text


def _inline(text: str, labels: frozenset[str] = frozenset()) -> str:
    """Inline markup of a run of lines; what must not be read again is kept aside."""
    kept: list[str] = []

    def keep(made: str) -> str:
        kept.append(made)
        return f"\x02{len(kept) - 1}\x03"

    text = _CODE.sub(lambda m: keep(f"<code>{html.escape(m[2].strip(), quote=False)}</code>"), text)
    text = _ESCAPED.sub(lambda m: keep(html.escape(m[1], quote=False)), text)
    text = _LINK.sub(lambda m: keep(f"<a>{html.escape(m[1], quote=False)}</a>"), text)
    text = _TAG.sub(lambda m: keep(m[0]), text)
    text = _BARE_AMPERSAND.sub("&amp;", text).replace("<", "&lt;").replace(">", "&gt;")
    for n, (pattern, put) in enumerate(_INLINE):
        text = _referred(text, labels) if n == 2 else text
        text = pattern.sub(put, text)
    while "\x02" in text:
        text = re.sub(r"\x02(\d+)\x03", lambda m: kept[int(m[1])], text)
    return text


def to_html(source: str) -> str:
    out: list[str] = []
    source = source.replace("\x02", "").replace("\x03", "")
    labels = frozenset(_label(m[1]) for m in _DEFINITION.finditer(source))
    for block in re.split(r"\n\s*\n", _DEFINITION.sub("", source) if labels else source):
        lines = block.strip("\n").split("\n")
        if all(x.startswith("    ") for x in lines):
            out.append("<pre><code>" + html.escape("\n".join(x[4:] for x in lines), quote=False) + "\n</code></pre>")
            continue
        done, open_ = [], []

        def close(done=done, open_=open_):
            if open_:
                done.append(_inline("\n".join(open_), labels))
                open_.clear()

        for line in lines:
            bare = re.sub(r"^\s*(?:>\s?)+", "", line)
            if re.fullmatch(r"(?:=+|-+)[ ]*", bare) and len(open_) == 1:
                done.append(f"<h{1 if bare[0] == '=' else 2}>{_inline(open_.pop(), labels)}</h{1 if bare[0] == '=' else 2}>")
            elif re.fullmatch(r"\s*(?:[-*_]\s*){3,}", bare):
                close()
                done.append("<hr>")
            elif m := re.match(r"(#{1,6})\s*(.*?)\s*#*\s*$", bare):
                close()
                done.append(f"<h{len(m[1])}>{_inline(m[2], labels)}</h{len(m[1])}>")
            elif m := re.match(r"\s*(?:[-*+]|\d+\.)\s+(.*)$", bare):
                close()
                done.append(f"<li>{_inline(m[1], labels)}</li>")
            else:
                open_.append(bare)
        close()
        out.append("\n".join(done))
    return "\n".join(out)


@F.pandas_udf(StringType())
def _render(texts: pd.Series) -> pd.Series:
    return texts.map(to_html, na_action="ignore")


def render_html(text: Column) -> Column:
    return _render(text)
