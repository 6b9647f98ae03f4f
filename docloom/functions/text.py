"""Text normalisation and small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace() has it: Unicode white space and the four ASCII separators.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NOT_SPACE = r"[^\p{IsWhite_Space}\x1c-\x1f]"
#: The characters of SPACE.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Element types by layout label; labels that carry no text are dropped, all others are "other".
ELEMENT_TYPES = {
    "title": "title",
    "section_header": "heading",
    "text": "paragraph",
    "paragraph": "paragraph",
    "list_item": "list_item",
    "table": "table",
    "caption": "caption",
    "code": "code",
}
DROPPED_LABELS = ("picture", "page", "document_index")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_plain(text: Column) -> Column:
    """Unix line ends, no blanks before a line end, at most one blank line, no outer white space."""
    lines = F.regexp_replace(unix_lines(text), r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def flatten_html(html: Column) -> Column:
    """Tags taken out, at most one blank line, no outer white space; entities stay as they are."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"\n{3,}", "\n\n"))


def first_heading(markdown: Column) -> Column:
    """Text of the first level-1 heading without a trailing {anchor}; null without one."""
    line = F.regexp_extract(markdown, r"(?dm)^#[\s\x1c-\x1f]+(.+)$", 1)
    return F.nullif(strip(F.regexp_replace(strip(line), r"(?s)(?<=.)\{[^}]*\}\z", "")), F.lit(""))


def preview(text: Column, limit: int = 80) -> Column:
    """White space collapsed; cut to ``limit`` characters with an ellipsis as the last."""
    flat = F.array_join(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != ""), " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, max(0, limit - 1)), F.lit("…"))).otherwise(flat)


def has_word_character(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space."""
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def element_type(label: Column) -> Column:
    """Element type of a layout label; null for dropped and blank labels."""
    known = F.create_map(*[F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair])
    name = F.lower(label)
    return F.when(name.isNull() | (strip(name) == "") | name.isin(*DROPPED_LABELS), F.lit(None).cast("string")).otherwise(F.coalesce(known[name], F.lit("other")))
