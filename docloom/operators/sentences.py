"""Sentences and units of a text, without a shuffle; the white space between them is kept as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import NOT_SPACE, SPACE, SPACES, strip, word_count

# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("dr.", "e.g.", "etc.", "fig.", "i.e.", "jr.", "mr.", "mrs.", "ms.", "no.", "prof.", "sr.", "st.", "u.s.", "vs.")
ATOMIC_TYPES = ("title", "heading", "table", "caption", "code")
_CLOSING = r"""["'’”)\]}]"""

#: A noncharacter that marks the cuts, and others that stand for it in a text that holds it.
_CUT = "\ufdd0"
_ESCAPE, _OF_ESCAPE, _OF_CUT = "\ufdd1", "\ufdd1\ufdd2", "\ufdd1\ufdd3"
_BEHIND = rf"{_CLOSING}*+(?={SPACE}|\z)"
#: An abbreviation or a single letter without its full stop, not in a longer run of letters and dots but for ``dots`` in front of it.
_SHORT = lambda dots: rf"(?<![A-Za-z.])\.{dots}(?:(?i:{'|'.join(a[:-1].replace('.', '[.]') for a in ABBREVIATIONS)})|[A-Za-z])"
#: How many dots in front of an abbreviation a look back can pass; texts with longer runs of dots take two passes.
_DOTS = 7
#: Terminator and closing punctuation before white space or the end, unless it is the full stop of an abbreviation.
_TRUE_END = rf"(?:[!?]|\.(?<!{_SHORT(f'{{0,{_DOTS}}}')}\.)){_BEHIND}"
#: The same of any word, and an abbreviation with the mark behind it.
_END = rf"[.!?]{_BEHIND}"
_NO_END = rf"({_SHORT('*')}\.{_CLOSING}*+){_CUT}"
_SPACE_IN_LINE = rf"[{SPACE[1:-1]}&&[^\n]]"
#: White space that holds a blank line; what can be no white space is told by the one range.
_BLANK = rf"(?=[^\x21-\x7e])(?<!{SPACE})(?:{_SPACE_IN_LINE}*+\n){{2,}}{SPACE}*+"


def spaced_sentences(text: Column) -> Column:
    """array<struct<gap, text>>: the trimmed sentences and the white space in front of each; empty for a blank or null text.

    A sentence ends with a terminator and closing punctuation before white
    space, but not with the full stop of a known abbreviation or a single
    letter, and at a blank line. Two passes over the text mark these places;
    what is between two marks begins with its gap and ends with no white space.
    """
    plain = F.coalesce(text, F.lit(""))
    hidden = F.replace(F.replace(plain, F.lit(_ESCAPE), F.lit(_OF_ESCAPE)), F.lit(_CUT), F.lit(_OF_CUT))
    shown = lambda s: F.replace(F.replace(s, F.lit(_OF_CUT), F.lit(_CUT)), F.lit(_OF_ESCAPE), F.lit(_ESCAPE))
    kept = F.transform(_cut(hidden), lambda s: F.struct(s["gap"], shown(s["text"]).alias("text")))
    return F.when(plain.rlike(f"[{_CUT}{_ESCAPE}]"), kept).otherwise(_cut(plain))


def _cut(text: Column) -> Column:
    far = lambda t: F.regexp_replace(F.regexp_replace(t, _END, f"$0{_CUT}"), _NO_END, "$1")
    marked = lambda t: F.when(t.contains("." * (_DOTS + 1)), far(t)).otherwise(F.regexp_replace(t, _TRUE_END, f"$0{_CUT}"))
    ended = F.array(F.rtrim(text, F.lit(SPACES)))
    pieces = F.transform(ended, lambda t: F.split(F.regexp_replace(marked(t), _BLANK, f"{_CUT}$0"), _CUT))[0]
    gap = lambda p, t: F.left(p, F.length(p) - F.length(t))
    both = F.transform(pieces, lambda p: F.struct(p.alias("all"), F.ltrim(p, F.lit(SPACES)).alias("text")))
    return F.transform(F.filter(both, lambda s: s["text"] != ""), lambda s: F.struct(gap(s["all"], s["text"]).alias("gap"), s["text"].alias("text")))


def sentences(text: Column) -> Column:
    """array<string>: the trimmed sentences of a text."""
    return F.transform(spaced_sentences(text), lambda s: s["text"])


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, sentence), one row per sentence, counted from 0."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "sentence"))


def units(elements: DataFrame) -> DataFrame:
    """Units of each document: atomic elements whole, other elements by sentence, numbered in reading order.

    Input: (document_id, elements: array<struct<element_id, element_type, text,
    heading_path, page_number, order>>). Output adds ``units``, an array of
    structs. A unit's separator is the text between it and the unit before
    inside an element, and a blank line between elements. Documents stay one row
    each, so nothing is shuffled.
    """
    whole = lambda t: F.filter(F.array(F.struct(F.lit("").alias("gap"), strip(t).alias("text"))), lambda s: s["text"] != "")
    texts = lambda e: F.when(e["element_type"].isin(*ATOMIC_TYPES), whole(e["text"])).otherwise(spaced_sentences(e["text"]))
    ordered = F.array_sort("elements", lambda a, b: a["order"] - b["order"])
    made = F.flatten(F.transform(ordered, lambda e: F.transform(texts(e), lambda s, i: F.struct(
        s["text"].alias("text"), F.when(i == 0, "\n\n").otherwise(s["gap"]).alias("separator"), e["element_id"].alias("element_id"), e["order"].alias("element_order"),
        e["element_type"].alias("element_type"), e["heading_path"].alias("heading_path"), e["page_number"].alias("page_number"), F.lit(False).alias("forced")))))
    return elements.withColumn("units", made)


def cut_oversized(unit: Column, most: int) -> Column:
    """A unit of more than ``most`` words as an array of units of at most ``most`` words, marked as forced; the gaps between them are separators."""
    pieces = F.regexp_extract_all(unit["text"], F.lit(rf"(?:{NOT_SPACE}++{SPACE}*+){{1,{most}}}+"), F.lit(0))
    gap = lambda p: F.regexp_extract(p, rf"(?<!{SPACE}){SPACE}*+\z", 0)
    same = [unit[n].alias(n) for n in ("element_id", "element_order", "element_type", "heading_path", "page_number")]
    cut = F.transform(F.array(pieces), lambda ps: F.transform(ps, lambda p, i: F.struct(
        strip(p).alias("text"), F.when(i == 0, unit["separator"]).otherwise(gap(F.get(ps, i - 1))).alias("separator"), *same, F.lit(True).alias("forced"))))[0]
    # words are counted where there is room for so many
    return F.when((F.length(unit["text"]) > 2 * most) & (word_count(unit["text"]) > most), cut).otherwise(F.array(unit))


def split_oversized(most: int) -> Column:
    """The units of the column ``units``, those of more than ``most`` words cut (see cut_oversized)."""
    return F.flatten(F.transform("units", lambda u: cut_oversized(u, most)))
