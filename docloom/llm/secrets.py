"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in their listed order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of one character class is matched whole, so a least length inside the
# pattern finds exactly the runs of at least that length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters in an entropy window; a candidate has at least as many.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Entropy (bits a character) from which a window counts, by the character class that holds it: hexadecimal, letters
#: and digits, all of a candidate's characters; stricter without a letter and without a digit, as numbers and words are.
HEXADECIMAL, ALPHANUMERIC, ANY, NO_LETTER, NO_DIGIT = 3.0, 3.8, 3.9, 3.2, 4.0
#: Allow-list: UUIDs, and what lies between two of "=", "/", "_" and "-" with a sample's name or a filler in it.
UUID = r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
PIECES = r"[A-Za-z0-9+]+|[=/_,-]+"
ALLOW = r"(?i:example|sample|placeholder|dummy|xxxx|abcdefgh|01234567)"
#: What allowed characters are replaced by; no window counts that holds it.
ALLOWED = ","

_MARK = "\u0001"
_SCALE = 1_000_000
#: Parts of a text that are put into one array at a time.
_PARTS = 256
#: Counts of a window's characters lie twelve to a long; the codes of candidates are from 43 to 122.
_FIRST, _SLOT, _BITS = 43, 12, 5


def _terms() -> list[int]:
    """c * log2(c) for counts 0 to WINDOW, scaled to integers so that sums are exact in any order."""
    return [round(_SCALE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def _most(bits: float) -> int:
    """The largest sum of c * log2(c) over a window whose entropy is at least ``bits``."""
    return math.floor(_SCALE * WINDOW * (math.log2(WINDOW) - bits))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, value>> (code points).

    The text is cut at marks put around each match; a mark that is already in
    the text is first replaced by another control character, which no pattern
    here can match and which keeps every position. Arrays grow by copies, so
    the parts go through small arrays, and the work stays in proportion to the text.
    """
    parts = F.split(F.regexp_replace(F.translate(text, _MARK, "\u0002"), pattern, f"{_MARK}$0{_MARK}"), _MARK)
    found = "array<struct<start:int,end:int,value:string>>"

    def step(acc, part):
        at, odd, out = acc["at"], acc["odd"], acc["out"]
        end = at + F.length(part)
        hit = F.array(F.struct(at.alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~odd).alias("odd"), F.when(odd, F.concat(out, hit)).otherwise(out).alias("out"))

    def some(acc, few):
        begin = F.struct(acc["at"].alias("at"), F.lit(False).alias("odd"), F.array().cast(found).alias("out"))
        # a lambda's argument is bound once
        return F.transform(F.array(F.aggregate(few, begin, step)), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    def folded(p):
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _PARTS).cast("int")), lambda g: F.slice(p, g * _PARTS + 1, _PARTS))
        return F.flatten(F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{found}>").alias("out")), some)["out"])

    return F.when(text.rlike(pattern), F.transform(F.array(parts), folded)[0]).otherwise(F.array().cast(found))


def _masked(value: Column) -> Column:
    """The candidate with every allowed character replaced."""
    cut = F.split(F.regexp_replace(value, UUID, f"{_MARK}$0{_MARK}"), _MARK)
    value = F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(ALLOWED), F.length(p))).otherwise(p)), "")
    pieces = F.regexp_extract_all(value, F.lit(PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(ALLOW), F.repeat(F.lit(ALLOWED), F.length(p))).otherwise(p)), "")


def _kind(code: int) -> int:
    """Six bits each: whether the character is allowed, not hexadecimal, a sign, a digit, a letter."""
    c = chr(code)
    sound = c.isalnum() or c in "+/=_-"
    of = (not sound, c not in "0123456789abcdefABCDEF", sound and not c.isalnum(), c.isdigit(), c.isalpha())
    return sum(int(x) << 6 * i for i, x in enumerate(of))


def _bounds(window: Column) -> Column:
    """Whether a window of this sum of c * log2(c) and these kinds counts."""
    of = lambda i: F.shiftright(window["kinds"], 6 * i).bitwiseAND(F.lit(63))
    most = F.when(of(0) > 0, -1)
    for holds, bits in ((of(4) == 0, NO_LETTER), (of(3) == 0, NO_DIGIT), (of(1) == 0, HEXADECIMAL), (of(2) == 0, ALPHANUMERIC)):
        most = most.when(holds, _most(bits))
    return (window["n"] >= WINDOW) & (window["sum"] <= most.otherwise(_most(ANY)))


def _windows(value: Column) -> Column:
    """struct<first, last>: starts of the first and the last window of ``value`` that counts; null without one.

    The counts of the characters in the window are carried along: a step takes
    one character in and one out, and the sum changes by the differences of
    their two terms only.
    """
    terms = _terms()
    grows = F.array(*[F.lit(t - f).cast("long") for f, t in zip([0, *terms], terms)])  # by the count that is reached
    kinds = F.array(*[F.lit(_kind(i)).cast("long") for i in range(128)])
    codes = F.transform(F.split(value, ""), F.ascii)
    slot = lambda c: F.floor((c - _FIRST) / _SLOT).cast("int")
    shift = lambda c: (c - _FIRST) % _SLOT * _BITS
    facts = F.transform(codes, lambda c: F.struct(slot(c).alias("slot"), shift(c).alias("shift"), F.element_at(kinds, c + 1).alias("kinds")))
    pairs = lambda f: F.transform(f, lambda x, i: F.struct(x.alias("come"), F.try_element_at(f, F.when(i >= WINDOW, i - WINDOW + 1)).alias("go")))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])

    def after(acc):
        """The marks of the window that ends here, taken before the next step moves it on."""
        counts = _bounds(acc)
        start = acc["n"] - WINDOW
        return (F.when(acc["first"] >= 0, acc["first"]).when(counts, start).otherwise(-1).alias("first"), F.when(counts, start).otherwise(acc["last"]).alias("last"))

    def step(acc, pair):
        come, go = pair["come"], pair["go"]
        held = lambda x: F.call_function("shiftright", F.element_at(acc["counts"], x["slot"] + 1), x["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
        same = (come["slot"] == go["slot"]) & (come["shift"] == go["shift"])
        total = acc["sum"] - F.when(go.isNotNull(), F.element_at(grows, held(go) + 1)).otherwise(0)
        total = total + F.element_at(grows, held(come) + 2 - F.when(same, 1).otherwise(0))
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == come["slot"], one(come)).otherwise(0) - F.when(j == go["slot"], one(go)).otherwise(0))
        return F.struct(
            counts.alias("counts"), total.alias("sum"), (acc["kinds"] + come["kinds"] - F.coalesce(go["kinds"], F.lit(0))).alias("kinds"),
            (acc["n"] + 1).alias("n"), *after(acc))

    zero = F.lit(0).cast("long")
    begin = F.struct(F.array_repeat(zero, (128 - _FIRST) // _SLOT + 1).alias("counts"), zero.alias("sum"), zero.alias("kinds"), F.lit(0).alias("n"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    whole = lambda f: F.aggregate(pairs(f), begin, step, lambda acc: F.struct(*after(acc)))
    return F.get(F.filter(F.transform(F.array(facts), whole), lambda x: x["first"] >= 0), 0)


def entropy_spans(text: Column) -> Column:
    """array<struct<start, end>>: from the first to the last counting window of each candidate."""
    hits = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), _windows(_masked(m["value"])).alias("at")))
    hits = F.filter(hits, lambda h: h["at"].isNotNull())
    return F.transform(hits, lambda h: F.struct((h["start"] + h["at"]["first"]).alias("start"), (h["start"] + h["at"]["last"] + WINDOW).alias("end")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets) for every row: array<struct<start, kind, end>> in order of start, then kind.

    ``kind`` indexes KINDS; positions are code points, ends exclusive. The
    three base kinds are the fixed patterns with their least lengths; the
    fourth is the sliding-window entropy of candidate strings, windows that
    hold characters of the allow-list left out. Work and memory follow the
    length of the text, also of one that is a single candidate. Null and empty texts have no secrets; null or repeated ids keep
    their rows; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))

    def base(kind, pattern, keep):
        return F.transform(F.filter(matches(text, pattern), lambda m: keep(m["value"])), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    entropy = F.transform(entropy_spans(text), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return docs.select("doc_id", F.array_sort(F.concat(
        base(0, ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8),
        base(1, ACCESS, lambda v: F.lit(True)),
        base(2, HEX, lambda v: F.lit(True)),
        entropy)).alias("secrets"))


def spans_text(secrets: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
