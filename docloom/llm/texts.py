"""Shared helpers: whole texts as UTF-8 bytes, folds by checksum, bounded blocks of rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters;
#: bytes.split() without arguments splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


_WORDS = re.compile(WORD.encode())


def token_runs(text: bytes, overlap: int, size: int = 1 << 16) -> Iterator[list[bytes]]:
    """The words of a text, ASCII letters lowered, in runs of about ``size``; each run begins with the last ``overlap`` words of the one before."""
    text = text.lower()
    if len(text) < 1 << 20:
        if words := text.split():
            yield words
        return
    found, held = (m[0] for m in _WORDS.finditer(text)), []
    while fresh := list(islice(found, size)):
        held += fresh
        yield held
        held = held[len(held) - overlap:] if overlap < len(held) else held


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def blocks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``limit`` bytes of ``column`` each, at least a row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def most_frequent(counted: DataFrame, key: str, count: str, size: int) -> DataFrame:
    """The rows with the largest counts, at most ``size``; among the last, of like counts, those whose ``key`` has the least hash.

    Found from how many rows have which count, counts of a 256th of a power of
    two together, and then which hash: at most 64 * 256 and 2^12 rows, however
    large the table, so no task and not the driver ever sorts or gathers
    candidates. A hash that would take the number over ``size`` is left out.
    """
    scale = F.floor(F.log2(F.col(count).cast("double")) * 256)
    having = sorted(counted.groupBy(scale.alias("scale")).agg(F.count(F.lit(1))).collect(), reverse=True)
    held, last = 0, None
    for bin_, n in having:
        if held + n > size:
            last = bin_
            break
        held += n
    if last is None:
        return counted
    place = F.pmod(F.xxhash64(key), F.lit(1 << 12))
    below = 0
    for at, n in sorted(counted.filter(scale == last).groupBy(place.alias("place")).agg(F.count(F.lit(1))).collect()):
        if held + n > size:
            break
        held, below = held + n, at + 1
    return counted.filter((scale > last) | (scale == last) & (place < below))
