"""Content-derived identifiers as column expressions."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import strip

# Fixed value: the namespace of all identifiers.
NAMESPACE = "c77233cc-8939-4b9d-b882-5be7673cf89f"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Characters that NFC neither replaces nor joins to others: all below the combining marks, common punctuation and signs, CJK ideographs.
_LOW = r"\x00-\u02FF"
_COMMON = r"\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\u2190-\u2199\u2500-\u25FF\u4E00-\u9FFF\uFFFD"
_COMPOSED = _LOW + _COMMON
#: Any other character. Most characters are told by the one range; looking through all of them for each takes many times as long.
_OTHER = f"[^{_LOW}](?<![{_COMMON}])"


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no builtin; only texts with other characters than _COMPOSED are sent to Python."""
    return F.coalesce(_compose(F.when(text.rlike(_OTHER), text)), text)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version-5 UUID of ``name`` in ``namespace``: SHA-1 with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
                       F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def content_checksum(text: Column) -> Column:
    return F.sha2(nfc(text).cast("binary"), 256)


def python_checksum(text: str) -> str:
    """content_checksum for texts that are in Python already."""
    return hashlib.sha256(unicodedata.normalize("NFC", text).encode("utf-8", "replace")).hexdigest()


def canonical_source(identifier: Column) -> Column:
    """A relative POSIX path: trimmed, forward slashes, NFC, without empty and "." parts; null if unsafe.

    Unsafe are empty and absolute paths, paths that name nothing but ".", and
    any path with a ".." part.
    """
    path = nfc(F.replace(strip(identifier), F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    safe = ~path.startswith("/") & (F.size(parts) > 0) & ~F.array_contains(parts, "..")
    return F.when(safe, F.array_join(parts, "/"))


def document_id(identifier: Column) -> Column:
    return uuid5(F.concat(F.lit("document:"), canonical_source(identifier)))


def element_id(document: Column, parser_version: Column, order: Column, text: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("element"), document, parser_version, order.cast("string"), content_checksum(text)))


def chunk_id(document: Column, version: Column, chunker: Column, chunker_version: Column, index: Column, checksum: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("chunk"), document, version, chunker, chunker_version, index.cast("string"), checksum))


def embedding_fingerprint(provider: str, model: str, dimensions: int, distance: str, normalization: str) -> str:
    return f"{provider}:{model}:{dimensions}:{distance}:{normalization}"
