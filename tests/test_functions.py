import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import identity, text


def one(spark, rows, column, name="t"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, {name} string").orderBy("i").select(column).collect()]


def test_document_ids_are_version_5_uuids(spark):
    ids = one(spark, ["guides/semantic.md", "./guides\\café.md", "guides/café.md"], identity.document_id(F.col("t")))
    assert ids == ["ced3b6e2-fe77-522f-bb04-b90c7960a0ed", "3a2a53a4-65fc-51aa-a4b5-a3f52c605687", "3a2a53a4-65fc-51aa-a4b5-a3f52c605687"]


def test_uuid5_matches_the_standard_library(spark):
    names = ["", "a", "é" * 50, "x" * 500, *(f"n{i}" for i in range(64))]
    space = uuid.UUID(identity.NAMESPACE)
    assert one(spark, names, identity.uuid5(F.col("t"))) == [str(uuid.uuid5(space, n)) for n in names]


@pytest.mark.parametrize("path", ["  ", "./.", "\\\\etc\\passwd", "//mnt/x", "reports/..", "a/b/../../../c.txt", "..\\up.pdf"])
def test_unsafe_paths_have_no_identity(spark, path):
    assert one(spark, [path], identity.canonical_source(F.col("t"))) == [None]


def test_golden_element_and_chunk_ids(spark):
    d = spark.range(1)
    doc = identity.document_id(F.lit("notes/sample.txt"))
    assert d.select(identity.element_id(doc, F.lit("1.0.0"), F.lit(0), F.lit("Stable content."))).first()[0] == "3f74c709-b026-520e-9532-d19410b69a1a"
    check = identity.content_checksum(F.lit("Stable normalized content"))
    got = identity.chunk_id(identity.document_id(F.lit("guides/overview.md")), check, F.lit("fixed_window"), F.lit("1"), F.lit(0), check)
    assert d.select(got).first()[0] == "3baf5991-95ed-5c9d-b1d6-d2bc6dc8f58d"


def test_checksum_is_of_the_composed_text(spark):
    a, b = one(spark, [unicodedata.normalize("NFD", "café"), "café"], identity.content_checksum(F.col("t")))
    assert a == b


def test_plain_text(spark):
    rows = ["Low tide.\t \n\n\n\n\nHigh tide.\n", " \n\t\n \n", "a\r\nb\rc", None]
    assert one(spark, rows, text.normalize_plain(F.col("t"))) == ["Low tide.\n\nHigh tide.", "", "a\nb\nc", None]


def test_titles(spark):
    rows = ["# Tide Table\n\nwith *notes*", "# Port Rules { #rules-1 }\n\nx", "## Second level\n", "#\n\nLow", "no", "# {#only}", "# a {b} {c}"]
    assert one(spark, rows, text.first_heading(F.col("t"))) == ["Tide Table", "Port Rules", None, "Low", None, "{#only}", "a {b}"]


def test_preview_and_labels(spark):
    assert one(spark, ["a  b\nc", "x" * 90, ""], text.preview(F.col("t"), 10)) == ["a b c", "x" * 9 + "…", ""]
    rows = ["Title", "section_header", "picture", "page_footer", " ", None]
    assert one(spark, rows, text.element_type(F.col("t"))) == ["title", "heading", None, "other", None, None]
