"""Parsing files and layout items into normalised documents; rejections are rows with a reason."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.functions import identity, text
from docloom.operators.markdown import render_html

# Media types and the reasons a source is rejected for.
PLAIN, MARKDOWN = "text/plain", "text/markdown"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PDF = ("application/pdf", "application/x-pdf")
REASONS = ("unsupported_format", "conversion_failed", "empty_document", "encrypted_pdf", "scanned_pdf", "textless_pdf")


def relative_path(path: Column, root: str) -> Column:
    """The part of a file's path below the folder ``root``, which names the file whatever machine or store the folder lies on."""
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/")
    return F.when(F.lit(folder == ""), F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+", "")).otherwise(
        F.substring(path, F.locate(f"/{folder}/", path) + len(folder) + 2, F.length(path)))


def as_sources(files: DataFrame, root: str, mime_type: str) -> DataFrame:
    """(source_identifier, source_name, mime_type, content) of rows of the binaryFile source, batch or stream."""
    return files.select(relative_path(F.col("path"), root).alias("source_identifier"), F.element_at(F.split("path", "/"), -1).alias("source_name"), F.lit(mime_type).alias("mime_type"), "content")


def read_files(spark: SparkSession, path: str, mime_type: str, glob: str = "*") -> DataFrame:
    """All files below the folder ``path``, identified by their path below it (see as_sources)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return as_sources(files, path, mime_type)


def decode(content: Column) -> Column:
    """Bytes as UTF-8 with malformed parts replaced; Unix line ends."""
    return text.unix_lines(F.make_valid_utf8(content.cast("string")))


def parse_text(files: DataFrame, parser: str, version: str = "1.0.0") -> DataFrame:
    """Plain or Markdown files as documents of one paragraph.

    Adds document_id, document_version, title, text, elements, content_checksum,
    ``warnings`` (malformed_text where bytes had to be replaced) and ``reason``: unsupported_format if the media type is not exactly the
    parser's, empty_document if nothing is left, null for a parsed document.
    """
    kind = {"txt": PLAIN, "markdown": MARKDOWN}[parser]
    raw = decode(F.col("content"))
    if parser == "txt":
        body, title = text.normalize_plain(raw), F.lit(None).cast("string")
    else:
        body, title = text.flatten_html(render_html(raw)), text.first_heading(raw)
    malformed = F.when(~F.is_valid_utf8(F.col("content").cast("string")), F.array(F.lit("malformed_text")))
    d = files.withColumn("text", body).withColumn("title", title).withColumn("warnings", F.coalesce(malformed, F.array().cast("array<string>")))
    return _finish(d, F.when(F.col("mime_type") != kind, "unsupported_format").when(F.coalesce("text", F.lit("")) == "", "empty_document"), parser, version)


def _finish(d: DataFrame, reason: Column, parser: str, version: str) -> DataFrame:
    return _documents(d.withColumn("texts", F.array("text")), reason, parser, version)


def _documents(d: DataFrame, reason: Column, parser: str, version: str) -> DataFrame:
    """Documents of paragraphs (column ``texts``), numbered in order."""
    d = d.withColumn("document_id", identity.document_id(F.col("source_identifier"))).withColumn("content_checksum", identity.content_checksum(F.col("text")))
    # checksums need Python for texts outside ASCII, so they are taken of whole columns and not inside a lambda
    d = d.withColumn("checks", F.when(F.size("texts") == 1, F.array("content_checksum")).otherwise(_checksums("texts")))
    elements = F.transform(F.arrays_zip("texts", "checks"), lambda x, i: F.struct(
        identity.uuid5(F.concat_ws(":", F.lit("element"), F.col("document_id"), F.lit(version), i.cast("string"), x["checks"])).alias("element_id"),
        F.lit("paragraph").alias("element_type"), x["texts"].alias("text"), F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page_number"), i.alias("order")))
    return d.select(
        "document_id", F.col("content_checksum").alias("document_version"), "source_name", "source_identifier", "mime_type", "title", "text",
        elements.alias("elements"), "content_checksum", F.lit(parser).alias("parser_name"), F.lit(version).alias("parser_version"), "warnings", reason.alias("reason"))


@F.pandas_udf(ArrayType(StringType()))
def _checksums(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: [identity.python_checksum(t) for t in ts], na_action="ignore")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[str] | None:
    """The trimmed paragraphs of a Word file that are not blank, in order, without tables; null for what is no such file."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError):
        return None
    out, open_ = [], list(reversed(body)) if body is not None else []
    while open_:
        node = open_.pop()
        if node.tag == f"{_W}p":
            parts = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n", f"{_W}cr": lambda x: "\n"}
            if text := "".join(parts[x.tag](x) for x in node.iter() if x.tag in parts).strip():
                out.append(text)
        elif node.tag != f"{_W}tbl":
            open_ += reversed(node)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _docx(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: docx_paragraphs(bytes(b)), na_action="ignore")


def parse_docx(files: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Word files as documents of one element per paragraph (see parse_text); ``reason`` is also conversion_failed for what cannot be read."""
    fits = F.col("mime_type") == DOCX
    d = files.withColumn("found", _docx(F.when(fits, F.col("content"))))
    d = d.withColumn("texts", F.coalesce("found", F.array().cast("array<string>"))).withColumn("text", F.array_join("texts", "\n\n")).withColumn("title", F.lit(None).cast("string")).withColumn("warnings", F.array().cast("array<string>"))
    return _documents(d, F.when(~fits, "unsupported_format").when(F.col("found").isNull(), "conversion_failed").when(F.size("texts") == 0, "empty_document"), "docx", version)


def parse(files: DataFrame, parser: str) -> DataFrame:
    """Files by the parser's name: txt, markdown or docx."""
    return parse_docx(files) if parser == "docx" else parse_text(files, parser)


def source_reason(mime: Column, path: Column, exists: Column) -> Column:
    """Why a PDF source is rejected before it is opened; null if it is not."""
    fits = F.lower(mime).isin(*PDF) & F.lower(path).endswith(".pdf")
    return F.when(~F.coalesce(fits, F.lit(False)), "unsupported_format").when(~exists, "conversion_failed")


def conversion_reason(status: Column, parser: str) -> Column:
    """conversion_failed by a converter's status: for docx only "failure" fails, for pdf everything but "success"; no status is none."""
    state = F.lower(status)
    failed = state == "failure" if parser == "docx" else state != "success"
    return F.when(F.coalesce(failed, F.lit(False)), "conversion_failed")


def profile_reason(encrypted: Column, status: Column, n_elements: Column, has_images: Column) -> Column:
    """Why a PDF is rejected once it was inspected and converted; null if it is not."""
    return (F.when(encrypted, "encrypted_pdf").when(conversion_reason(status, "pdf").isNotNull(), "conversion_failed")
            .when((n_elements == 0) & has_images, "scanned_pdf").when(n_elements == 0, "textless_pdf"))


def heading_paths(items: Column) -> Column:
    """Fold over ordered items (type, level, text): the heading stack beside each item.

    A heading of level n keeps the n - 1 *lowest* entries of the stack, by
    position, and adds itself; so after a skipped level a second heading of the
    same level nests below the first.
    """
    begin = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc, x):
        stack = F.when(x["type"] == "heading", F.concat(F.slice(acc["stack"], F.lit(1), x["level"] - 1), F.array(x["text"]))).otherwise(acc["stack"])
        return F.transform(F.array(stack), lambda s: F.struct(s.alias("stack"), F.concat(acc["out"], F.array(s)).alias("out")))[0]

    return F.aggregate(items, begin, step, lambda acc: acc["out"])


def map_items(items: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Layout items of extracted documents as elements: one row per kept element.

    Input: (source_identifier, item_order, label, text, level, tree_level,
    pages, enumerated, marker, language, rows, columns[, table_markdown: the
    text of a table instead of ``text``]). Output: document_id,
    order, element_id, type, text, heading path, offsets in the joined text,
    page numbers and the metadata that the type has.
    """
    kind = text.element_type(F.col("label"))
    given = F.when(kind == "table", F.coalesce("table_markdown", "text")).otherwise(F.col("text")) if "table_markdown" in items.columns else F.col("text")
    body = identity.nfc(text.unix_lines(F.coalesce(given, F.lit(""))))
    d = items.withColumn("type", kind).withColumn("body", F.when(kind == "code", F.regexp_replace(body, r"\n+\z", "")).otherwise(text.strip(body)))
    d = d.filter(F.col("type").isNotNull() & text.has_word_character(F.col("body")))
    level = F.when(F.col("level") >= 1, F.col("level")).otherwise(F.greatest(F.lit(1), F.coalesce("tree_level", F.lit(1))))
    pages = F.array_sort(F.array_distinct(F.filter(F.coalesce("pages", F.array().cast("array<int>")), lambda p: p >= 1)))
    ordinal = F.regexp_replace(F.coalesce("marker", F.lit("")), r"[.) ]+$", "")
    d = d.select(
        "source_identifier", F.struct(
            F.col("item_order").alias("at"), F.col("type"), level.cast("int").alias("level"), F.col("body").alias("text"), pages.alias("pages"),
            F.when(F.col("type") == "list_item", F.struct(
                F.when(F.col("enumerated"), "ordered").otherwise("unordered").alias("list_kind"), F.greatest(F.lit(1), F.coalesce("tree_level", F.lit(1))).alias("list_depth"),
                F.when(F.col("enumerated") & ordinal.rlike(r"^\d+$"), ordinal.cast("int")).alias("ordinal"))).alias("list"),
            F.when(F.col("type") == "table", F.struct(F.when(F.col("rows") >= 0, F.col("rows")).alias("row_count"), F.when(F.col("columns") >= 0, F.col("columns")).alias("column_count"))).alias("table"),
            F.when(F.col("type") == "code", F.nullif(text.strip(F.col("language")), F.lit(""))).alias("code_language"),
            F.when(F.col("type") == "other", F.lower("label")).alias("source_role")).alias("item"))
    docs = d.groupBy("source_identifier").agg(F.array_sort(F.collect_list("item")).alias("items"))
    docs = docs.withColumn("paths", heading_paths(F.col("items"))).withColumn("document_id", identity.document_id(F.col("source_identifier")))
    rows = docs.select("source_identifier", "document_id", "paths", F.posexplode("items").alias("order", "item"))
    front = Window.partitionBy("source_identifier").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("item.text") + 2).over(front), F.lit(0)).cast("int")
    return rows.withColumn("char_start", start).select(
        "document_id", "source_identifier", "order", identity.element_id(F.col("document_id"), F.lit(version), F.col("order"), F.col("item.text")).alias("element_id"),
        F.col("item.type").alias("element_type"), F.col("item.text").alias("text"), F.element_at("paths", F.col("order") + 1).alias("heading_path"),
        F.when(F.col("item.type") == "heading", F.col("item.level")).alias("heading_level"), "char_start", (F.col("char_start") + F.length("item.text")).alias("char_end"),
        F.try_element_at("item.pages", F.lit(1)).alias("page_number"), F.when(F.size("item.pages") > 1, F.col("item.pages")).alias("page_numbers"),
        F.col("item.list").alias("list"), F.col("item.table").alias("table"), F.col("item.code_language").alias("code_language"), F.col("item.source_role").alias("source_role"))


def assemble(elements: DataFrame, profiles: DataFrame, version: str = "1.0.0") -> DataFrame:
    """One row per source of ``profiles`` (source_identifier, encrypted, status, has_images): the document that its elements make.

    ``elements`` are those of map_items. The text is theirs joined by blank
    lines, so that their offsets hold; the title is the first title element; the
    version is the text's checksum. ``reason`` says why a source is rejected:
    it could not be converted, or has no element.
    """
    one = F.struct("order", "element_id", "element_type", "text", "heading_path", "page_number", "char_start", "char_end")
    docs = elements.groupBy("source_identifier").agg(F.array_sort(F.collect_list(one)).alias("elements"))  # one document's
    d = profiles.join(docs, "source_identifier", "left").withColumn("elements", F.coalesce("elements", F.array().cast(docs.schema["elements"].dataType)))
    d = d.withColumn("text", F.array_join(F.transform("elements", lambda e: e["text"]), "\n\n"))
    titles = F.filter("elements", lambda e: e["element_type"] == "title")
    return d.select(
        identity.document_id(F.col("source_identifier")).alias("document_id"), "source_identifier", identity.content_checksum(F.col("text")).alias("document_version"),
        F.get(titles, F.lit(0))["text"].alias("title"), "text", "elements", F.lit(version).alias("parser_version"),
        profile_reason(F.col("encrypted"), F.col("status"), F.size("elements"), F.col("has_images")).alias("reason"))


def ingest_status(documents: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """``documents`` with ``status``: rejected, skipped if that version is known, partial with ``warnings``, else completed."""
    seen = known.select("document_id", "document_version", F.lit(True).alias("seen")).distinct()
    skip = F.lit(False) if force else F.coalesce("seen", F.lit(False))
    partial = F.size("warnings") > 0 if "warnings" in documents.columns else F.lit(False)
    return documents.join(seen, ["document_id", "document_version"], "left").withColumn(
        "status", F.when(F.col("reason").isNotNull(), "rejected").when(skip, "skipped").when(partial, "partial").otherwise("completed")).drop("seen")
