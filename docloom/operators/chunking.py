"""Word-window and structure chunking, and enrichment of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, strip, word_count
from docloom.operators.sentences import cut_oversized, spaced_sentences


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_index, content, token_count): windows of ``size`` words, each starting ``overlap`` words before the last one's end.

    The last window ends with the text; a text within one window is one chunk
    and an empty one has none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    step = size - overlap
    w = docs.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int"))
    return w.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("w", i * step + 1, size))).alias("chunk_index", "c")).select(
        "doc_id", "chunk_index", F.array_join("c", " ").alias("content"), F.size("c").alias("token_count"))


def packed(counts: Column, sections: Column, most: int) -> Column:
    """array<int>: the chunk of each piece when pieces are packed in order into chunks of at most ``most`` tokens within one section.

    A piece larger than that is a chunk of its own.
    """
    begin = F.struct(F.lit(0).cast("long").alias("held"), F.lit(-1).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("out"))

    def step(acc, n):
        i = acc["i"]
        fits = (acc["n"] >= 0) & (acc["held"] + n <= most) & (F.get(sections, i) == F.get(sections, i - 1))
        k = F.when(fits, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(fits, acc["held"] + n).otherwise(n.cast("long")).alias("held"), k.alias("n"), (i + 1).alias("i"), F.concat(acc["out"], F.array(k)).alias("out"))

    return F.aggregate(counts, begin, step, lambda acc: acc["out"])


def recursive_chunks(docs: DataFrame, most: int = 600) -> DataFrame:
    """(doc_id, chunk_index, first_line, last_line, token_count): lines packed in order within ``most`` words; blank lines are no pieces."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.size(words(x)) > 0)
    d = docs.select("doc_id", lines.alias("lines"))
    d = d.withColumn("counts", F.transform("lines", lambda x: F.size(words(x))))
    d = d.withColumn("at", packed(F.col("counts"), F.transform("lines", lambda x: F.lit(0)), most))
    rows = d.select("doc_id", F.posexplode(F.arrays_zip("counts", "at")).alias("line", "z"))
    return rows.groupBy("doc_id", F.col("z.at").alias("chunk_index")).agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum("z.counts").alias("token_count"))


def structure_chunks(docs: DataFrame, most: int = 600) -> DataFrame:
    """(document_id, chunk_index, heading_path, first_order, last_order, token_count, content) of documents with ``elements``.

    A run of elements under one heading path is a section. A section's elements
    are packed in order within ``most`` words; one that is larger is first cut
    into sentences, and those into runs of words. Pieces keep what is between
    them in an element, and elements are a blank line apart. The input is that
    of sentences.units; documents stay one row each, so nothing is shuffled.
    """
    same = lambda e, text, separator: F.struct(
        text.alias("text"), separator.alias("separator"), e["element_id"].alias("element_id"), e["order"].alias("element_order"), e["element_type"].alias("element_type"),
        e["heading_path"].alias("heading_path"), e["page_number"].alias("page_number"), F.lit(False).alias("forced"))
    fine = lambda e: F.flatten(F.transform(
        F.transform(spaced_sentences(e["text"]), lambda s, i: same(e, s["text"], F.when(i == 0, "\n\n").otherwise(s["gap"]))), lambda u: cut_oversized(u, most)))
    coarse = lambda e: F.filter(F.array(same(e, strip(e["text"]), F.lit("\n\n"))), lambda u: u["text"] != "")
    ordered = F.array_sort("elements", lambda a, b: a["order"] - b["order"])
    d = docs.select("document_id", F.flatten(F.transform(ordered, lambda e: F.when(word_count(e["text"]) > most, fine(e)).otherwise(coarse(e)))).alias("pieces"))
    d = d.withColumn("counts", F.transform("pieces", lambda u: word_count(u["text"]))).withColumn("paths", F.transform("pieces", lambda u: F.to_json(u["heading_path"])))
    d = d.withColumn("at", packed(F.col("counts"), F.col("paths"), most))
    runs = F.transform(F.array_distinct("at"), lambda k: F.filter("pieces", lambda u, i: F.get("at", i) == k))
    return d.select("document_id", F.posexplode(runs).alias("chunk_index", "us")).select(
        "document_id", "chunk_index", F.col("us")[0]["heading_path"].alias("heading_path"), F.col("us")[0]["element_order"].alias("first_order"),
        F.element_at("us", -1)["element_order"].alias("last_order"), F.aggregate(F.transform("us", lambda u: word_count(u["text"])), F.lit(0), lambda a, n: a + n).alias("token_count"),
        F.array_join(F.transform("us", lambda u, i: F.concat(F.when(i == 0, "").otherwise(u["separator"]), u["text"])), "").alias("content"))


def contextualize(chunks: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """Embedding text with the document's title in front; the content itself stays as it is."""
    prefix = F.concat(F.lit("Document: "), F.col(title))
    return chunks.withColumn("context_prefix", prefix).withColumn("embedding_text", F.concat_ws("\n\n", prefix, F.col(content)))
