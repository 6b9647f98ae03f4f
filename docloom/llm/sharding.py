"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.ranking import positions
from docloom.sources.tables import materialize


def shuffle_key(seed: int, *columns: str):
    """A seeded shuffle that any engine can repeat: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))


def interleave(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) for every row of ``docs``.

    Rows are shuffled with the seed inside their source, ranked there, and
    sorted by fractional rank (rank - 1/2) / rows of the source; the sorted list
    is cut into ``shards`` runs whose row counts are at most one apart, so every
    run holds each source in its proportion. Copies of one text are dealt like
    other rows and so lie in several shards. Ties between sources follow the
    source's name, null last. ``slot`` counts from 0 inside a shard.

    Ranks are global positions (see ranking.positions), so a source that holds
    a third of the rows is spread over many tasks. A null source is a source of
    its own; null texts have size 8; repeated rows are dealt like any others
    (equal rows are interchangeable); an empty table gives an empty result;
    columns other than doc_id, source and text are not read.
    """
    utf = F.coalesce("text", F.lit(""))
    slim = materialize(docs.select(
        "doc_id", "source", F.col("source").isNull().cast("int").alias("no_source"),
        (F.octet_length(utf).cast("long") + 8).alias("size"), F.crc32(utf.cast("binary")).alias("text_crc32"),
    ).withColumn("key", shuffle_key(seed, "doc_id", "text_crc32")), "slim")
    ranked = positions(slim, ["no_source", "source", "key", "doc_id", "text_crc32", "size"])
    # One row per source; joined by whatever its measured size allows.
    strata = ranked.groupBy("no_source", "source").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    strata = strata.withColumn("source_key", F.coalesce("source", F.lit("")))
    ranked = ranked.withColumn("source_key", F.coalesce("source", F.lit(""))).join(strata.drop("source"), ["no_source", "source_key"])
    ranked = ranked.withColumn("rank", F.col("pos") - F.col("first"))
    ranked = ranked.withColumn("fraction", (F.col("rank") * 2 + 1).cast("double") / (F.col("n") * 2).cast("double"))
    slots = positions(materialize(ranked.drop("pos", "first", "n", "key", "source_key"), "fractions"), ["fraction", "no_source", "source", "rank"])
    total = max(slots.count(), 1)
    # shard s holds the positions from ceil(s * total / shards) up to the next shard's first
    shard = F.expr(f"cast((pos * {shards}L) div {total}L as int)")
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return slots.withColumn("shard", shard).withColumn("slot", F.col("pos") - begin).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
