"""From files to chunks: parse, skip what is known, chunk, and report each document's outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import documents, maxmin, sentences
from docloom.sources.tables import materialize


def ingest(files: DataFrame, parser: str, known: DataFrame | None = None, config: maxmin.ChunkingConfig = maxmin.ChunkingConfig(), force: bool = False,
           embed: maxmin.Embed = maxmin.hashed_embeddings, count: maxmin.Count | None = None, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes) of files read by documents.read_files.

    Outcomes have document_id, document_version, source_identifier, status,
    reason, warnings and chunk_count; rejected and skipped documents have no chunks, and a
    document for which a provider failed is rejected with the provider's fault.
    Documents are parsed and asked for once: plans are written to the shared folder.
    """
    parsed = documents.parse(files, parser)
    if known is None:
        known = parsed.select("document_id", "document_version").filter("false")
    status = materialize(documents.ingest_status(parsed, known, force), "parsed")
    todo = status.filter("status in ('completed', 'partial')").select("document_id", "document_version", "elements")
    plan = materialize(maxmin.plan_chunks(sentences.units(todo), config, embed, count, batch), "plan")
    chunks = maxmin.render_chunks(plan, config, count=count)
    made = plan.groupBy("document_id", "document_version").agg(F.max("fault").alias("fault"), F.max(F.size("runs")).alias("n"))
    outcomes = status.join(made, ["document_id", "document_version"], "left").select(
        "document_id", "document_version", "source_identifier", F.when(F.col("fault").isNotNull(), "rejected").otherwise(F.col("status")).alias("status"),
        F.coalesce("fault", "reason").alias("reason"), "warnings", F.coalesce("n", F.lit(0)).alias("chunk_count"))
    return chunks, outcomes
