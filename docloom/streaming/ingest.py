"""Ingestion of a folder as a stream of files or by comparison with what is known, with a current view by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import identity
from docloom.jobs.ingest import ingest
from docloom.operators import quality
from docloom.operators.documents import as_sources, relative_path
from docloom.operators.maxmin import ChunkingConfig
from docloom.sources.store import Store

_FILES = "path string, modificationTime timestamp, length long, content binary"
_STATE = ("document_id", "document_version", "source_identifier", "status", "batch", "modified")


def current_documents(out: str) -> Store:
    """The store of what is known of each document: its version, status (``removed`` for a tombstone), the batch that has its chunks, and when its file was written."""
    return Store(f"{out}/documents", "document_id")


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the current version of every document that has one; those of superseded versions and removed files are not among them, nor are quarantined ones."""
    chunks = spark.read.parquet(f"{out}/chunks").filter("not quarantined").drop("quarantined", "violations")
    state = current_documents(out).read(spark)
    held = state.filter(F.col("status").isin("completed", "partial")).select("document_id", "document_version", "batch")
    return chunks.withColumn("batch", F.col("batch").cast("string")).join(held, ["document_id", "document_version", "batch"], "left_semi")


def _files(reader, folder: str, glob: str) -> DataFrame:
    return reader.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def _named(files: DataFrame, folder: str) -> DataFrame:
    """(document_id, source_identifier, modified) of files; their content is not read."""
    source = relative_path(F.col("path"), folder)
    return files.select(identity.document_id(source).alias("document_id"), source.alias("source_identifier"), F.col("modificationTime").alias("modified"))


def _take(files: DataFrame, folder: str, out: str, batch: str, parser: str, mime_type: str, config: ChunkingConfig) -> None:
    """Ingest one batch of files and put it into the current view; see ingest_folder."""
    spark, store = files.sparkSession, current_documents(out)
    state = store.read(spark)
    # this batch may be running again
    before = None if state is None else state.filter(F.col("batch") != batch)
    known = None if before is None else before.filter(F.col("status").isin("completed", "partial"))
    chunks, outcomes = ingest(as_sources(files, folder, mime_type), parser, known, config)
    for name, rows, checks in (("chunks", chunks, quality.chunk_checks()), ("outcomes", outcomes, quality.outcome_checks())):
        seen = Observation(f"{name} {batch}")
        quality.observed(rows, checks, seen).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        counts = spark.createDataFrame(sorted(seen.get.items()), "metric string, n long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/metrics/table={name}/batch={batch}")
    made = spark.read.schema(outcomes.schema).parquet(f"{out}/outcomes/batch={batch}").join(_named(files, folder).select("document_id", "modified"), "document_id")
    fresh = made.filter("status <> 'skipped'").withColumn("batch", F.lit(batch)).select(*_STATE)
    if before is not None:
        same = made.filter("status = 'skipped'").select("document_id", "modified").join(before.drop("modified"), "document_id")
        fresh = fresh.unionByName(same.select(*_STATE))
    store.merge(fresh, batch_id=batch)


def ingest_folder(spark: SparkSession, folder: str, out: str, parser: str, mime_type: str, glob: str = "*", config: ChunkingConfig = ChunkingConfig()) -> StreamingQuery:
    """Chunk the files that arrive in ``folder``; start, process what is there, and stop.

    Each micro-batch writes its chunks to a folder of its own below
    ``out/chunks``, its outcomes below ``out/outcomes``, rows with violations marked
    and counted as they are written (``out/metrics``), and last its documents
    to the store of current documents, which makes the batch count: a new version
    of a document retires the chunks of the old one, also if it is rejected.
    Identifiers come from content, a repeated batch overwrites its folders and
    the store takes it once, so a batch that runs again after a failure leaves
    the same rows. Documents whose current version is the same are skipped. A
    stream sees each path once; sync_folder takes what changes and goes.
    """
    arriving = _files(spark.readStream, folder, glob)
    return arriving.writeStream.foreachBatch(lambda batch, number: _take(batch, folder, out, str(number), parser, mime_type, config)).option(
        "checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()


def sync_folder(spark: SparkSession, folder: str, out: str, parser: str, mime_type: str, glob: str = "*", config: ChunkingConfig = ChunkingConfig()) -> dict[str, int]:
    """Bring the current view in line with ``folder`` and return how many documents were read and how many removed.

    Files are new or changed if the view has no document of their path with
    their time of writing; only these are ingested, as one batch of their own.
    Times are compared in the list of files; content is read from the earliest
    of these times on. Documents without a file get a tombstone, which retires
    their chunks. A sync that is broken off is repeated under the same name.
    """
    store = current_documents(out)
    state, number = store.read(spark), store.version(spark)
    listed = _named(_files(spark.read, folder, glob), folder)
    here = listed if state is None else listed.join(state.filter("status <> 'removed'").select("document_id", "modified"), ["document_id", "modified"], "left_anti")
    since, n = here.agg(F.min("modified"), F.count(F.lit(1))).first()
    if n:
        wanted = here.select("source_identifier")
        files = _files(spark.read, folder, glob).filter(F.col("modificationTime") >= F.lit(since))
        files = files.withColumn("source_identifier", relative_path(F.col("path"), folder)).join(wanted, "source_identifier", "left_semi").drop("source_identifier")
        _take(files, folder, out, f"sync-{number + 1}", parser, mime_type, config)
    gone = 0
    if state is not None:
        lost = state.filter("status <> 'removed'").join(listed, "document_id", "left_anti")
        gone = lost.count()
        if gone:
            store.merge(lost.withColumn("status", F.lit("removed")).select(*_STATE))
    return {"read": n, "removed": gone}
