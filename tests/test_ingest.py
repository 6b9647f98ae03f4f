import json
import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from docloom.jobs.ingest import ingest
from docloom.operators import documents, quality
from docloom.operators.maxmin import ChunkingConfig
from docloom.sources.tables import write_json
from docloom.streaming.ingest import current_chunks, current_documents, ingest_folder, sync_folder

SMALL = ChunkingConfig(min_tokens=1, target_tokens=4, max_tokens=6)


def write(folder):
    folder.mkdir()
    (folder / "a.txt").write_text("One two three. Four five six. Seven eight nine.")
    (folder / "b.txt").write_text("   ")


def test_outcomes(spark, tmp_path):
    write(tmp_path / "in")
    files = documents.read_files(spark, str(tmp_path / "in"), "text/plain", "*.txt")
    chunks, outcomes = ingest(files, "txt", config=SMALL)
    got = {r.source_identifier: (r.status, r.reason, r.chunk_count) for r in outcomes.collect()}
    assert got["b.txt"] == ("rejected", "empty_document", 0) and got["a.txt"][:2] == ("completed", None) and got["a.txt"][2] == chunks.count() > 1
    again, after = ingest(files, "txt", known=outcomes.filter("status = 'completed'"), config=SMALL)
    assert again.count() == 0 and {r.status for r in after.collect()} == {"rejected", "skipped"}
    assert ingest(files, "txt", known=outcomes, config=SMALL, force=True)[0].count() == chunks.count()


def test_a_providers_fault_rejects_its_document(spark, tmp_path):
    write(tmp_path / "in")
    files = documents.read_files(spark, str(tmp_path / "in"), "text/plain", "*.txt")
    chunks, outcomes = ingest(files, "txt", config=SMALL, embed=lambda texts: [])
    assert chunks.count() == 0 and {(r.status, r.reason) for r in outcomes.collect()} == {("rejected", "unexpected_vector_count"), ("rejected", "empty_document")}


def test_malformed_text_is_partial_and_written_as_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_bytes(b"One two \xff three. Four five six.")
    files = documents.read_files(spark, str(tmp_path / "in"), "text/plain")
    chunks, outcomes = ingest(files, "txt", config=SMALL)
    got = outcomes.first()
    assert (got.status, got.warnings, got.chunk_count) == ("partial", ["malformed_text"], chunks.count()) and chunks.count() > 0
    write_json(documents.parse(files, "txt"), f"{tmp_path}/deep/out")
    row = json.loads(spark.read.text(f"{tmp_path}/deep/out").first()[0])
    assert row["source_identifier"] == "m.txt" and row["title"] is None and row["elements"][0]["order"] == 0


def test_stream_of_files(spark, tmp_path):
    write(tmp_path / "in")
    out = str(tmp_path / "out")
    for text in ("Later text here.", None):
        ingest_folder(spark, str(tmp_path / "in"), out, "txt", "text/plain", "*.txt", SMALL).awaitTermination()
        if text:
            (tmp_path / "in" / "more").mkdir()
            (tmp_path / "in" / "more" / "a.txt").write_text(text)
            # the same content again under its old path
            (tmp_path / "in" / "a.txt").rename(tmp_path / "a")
            (tmp_path / "in" / "a.txt").write_text((tmp_path / "a").read_text())
            os.utime(tmp_path / "in" / "a.txt", (2_000_000_000, 2_000_000_000))
    chunks, outcomes = spark.read.parquet(f"{out}/chunks"), spark.read.parquet(f"{out}/outcomes")
    assert chunks.select("document_id").distinct().count() == 2 and chunks.select("batch").distinct().count() == 2
    assert {(r.source_identifier, r.status) for r in outcomes.filter("batch > 0").collect()} >= {("more/a.txt", "completed")}
    assert chunks.count() == chunks.select("chunk_id").distinct().count()


def test_superseded_and_removed_documents(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    arguments = (spark, str(folder), out, "txt", "text/plain", "*.txt", SMALL)
    held = lambda: sorted(r.content for r in current_chunks(spark, out).collect())
    states = lambda: {r.source_identifier: (r.status, r.batch) for r in current_documents(out).read(spark).collect()}

    def put(name, text, second):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_900_000_000 + second, 1_900_000_000 + second))

    put("a.txt", "One two three.", 0)
    put("b.txt", "Four five six.", 0)
    put("c.txt", "Seven eight.", 0)
    ingest_folder(*arguments).awaitTermination()
    assert held() == ["Four five six.", "One two three.", "Seven eight."]
    version = current_documents(out).version(spark)
    # the batch once more, as if it had not been marked as done
    (tmp_path / "out" / "progress" / "commits" / "0").rename(tmp_path / "commit")
    for crc in (tmp_path / "out" / "progress" / "commits").glob(".0*"):
        crc.rename(tmp_path / "crc")
    ingest_folder(*arguments).awaitTermination()
    assert held() == ["Four five six.", "One two three.", "Seven eight."] and current_documents(out).version(spark) == version
    assert sync_folder(*arguments) == {"read": 0, "removed": 0} and current_documents(out).version(spark) == version
    # a changed file, one that is rejected now, one written anew with the same text, one that is gone, and a new one
    put("a.txt", "Another text.", 1)
    put("c.txt", "  ", 1)
    (folder / "b.txt").rename(tmp_path / "b")
    put("d.txt", "Nine ten.", 1)
    assert sync_folder(*arguments) == {"read": 3, "removed": 1}
    assert held() == ["Another text.", "Nine ten."]
    assert states() == {"a.txt": ("completed", "sync-2"), "b.txt": ("removed", "0"), "c.txt": ("rejected", "sync-2"), "d.txt": ("completed", "sync-2")}
    # back to former texts; the text of d is the same
    put("b.txt", "Four five six.", 2)
    put("a.txt", "One two three.", 0)
    put("d.txt", "Nine ten.", 2)
    assert sync_folder(*arguments) == {"read": 3, "removed": 0}
    assert held() == ["Four five six.", "Nine ten.", "One two three."]
    assert states() == {"a.txt": ("completed", "sync-4"), "b.txt": ("completed", "sync-4"), "c.txt": ("rejected", "sync-2"), "d.txt": ("completed", "sync-2")}
    assert sync_folder(*arguments) == {"read": 0, "removed": 0}
    chunks, metrics = spark.read.parquet(f"{out}/chunks"), spark.read.parquet(f"{out}/metrics")
    assert chunks.count() == 7 and chunks.filter("quarantined").count() == 0  # nothing is lost of former versions
    counted = {(r.table, r.metric): r.n for r in metrics.groupBy("table", "metric").agg(F.sum("n").alias("n")).collect()}
    assert counted["chunks", "rows"] == 7 and counted["outcomes", "rows"] == spark.read.parquet(f"{out}/outcomes").count() and counted["chunks", "quarantined"] == counted["outcomes", "missing_document"] == 0


def test_violations_are_counted_in_the_pass_that_writes(spark, tmp_path):
    rows = spark.range(400).select(
        F.when(F.col("id") % 5 == 0, "").otherwise("text").alias("content"), (F.col("id") % 4 - 1).alias("chunk_index"), (F.col("id") % 3).alias("token_count"), F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"), F.col("id").alias("chunk_id"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("parent_chunk_id"), F.lit(None).cast("long").alias("previous_chunk_id"), F.lit(None).cast("long").alias("next_chunk_id"))
    seen = Observation("chunks")
    quality.observed(rows, quality.chunk_checks(), seen).write.parquet(f"{tmp_path}/out")
    spark.read.parquet(f"{tmp_path}/out").createOrReplaceTempView("written")
    sql = "SELECT count(*) AS rows, count_if(quarantined) AS quarantined, " + ", ".join(f"count_if(array_contains(violations, '{c}')) AS {c}" for c in quality.chunk_checks()) + " FROM written"
    recount = spark.sql(sql).first().asDict()
    assert seen.get == recount and recount["empty_content"] == 80 and recount["negative_index"] == 100 and recount["token_count"] == 134 and recount["self_link"] == 58 and recount["half_pages"] == 0
    assert spark.sql("SELECT count(*) FROM written WHERE quarantined <> (size(violations) > 0)").first()[0] == 0
