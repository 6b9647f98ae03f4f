"""From documents to shards: toxicity, near duplicates, test items, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. Stages but the last return the columns of ``documents`` as they are:
extra columns of any name pass through, whole rows are named by a hash of their
content, so null and repeated doc_ids keep their rows apart and rows equal in
all columns are interchangeable. Null texts count as empty. An empty table
gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, mixing, near_copies, sharding, toxicity
from docloom.sources.tables import materialize, read_table


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has a column that Spark takes for the same."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names a row by its whole content."""
    name = _fresh(docs, "row_key")
    return docs.withColumn(name, F.md5(F.to_json(F.struct(*map(_quoted, docs.columns))).cast("binary"))), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; all texts without words get one score, the base rate of the label, and stay unless most labels are toxic."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): the smallest doc_id, null last, among rows of one id the smallest content key.

    Texts without words are copies of each other; of repeated rows one stays.
    """
    keyed, name = _keyed(docs)
    rows = near_copies.first_rows(keyed, name)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first"))
    kept = keyed.join(first.select(F.col("first.row_key").alias(name)), name, "left_semi")
    return kept.dropDuplicates([name]).select(*map(_quoted, docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any test item; empty texts and repeated rows stay."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it (0, 1 or 2 times); a document taken in part stays whole.

    Texts without words have no size and are not taken; a null source is a source; repeated rows are taken each.
    """
    keyed, name = _keyed(docs)
    count = _fresh(keyed, "times")
    times = mixing.mix(keyed, row_key=name).filter("times > 0").groupBy(F.col("row_key").alias(name)).agg(F.sum("times").cast("int").alias(count))
    once = keyed.join(times, name).dropDuplicates([name])
    return once.withColumn(_fresh(once, "copy"), F.explode(F.sequence(F.lit(1), F.col(count)))).select(*map(_quoted, docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every document; equal rows are dealt one by one."""
    return sharding.interleave(docs, shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixture", mix_sources),
    ("shards", shard),
]

#: Trained scores and MinHash bands of XXH64 are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
