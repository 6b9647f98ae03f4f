import numpy as np
from pyspark.sql import functions as F

from docloom.llm import mixing, sharding, toxicity
from docloom.llm.ranking import positions, spread
from docloom.llm.texts import most_frequent
from docloom.sources.tables import materialize


def test_most_frequent_fills_up_from_equal_counts(spark):
    rows = [(f"a{i}", 1) for i in range(5000)] + [(f"b{i}", 1000 + i) for i in range(20)]
    d = spark.createDataFrame(rows, "word string, n long")
    assert {r.word for r in most_frequent(d, "word", "n", 10).collect()} <= {f"b{i}" for i in range(7, 20)}
    got = {r.word for r in most_frequent(d, "word", "n", 1000).collect()}
    assert {f"b{i}" for i in range(20)} < got and 950 < len(got) <= 1000
    same = d.filter("n = 1")
    assert 950 < most_frequent(same, "word", "n", 1000).count() <= 1000
    assert most_frequent(d, "word", "n", 10_000).count() == 5020 and most_frequent(d, "word", "n", 0).count() == 0
    assert most_frequent(d.filter("false"), "word", "n", 5).count() == 0


def test_a_few_labelled_texts_are_evidence():
    texts = ["you are a stupid idiot", "what an idiot you are", "a lovely day at the sea", "lovely weather and the sea"]
    model = toxicity.train([toxicity.word_counts(t) for t in texts], np.array([1, 1, 0, 0]))
    bad, good, none = toxicity.scores(model, ["such an idiot", "a lovely sea", ""], {})
    assert bad > 0.6 > 0.4 > good and none == 0.5


def test_rare_buckets_count_for_less():
    bags = [toxicity.word_counts(t) for t in ["zq bad"] + ["bad"] * 9 + ["good"] * 10]
    model = toxicity.train(bags, np.array([1.0] * 10 + [0.0] * 10))
    rare, common = model.words(["zq", "bad"])
    assert 0 < rare < common


def test_equal_rows_are_split_between_ranges(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 40_000, None).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"))
    rows = materialize(rows, "equal")
    sizes = [r[1] for r in spread(rows, ["source", "doc_id"], 12).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 10_000
    placed = positions(rows, ["source", "doc_id"])
    assert placed.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (0, 59_999, 60_000)
    assert placed.filter("doc_id is null").agg(F.max("pos")).first()[0] == 39_999


def test_repeated_null_rows_at_volume_are_sharded_and_mixed(spark):
    null = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    docs = null.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("a").alias("source")))
    per_shard = [r.asDict() for r in sharding.interleave(docs, 24).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()]
    assert len(per_shard) == 24 and all(r["n"] == r["slots"] == r["last"] + 1 in (416, 417) for r in per_shard)
    taken = mixing.mix(docs).groupBy("source_size").agg(F.count("*"), F.sum("taken")).collect()
    assert sorted(map(tuple, taken)) == [(0, 8000, 0), (4000, 2000, 6000)]


def test_hot_keys_are_filtered_and_not_joined(spark):
    """Rows of a hot key and of others meet their fact once; no join holds rows against the hot keys."""
    from docloom.llm.ranking import join_facts
    from docloom.sources.tables import materialize

    rows = materialize(spark.range(3000).selectExpr("id", "if(id < 1000, 7L, if(id = 1000, null, id)) AS k"))
    facts = materialize(rows.groupBy("k").count())
    made = join_facts(rows, facts, "k", "count")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    got = made.collect()
    assert len(got) == 2999 and all(r["count"] == (1000 if r.k == 7 else 1) and r.k == (7 if r.id < 1000 else r.id) for r in got)
