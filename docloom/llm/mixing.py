"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.ranking import positions
from docloom.llm.sharding import shuffle_key
from docloom.llm.texts import WORD
from docloom.sources.tables import materialize

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Add ``target`` (double) and ``place`` to one row per source (no_source, source_key, source_size, source_before).

    Sources in code-point order, null last, get the weights in turn and split
    ``share`` of all sizes by weight. A target stops at ``most`` times its
    source's size and the excess is shared again by weight: the level at which
    all targets are met is found in one pass over the sources sorted by
    size / weight, the order in which they reach their limit. The sources are
    sorted in one task, one small row each: up to some millions of them, however
    many documents they have.
    """
    by_name = Window.orderBy("no_source", "source_key")
    by_ratio = Window.orderBy("ratio", "no_source", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    picked = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(picked, (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
    # what is left, and the weights that share it, if exactly the sources in front stand at their limit
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0)))
    s = s.withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    # the first source, in this order, that stays below its limit fixes the level for all after it
    below = F.col("left") * F.col("weight") / F.col("sharing") < F.col("limit")
    s = s.withColumn("at", F.min(F.when(below, F.struct("ratio", "no_source", "source_key", "left", "sharing"))).over(everything))
    level = F.col("at.left") * F.col("weight") / F.col("at.sharing")
    return s.withColumn("target", F.when(F.col("at").isNull(), F.col("limit")).otherwise(F.least("limit", level))).select(
        "no_source", "source_key", "source_size", "source_before", "place", "target", "budget")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 23, row_key: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, row_key) for every row of ``docs``.

    Each source's documents are shuffled with the seed and queued, ``most``
    passes one after the other. A queued document's virtual finish time is its
    source's cumulative words divided by the source's target. The queue of all
    sources is sorted by finish time and cut at the total budget; the document
    at the cut is taken in part. ``taken`` sums what all passes took of a row,
    ``times`` how many passes took any of it; ``row_key`` names a column that
    the result is to carry.

    A null source is a source of its own and the last; null and wordless texts
    have size 0 and nothing is taken of them; repeated rows queue like any
    others; an empty table gives an empty result. Other columns are not read.
    """
    size = F.expr(f"cast(regexp_count(coalesce(text, ''), r'{WORD}') as bigint)")
    key = F.col(row_key) if row_key else F.lit("")
    slim = materialize(docs.select(
        "doc_id", "source", F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().cast("int").alias("no_source"),
        size.alias("size"), key.alias("row_key")).withColumn("key", shuffle_key(seed, "doc_id", "size")), "slim")
    queue = positions(slim, ["no_source", "source_key", "key", "doc_id", "size", "row_key"], running="size")
    sizes = queue.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"), F.min("before").alias("source_before"))
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    # One row per source, joined by whatever its measured size allows.
    queue = materialize(queue.join(targets, ["no_source", "source_key"]).withColumn("inside", F.col("before") - F.col("source_before") + F.col("size")), "queue")
    entries = queue.filter("size > 0").select(
        "pos", "size", "place", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"), "source_size", "inside", "target")
    entries = entries.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("inside")).cast("double") / F.col("target"))
    merged = positions(materialize(entries.select("pos", "size", "place", "pass", "finish"), "entries"), ["finish", "place", "pass", "pos"], running="size", name="nth")
    budget = int((targets.agg(F.max("budget")).first() or [0])[0] or 0)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(budget).cast("long") - F.col("before")))
    taken = merged.filter(F.col("before") < budget).groupBy("pos").agg(F.sum(part).alias("taken"), F.count(F.lit(1)).cast("int").alias("times"))
    return queue.join(taken, "pos", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("times", F.lit(0)).alias("times"), "row_key")
