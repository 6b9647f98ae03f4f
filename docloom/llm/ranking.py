"""Global positions and running sums without a one-task window, and joins that hot keys do not skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import materialize

_IN_PARTITION = (1 << 33) - 1


def spread(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``df`` in ``n`` sorted ranges of ``order``; rows equal in it are told apart by a hash of their place in the table, so any number of them is split like others."""
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    return tied.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")


def positions(df: DataFrame, order: list[str], running: str | None = None, name: str = "pos") -> DataFrame:
    """Add ``name`` (gapless from 0 in the order of ``order``) to slim rows.

    With ``running``, also ``before``: the sum of that column over all rows in
    front. The rows are range-partitioned and sorted once, so a hot key is
    spread over as many partitions as it needs, and so are equal rows (see spread); only one row per *partition*
    meets in a single task to make the offsets. Rows equal in ``order`` get
    adjacent positions in any order. The input must be cheap to read twice
    (range bounds are sampled from it), so pass a materialized table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pinned = spread(df, order, n).withColumn("_at", F.monotonically_increasing_id())
    pinned = materialize(pinned.select(
        "*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)).alias("_row")).drop("_at"), "ranked")
    totals = pinned.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(running) if running else F.lit(0)).alias("_sum"))
    front = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(front), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(front), F.lit(0)).alias("_sum0"))
    # One row per partition: bounded by spark.sql.shuffle.partitions.
    out = pinned.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_n0") + F.col("_row"))
    if running:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_sum0") + F.coalesce(F.sum(running).over(inside), F.lit(0)))
    return out.drop("_part", "_row", "_n0", "_sum0")


#: A key with more than one in so many rows is hot; there are fewer hot keys than this, whatever the table.
HOT = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of many rows with one fact per key; column ``n`` of the facts counts the rows of their key.

    The facts of hot keys, fewer than HOT rows, are broadcast; all other keys
    are shuffled. Hot keys are told apart by a filter on their values. The rows
    are read more than once, so pass materialized tables.
    """
    total = rows.count()
    hot = [row[0] for row in facts.filter((F.col(n) * HOT > total) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    few = rows.filter(~is_hot).join(facts.filter(~is_hot), key)
    return few.unionByName(rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), key))
