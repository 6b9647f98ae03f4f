"""Contexts within a budget: a greedy choice by rank, for groups of any size."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import materialize


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether the key is another than before, rows) of a partition that is sorted by ``key``; a run that goes on in the next batch is carried on."""
    last: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        before, after = keys.slice(0, len(keys) - 1), keys.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(pc.is_null(before), pc.is_null(after)))
        borders = [0, *(np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]
        for first, stop in zip(borders, borders[1:]):
            yield bool(first) or last != [keys[0].as_py()], batch.slice(first, stop - first)
        last = [keys[len(keys) - 1].as_py()]


def _possible(most: int) -> Callable:
    """Rows that may fit: those with fewer than ``most`` rows of no more tokens before them.

    If a row fits, all before it that are no larger have been taken, as the
    budget was no smaller then. This holds within any part of a group, so parts
    are looked at where they lie; what is left of n rows is about most * ln(n).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[int] = []  # the smallest sizes so far, negative, largest first
        for fresh, rows in sorted_runs(batches, "g"):
            if fresh:
                least = []
            sizes, kept = rows.column("n").to_numpy(), []
            at = 0
            while len(least) < most and at < len(sizes):
                heapq.heappush(least, -int(sizes[at]))
                kept.append(at)
                at += 1
            if at < len(sizes):
                for i in (np.flatnonzero(sizes[at:] < -least[0]) + at).tolist():
                    if sizes[i] < -least[0]:
                        heapq.heapreplace(least, -int(sizes[i]))
                        kept.append(i)
            if kept:
                yield rows.take(pa.array(kept))
    return run


def _chosen(max_tokens: int, max_chunks: int) -> Callable:
    """The rows that fit, with the tokens used up to each; the state of a group is carried from batch to batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = count = 0
        for fresh, rows in sorted_runs(batches, "g"):
            if fresh:
                used = count = 0
            kept, sums = [], []
            for i, n in enumerate(rows.column("n").to_pylist()):
                if count < max_chunks and used + n <= max_tokens:
                    used, count = used + n, count + 1
                    kept.append(i)
                    sums.append(used)
            if kept:
                yield pa.RecordBatch.from_arrays([rows.column("row").take(pa.array(kept)), pa.array(sums, pa.int64())], ["row", "used"])
    return run


def context_decisions(candidates: DataFrame, group: str, rank: str, tokens: str, item: str, max_tokens: int = 6000, max_chunks: int = 6) -> DataFrame:
    """(group, rank, item, tokens, included, used) of every candidate: a greedy choice by rank within a budget of tokens and chunks.

    A candidate that does not fit is left out and the next one is tried; ``used``
    is the budget spent up to an included one, else null. Equal ranks go by
    item, null ranks come last, null or negative tokens count as 0, rows with a
    null group are a group, repeated rows are candidates of their own. The group
    is of any type that sorts but a floating one.

    No group is gathered: each task drops, from its own rows in order, those
    that cannot fit (see _possible); what is left, a few rows a group and task,
    is shuffled by group and folded in order with state carried along. So a
    group may have any number of candidates and hold any share of all rows.
    """
    if max_tokens < 1 or max_chunks < 1:
        raise ValueError("budgets must be at least 1")
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    slim = candidates.select(F.col(group).alias("g"), F.col(rank).alias("r"), F.col(item).alias("i"), size.alias("n"), F.col(tokens).alias("t"))
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "candidates")
    order = [F.asc_nulls_first("g"), F.asc_nulls_last("r"), F.asc_nulls_last("i"), F.asc("row")]
    fields = slim.select("g", "r", "i", "n", "row")
    possible = fields.sortWithinPartitions(*order).mapInArrow(_possible(max_chunks), fields.schema)
    chosen = possible.repartition("g").sortWithinPartitions(*order).mapInArrow(_chosen(max_tokens, max_chunks), "row long, used long")
    return slim.join(chosen, "row", "left").select(
        F.col("g").alias(group), F.col("r").alias("rank"), F.col("i").alias("item"), F.col("t").alias("tokens"), F.col("used").isNotNull().alias("included"), "used")


def assemble_context(candidates: DataFrame, group: str, rank: str, tokens: str, item: str, max_tokens: int = 6000, max_chunks: int = 6) -> DataFrame:
    """(group, included, excluded, token_count): the items of context_decisions as two lists for each group, by rank.

    ``included`` has at most max_chunks items; ``excluded`` has all others of
    the group in one row, so take context_decisions for groups that are larger
    than a row.
    """
    named = candidates.select(F.col(group).alias("_group"), F.col(rank).alias("_rank"), F.col(tokens).alias("_tokens"), F.col(item).alias("_item"))
    made = context_decisions(named, "_group", "_rank", "_tokens", "_item", max_tokens, max_chunks)
    entry = F.struct(F.col("rank").isNull().alias("last"), "rank", "item")
    listed = lambda wanted: F.transform(F.array_sort(F.collect_list(F.when(F.col("included") == wanted, entry))), lambda x: x["item"])
    return made.groupBy(F.col("_group").alias(group)).agg(listed(True).alias("included"), listed(False).alias("excluded"), F.coalesce(F.max("used"), F.lit(0).cast("long")).alias("token_count"))
