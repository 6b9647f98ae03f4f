"""Exact hard-negative mining: scores bounded from means and deviations of vector segments, refined step by step."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.vectors import LONG, on_lattice, products, sound
from docloom.sources.tables import materialize

SCALE = 256
#: Vectors in a candidate block, and anchors that are held against a block at once.
BLOCK = 4096
ANCHORS = 4096
#: From so many segments on, some candidates are scored exactly to raise the threshold.
SEEDED = 8

Band = tuple[int, int]


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(root of the length times the mean, root of the sum of squared differences) of each segment, for 1, 2, 4, ... segments.

    For a segment of two vectors the product is the product of the first
    numbers, give or take at most the product of the second (Cauchy-Schwarz).
    """
    n, d = vectors.shape
    levels, m = [], 1
    while m < d:
        edges = np.linspace(0, d, m + 1).astype(int)
        lengths = np.diff(edges)
        means = np.add.reduceat(vectors, edges[:-1], axis=1) / lengths
        rest = vectors - np.repeat(means, lengths, axis=1)
        levels.append((means * np.sqrt(lengths), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))))
        m *= 2
    return levels


class Segments:
    """Candidate vectors of a block with the summaries of their segments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            self.levels = summaries(vectors)
            self.norm = float(np.sqrt((vectors * vectors).sum(1).max())) if vectors.size else 0.0
        #: Pairs met, and pairs scored exactly.
        self.met = self.scored = 0

    def best(self, query: np.ndarray, levels: Sequence[tuple[np.ndarray, np.ndarray]], places: np.ndarray, bands: Sequence[Band], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each band (least, most) the k best (place, score) within it among ``places``, ties to the smaller place.

        At each level a candidate goes if its bounds lie outside every band, or
        below k scores that are sure to lie in the band. What is left after the
        finest summaries is scored exactly.
        """
        self.met += len(places)
        alive = places
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-12 * self.norm * float(np.sqrt(query @ query))
        for depth, ((means, spreads), (q_means, q_spreads)) in enumerate(zip(self.levels, levels)):
            if len(alive) <= 2 * k or not math.isfinite(slack):
                break
            if 2 * len(alive) > len(means):
                centre, radius = (means @ q_means)[alive], (spreads @ q_spreads)[alive] + slack
            else:
                centre, radius = means[alive] @ q_means, spreads[alive] @ q_spreads + slack
            low, high = (np.clip(bound, -LONG - 1, LONG) for bound in (centre - radius, centre + radius))  # as scores are
            seeds = np.zeros(0, np.int64)
            if 1 << depth >= SEEDED:
                near = alive if len(alive) <= 4 * k else alive[np.argpartition(np.where(low <= max(most for _, most in bands), centre, -np.inf), -4 * k)[-4 * k:]]
                self.scored += len(near)
                seeds = products(self.vectors[near], query, self.largest)
            keep = np.zeros(len(alive), bool)
            for least, most in bands:
                threshold = float(least)
                if len(seeds):
                    threshold = max(threshold, _kth(seeds[(seeds >= least) & (seeds <= most)], k) - slack, _kth(low[(low >= least) & (high <= most)], k))
                keep |= (high >= threshold) & (low <= most)
            alive = alive[keep]
        self.scored += len(alive)
        scores = products(self.vectors[alive], query, self.largest)
        found = []
        for least, most in bands:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            top = inside[np.lexsort((alive[inside], ~scores[inside]))[:k]]
            found.append((alive[top], scores[top]))
        return found


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, -k)[-k]) if len(scores) >= k else -math.inf


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _search(bands_of: Callable[[object], list[Band]], same_label: bool, k: int) -> Callable:
    """A cogroup of anchors and candidates to (anchor_row, place, row, vec_id, score)."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        block = Segments(_matrix(rows["v"], rows.num_rows))
        labels, own = rows["label"].to_numpy(), rows["row"].to_numpy()
        queries = _matrix(anchors["v"], anchors.num_rows)
        levels = summaries(queries)
        alike: dict[int, np.ndarray] = {}
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        for i, (row, label, given) in enumerate(zip(anchors["row"].to_pylist(), anchors["label"].to_pylist(), anchors["scores"].to_pylist())):
            if label not in alike:
                alike[label] = np.flatnonzero((labels == label) == same_label)
            places = alike[label]
            bands = bands_of(given)
            found = block.best(queries[i], [(m[i], s[i]) for m, s in levels], places[own[places] != row] if same_label else places, bands, k)
            for place, (best, score) in enumerate(found):
                for column, values in zip(out, (np.full(len(best), row), np.full(len(best), place), best, score)):
                    column.append(values)
        row, place, best, score = (pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out)
        return pa.table([row, place, rows["row"].take(best), rows["vec_id"].take(best), score], ["anchor_row", "place", "row", "vec_id", "score"])
    return run


def band(score: int, low: int, high: int) -> Band:
    """The whole numbers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label).

    Components are floor(scale * x), scores integer inner products, best first,
    ties to the smaller vec_id (null last). Anchors are the rows whose vec_id is
    divisible by ``every``; an anchor's positives are its first ``positives``
    other rows of its label; its negatives for a positive are the first
    ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score,
    numbered from 1. Anchors without positives, and positives without
    negatives, give no rows.

    Rows with a null label, a null vector, or null or non-finite components
    take no part; rows with a null id do, but are no anchors. Rows of one id are
    rows of their own, each an anchor and a candidate of the others. Vectors are
    compared with those of their own length; a score that does not fit a long
    counts as the nearest long. An empty table gives an empty result; other
    columns are not read.

    Candidates are dealt by a hash of the row into blocks of about BLOCK,
    whatever their label, and anchors into blocks of about ANCHORS; a pair of
    blocks is one group, bounded in size, and gives at most positives *
    negatives rows an anchor. Every candidate is met once for each block of
    anchors in each of the two rounds.
    """
    part = sound(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(F.col("label").isNotNull()))
    rows = materialize(part.select("vec_id", "label", F.transform("embedding", lambda x: on_lattice(x, scale)).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blocks, anchor_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_anchors / ANCHORS))
    dealt = rows.withColumn("dim", F.size("v"))
    anchors = dealt.filter(is_anchor)
    keys = ("dim", "block", "anchor_block")
    candidates = dealt.select(
        "dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchor_block"),
        "row", "vec_id", "label", "v").groupBy(*keys)

    def found(queries: DataFrame, scores: Column, bands_of: Callable, same_label: bool, k: int) -> DataFrame:
        spread = queries.select(
            "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(anchor_blocks)).cast("int").alias("anchor_block"),
            "row", "label", "v", scores.alias("scores"))
        met = spread.groupBy(*keys).cogroup(candidates).applyInArrow(_search(bands_of, same_label, k), "anchor_row long, place long, row long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
        return met.withColumn("rank", rank).filter(F.col("rank") <= k)

    like = found(anchors, F.lit(None).cast("array<long>"), lambda _: [(-LONG - 1, LONG)], True, positives)
    like = materialize(like.select("anchor_row", F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # at most ``positives`` to an anchor
    held = like.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("held"))
    scored = materialize(anchors.join(held, "row").withColumn("scores", F.col("held.positive_score")).drop("held"), "anchors")
    unlike = found(scored, F.col("scores"), lambda scores: [band(s, low, high) for s in scores], False, negatives)
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return unlike.withColumn("nth", F.col("place") + 1).drop("row", "place").join(
        like.withColumnRenamed("rank", "nth"), ["anchor_row", "nth"]).join(named, "anchor_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
