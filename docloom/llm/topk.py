"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.vectors import EXACT, on_lattice, products, sound
from docloom.sources.tables import materialize

SCALE = 256
#: Vectors in a candidate block, and queries that are held against a block at once.
BLOCK = 4096
QUERIES = 2048


class SortedLists:
    """Candidate vectors of a block with one list per dimension, sorted by that component."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)
        self.largest = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0

    def search(self, query_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (position, score) for one query, ties to the smaller id, its own row left out.

        Sorted access goes down all lists together, from the end at which the
        query's component makes the product largest, twice as deep each time;
        every vector met for the first time is scored in full. No vector unmet
        can score more than the sum of the products at the depth reached, so
        the search stops as soon as that bound is below the kth score, or
        every vector has been met.
        """
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        falling = query[used] > 0
        exact = self.largest * float(np.abs(query).max(initial=0)) * dims < EXACT
        met = np.zeros(n, bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while depth < n:
            deeper = min(n, max(8, depth * 2)) if len(used) else n
            if len(used):
                span = np.arange(depth, deeper)
                at = np.where(falling, n - 1 - span[:, None], span[:, None])
                fresh = np.zeros(n, bool)
                fresh[self.lists[at, used]] = True
                new = np.flatnonzero(fresh & ~met)
                terms = self.values[at[-1], used] * query[used]
                # rounding must not take the bound below what a vector can reach
                bound = terms.sum() + (0 if exact else 1e-9 * np.abs(terms).sum())
            else:
                new, bound = np.arange(n), 0
            met[new] = True
            depth = deeper
            new = new[self.rows[new] != query_row]
            best = np.concatenate([best, new])
            score = np.concatenate([score, products(self.vectors[new], query, self.largest)])
            if len(best) > k:
                # positions follow the ids, so equal scores go to the smaller id
                top = _order(best, score)[:k]
                best, score = best[top], score[top]
            if met.all() or len(best) == k and bound < score.min():
                break
        top = _order(best, score)[:k]
        return best[top], score[top]


def _order(places: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Falling scores, ties to the smaller place; ~score is -score - 1, which every long has."""
    return np.lexsort((places, ~scores))


def _search_block(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(rows):
            lists = SortedLists(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), np.stack(rows["v"].to_list()).astype(float))
            for query_row, query_id, query in zip(queries["row"].to_numpy(), queries["vec_id"].to_numpy(), queries["v"]):
                best, score = lists.search(query_row, np.asarray(query, float), k)
                out.append((np.full(len(best), query_row), np.full(len(best), query_id), lists.rows[best], lists.ids[best], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(("query_row", "query_id", "row", "vec_id", "score"), columns)))
    return run


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): components as floor(scale * x), in doubles, and a key of each row's own; vectors that take no part are left out."""
    part = sound(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull()))
    return part.select("vec_id", F.transform("embedding", lambda x: on_lattice(x, scale)).alias("v")).withColumn("row", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, by integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates of
    a query are all rows but itself; equal scores go to the smaller vec_id.
    Rows with one vec_id are rows of their own: each is a query with k results
    and a candidate of the others, whether their vectors are equal or not. Rows
    with a null id, and vectors that are null or hold null or non-finite
    components, take no part; a score that does not fit a long counts as the
    nearest long; vectors are compared with those of their own dimension only;
    an empty table gives an empty result; other columns are not read.

    Candidates are dealt by a hash of the row into blocks of about BLOCK
    vectors and queries into blocks of about QUERIES, whose number follows the
    table's size; each pair of blocks is one group, bounded in size, and gives
    at most k rows a query.
    """
    rows = materialize(quantized(vectors, scale), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_queries / QUERIES))
    dealt = rows.withColumn("dim", F.size("v"))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int")
    candidates = dealt.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), "row", "vec_id", "v")
    queries = dealt.filter(F.col("vec_id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), query_block.alias("query_block"), "row", "vec_id", "v")
    keys = ("dim", "block", "query_block")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(_search_block(k), "query_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
