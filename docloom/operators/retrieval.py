"""Vector search in blocks, and what retrieval does with its hits."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docloom.functions.vectors import vector_fault
from docloom.operators.maxmin import Embed, ProviderFault, embedded
from docloom.sources.tables import materialize

#: Metrics and whether more is better.
METRICS = {"cosine": True, "dot": True, "euclid": False, "manhattan": False}
#: Rows and queries of a block; blocks are larger where there are more than a few to a task, up to so many numbers.
BLOCK, QUERIES = 8192, 4096
MOST_VALUES = 1 << 22
#: The largest top_k.
MOST_HITS = 100


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 12
    distance: str = "cosine"
    score_threshold: float | None = None
    max_per_document: int | None = None
    neighbors: int = 0

    def __post_init__(self):
        faults = [what for what, bad in (
            ("top_k must be from 1 to 100", not 1 <= self.top_k <= MOST_HITS),
            ("distance is unknown", self.distance not in METRICS),
            ("max_per_document must be at least 1", self.max_per_document is not None and self.max_per_document < 1),
            ("neighbors must be from 0 to 2", not 0 <= self.neighbors <= 2),
        ) if bad]
        if faults:
            raise ValueError("; ".join(faults))


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("dot", "cosine"):  # vectors have length one for cosines
        return queries @ rows.T
    if metric == "euclid":
        return np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in queries])
    return np.stack([np.abs(rows - q).sum(axis=1) for q in queries])


def _best(raw: np.ndarray, ids: np.ndarray, own: int, owners: np.ndarray | None, k: int, cap: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of the k rows of least cost but those of id ``own``, ties by position, of an owner the first ``cap`` only.

    Costs are ``raw`` rounded to six decimals. No more rows are sorted than cost
    as little as the mth of the first ones; where that leaves fewer than k, m
    grows till all rows have been looked at.
    """
    m = 4 * k if cap is not None else k + 1
    while True:
        bound = np.partition(raw[:max(_HEAD, m)], m - 1)[m - 1] if m < len(raw) else np.inf
        some = bool(np.isfinite(bound))
        # rounding moves a cost by less than the slack
        near = np.flatnonzero(raw <= bound + 1e-6 + 1e-12 * abs(bound)) if some else np.arange(len(raw))
        near = near[ids[near] != own]
        cost = np.round(raw[near], 6) + 0.0
        if some:
            near, cost = near[cost <= np.round(bound, 6)], cost[cost <= np.round(bound, 6)]
        order = np.argsort(cost, kind="stable")
        near, cost = near[order], cost[order]
        if cap is not None and len(near):
            # a row with k better ones within their owners' caps here has them everywhere
            grouped = np.argsort(owners[near], kind="stable")
            starts = np.flatnonzero(np.diff(owners[near][grouped], prepend=-1))
            rank = np.empty(len(near), np.int64)
            rank[grouped] = np.arange(len(near)) - np.repeat(starts, np.diff(starts, append=len(near)))
            near, cost = near[rank < cap], cost[rank < cap]
        if len(near) >= k or not some:
            return near[:k], cost[:k]
        m *= 4


#: Rows whose costs bound what is looked at, and scores that are computed at once.
_HEAD, _SCORES = 4096, 1 << 19


def _search_block(metric: str, k: int, cap: int | None):
    better = -1 if METRICS[metric] else 1
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": [], "owner": []}
        if len(queries) and len(rows):
            q, v = np.stack(queries["v"].to_list()).astype(float), np.stack(rows["v"].to_list()).astype(float)
            place = np.lexsort((rows["row"].to_numpy(), rows["vec_id"].to_numpy()))  # ties go by position from here on
            v, ids, numbers, names = v[place], *(rows[n].to_numpy()[place] for n in ("vec_id", "row", "owner"))
            owners = pd.factorize(names)[0] if cap is not None else None
            qids, asked = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
            if metric == "cosine":
                q, v = unit(q), unit(v)
            step = max(1, min(64, _SCORES // len(v)))
            for at in range(0, len(q), step):
                costs = better * _scores(q[at:at + step], v, metric)
                for i, raw in enumerate(costs):
                    order, cost = _best(raw, ids, qids[at + i], owners, k, cap)
                    for column, values in (("query_row", asked[at + i]), ("query_id", qids[at + i])):
                        out[column].append(np.full(len(order), values))
                    for column, values in (("row", numbers), ("vec_id", ids), ("owner", names)):
                        out[column].append(values[order])
                    out["score"].append(better * cost + 0.0)
        columns = {n: np.concatenate(x) if x else np.zeros(0) for n, x in out.items()}
        return pd.DataFrame(columns | {"owner": pd.Series(columns["owner"], dtype=object)})
    return run


def search(vectors: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), owner: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the top_k nearest vectors of each query, without its own id.

    ``vectors`` and ``queries`` have (vec_id, embedding); filter them before the
    search. Scores are rounded to six decimals before they are ranked, ties go
    to the smaller id; distances rank from the smallest. ``owner`` names the
    column, of any type, that max_per_document counts by; null is an owner too.
    Unusable vectors take no part. Rows of one id are rows of their own, queries
    of one id are each answered.

    Vectors and queries are dealt into bounded blocks by their place in the
    table, so no id makes a block large; a pair of blocks is one group and gives
    at most top_k rows a query.
    """
    of = F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")) if owner else F.lit("")
    ready = lambda df, *more: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *more).filter(
        F.col("vec_id").isNotNull() & vector_fault(F.col("v")).isNull()).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    rows, asked = materialize(ready(vectors, of.alias("owner")), "vectors"), materialize(ready(queries), "queries")
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    (n, dim), (m, query_dim) = size(rows), size(asked)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(math.ceil(n / BLOCK), max(4 * tasks, math.ceil(n * dim / MOST_VALUES))))
    query_blocks = max(1, math.ceil(m / min(QUERIES, max(1, MOST_VALUES // query_dim))))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int")
    rows = rows.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), "row", "vec_id", "v", "owner")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), query_block.alias("query_block"), "row", "vec_id", "v")
    keys = ("dim", "block", "query_block")
    capped = config.max_per_document is not None
    hits = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(
        _search_block(config.distance, config.top_k, config.max_per_document), "query_row long, query_id long, row long, vec_id long, score double, owner string")
    up = METRICS[config.distance]
    if config.score_threshold is not None:
        hits = hits.filter(F.col("score") >= config.score_threshold if up else F.col("score") <= config.score_threshold)
    order = [F.desc("score") if up else F.asc("score"), F.asc("vec_id"), F.asc("row")]
    if capped:
        hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_row", "owner").orderBy(*order))).filter(F.col("nth") <= config.max_per_document)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).filter(F.col("rank") <= config.top_k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_parents(children: DataFrame, queries: DataFrame, parent: str, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, rank, parent, vec_id, score): the top_k nearest parents of each query, each once with its best child.

    ``children`` have (vec_id, embedding), each id once, and the column
    ``parent``; a parent scores as its nearest child does (see search).
    """
    hits = search(children, queries, replace(config, max_per_document=1), parent)
    return hits.join(children.select("vec_id", F.col(parent).alias("parent")), "vec_id").select("query_id", "rank", "parent", "vec_id", "score")


def embed_texts(rows: DataFrame, text: str, embed: Embed, batch: int = 32) -> DataFrame:
    """``rows`` with ``embedding``: the vectors of a text column, asked for ``batch`` at a time; empty and null texts have none, nor have those whose vector cannot be used."""
    def usable(texts: list[str]) -> list:
        try:
            return embedded(texts, embed, batch).tolist()
        except ProviderFault:
            return [None] if len(texts) == 1 else [v for t in texts for v in usable([t])]

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = texts[texts.fillna("") != ""]
        for at in range(0, len(some), batch):
            part = some.iloc[at:at + batch]
            for i, v in zip(part.index, usable(part.tolist())):
                out.at[i] = v
        return out
    return rows.withColumn("embedding", run(F.col(text)))


def metadata_filter(rows: DataFrame, *, ids: list | None = None, sources: list[str] | None = None, languages: list[str] | None = None,
                    labels: list[int] | None = None, date_from=None, date_to=None, date: str = "date") -> DataFrame:
    """Rows that pass every given filter; None filters nothing. Plain predicates, so they reach the scan."""
    if date_from is not None and date_to is not None and date_to < date_from:
        raise ValueError("date_to must not be before date_from")
    for column, values in (("doc_id", ids), ("source", sources), ("lang", languages), ("label", labels)):
        if values is not None:
            rows = rows.filter(F.col(column).isin(values))
    if date_from is not None:
        rows = rows.filter(F.col(date) >= F.lit(date_from))
    if date_to is not None:
        rows = rows.filter(F.col(date) <= F.lit(date_to))
    return rows


def expand_neighbors(hits: DataFrame, chunks: DataFrame, reach: int, group: str, index: str) -> DataFrame:
    """(group, index) of the hits and of up to ``reach`` chunks to either side that exist, each once."""
    if not 0 <= reach <= 2:
        raise ValueError("neighbors must be from 0 to 2")
    around = hits.select(group, F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index)).distinct()
    return chunks.join(around, [group, index], "left_semi")


def upsert(stored: DataFrame | None, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last writer by ``order``, the batch over what is stored."""
    rows = batch.withColumn("_new", F.lit(1))
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("_new", F.lit(0)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), *order))
    return rows.withColumn("_nth", last).filter("_nth = 1").drop("_nth", "_new")
