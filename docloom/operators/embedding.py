"""Embeddings asked for once: a store by content and model, filled batch by batch."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.identity import content_checksum, embedding_fingerprint
from docloom.operators.maxmin import Embed, ProviderFault, embedded
from docloom.sources.store import Store
from docloom.sources.tables import materialize


@dataclass(frozen=True)
class EmbeddingConfig:
    """A model and how it is asked: texts to a call, texts to a write, and how often a failing call is made again."""
    provider: str = "local"
    model: str = "hashed"
    dimensions: int = 32
    distance: str = "cosine"
    normalization: str = "none"
    batch: int = 32
    upload: int = 100_000
    retries: int = 3
    #: Seconds before the first repetition; each further one waits twice as long.
    pause: float = 1.0

    def __post_init__(self):
        faults = [what for what, bad in (
            ("dimensions must be at least 1", self.dimensions < 1),
            ("batch and upload must be at least 1", self.batch < 1 or self.upload < 1),
            ("retries must be from 0 to 10", not 0 <= self.retries <= 10),
            ("pause must not be negative", self.pause < 0),
            ("distance is unknown", self.distance not in ("cosine", "dot", "euclid", "manhattan")),
        ) if bad]
        if faults:
            raise ValueError("; ".join(faults))

    @property
    def fingerprint(self) -> str:
        return embedding_fingerprint(self.provider, self.model, self.dimensions, self.distance, self.normalization)


def retried(call: Callable, retries: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, made again up to ``retries`` times if it raises anything but a ProviderFault; the last error is raised."""
    def run(texts: list[str]):
        for attempt in range(retries + 1):
            try:
                return call(texts)
            except ProviderFault:
                raise
            except Exception:
                if attempt == retries:
                    raise
                sleep(pause * 2 ** attempt)
    return run


def content_key(text: Column, config: EmbeddingConfig) -> Column:
    """The checksum of a text with the fingerprint of the model: equal texts have one embedding each model."""
    return F.concat_ws(":", content_checksum(text), F.lit(config.fingerprint))


def _ask(embed: Embed, config: EmbeddingConfig) -> Callable:
    """(key, embedding, fault) of (key, text): calls of ``batch`` texts, whatever Arrow batch or document they are from; of a call that is answered wrongly each text is asked alone."""
    call = retried(embed, config.retries, config.pause)

    def answer(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = embedded(texts, call, len(texts))
            if vectors.shape[1] != config.dimensions:
                raise ProviderFault("unexpected_dimensions")
            return [(v, None) for v in vectors.tolist()]
        except ProviderFault as e:
            return [(None, str(e))] if len(texts) == 1 else [x for t in texts for x in answer([t])]

    def made(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        found = answer([text for _, text in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([key for key, _ in rows], pa.string()), pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([f for _, f in found], pa.string())], ["key", "embedding", "fault"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        for batch in batches:
            held += zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())
            while len(held) >= config.batch:
                yield made(held[:config.batch])
                del held[:config.batch]
        if held:
            yield made(held)
    return run


def embedding_store(path: str, buckets: int = 64) -> Store:
    """The store of (key, embedding, fault); one holds the embeddings of any number of models."""
    return Store(path, "key", buckets)


def fill(store: Store, texts: DataFrame, text: str, embed: Embed, config: EmbeddingConfig = EmbeddingConfig(), force: bool = False) -> int:
    """Ask for the embeddings of all texts that the store does not hold yet, and return how many these were.

    Each distinct text is asked for once; null and empty ones are not. Texts are
    dealt by key into parts of about ``upload``, each asked for by all tasks and
    then put into the store, so a job that is broken off has lost no more than
    the part it was at. A text whose vector cannot be used is kept with its fault
    and asked for again next time. ``force`` asks for all anew. A call that
    raises is repeated (see EmbeddingConfig) and then fails its task, which
    Spark repeats.
    """
    spark = texts.sparkSession
    wanted = texts.select(F.col(text).alias("text")).filter(F.coalesce(F.col("text"), F.lit("")) != "").select(content_key(F.col("text"), config).alias("key"), "text")
    wanted = wanted.groupBy("key").agg(F.min("text").alias("text"))
    held = store.read(spark)
    if held is not None and not force:
        wanted = wanted.join(held.filter("fault is null").select("key"), "key", "left_anti")
    todo = materialize(wanted, "texts")
    n = todo.count()
    parts = math.ceil(n / config.upload)
    part = F.pmod(F.xxhash64("key", F.lit(parts)), F.lit(parts or 1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(parts):
        own = todo.filter(part == i)
        # a task should fill some calls
        dealt = own.repartition(max(1, min(tasks, math.ceil(n / parts / config.batch))), "key")
        store.merge(dealt.mapInArrow(_ask(embed, config), "key string, embedding array<double>, fault string"))
    return n


def embed_once(rows: DataFrame, text: str, store: Store, embed: Embed, config: EmbeddingConfig = EmbeddingConfig(), force: bool = False, key: str | None = None) -> DataFrame:
    """``rows`` with ``embedding`` and ``embedding_fault`` from the store, which is filled first (see fill); both are null for null and empty texts.

    ``key`` names a column for the key of each text (see content_key), null for
    null and empty ones; whoever needs it takes it from here, as it costs a look
    through the text, and texts that nobody reads any more are not joined.
    """
    spark: SparkSession = rows.sparkSession
    fill(store, rows, text, embed, config, force)
    held, name = store.read(spark), key or "_key"
    keyed = rows.withColumn(name, F.when(F.col(text) != "", content_key(F.col(text), config)))
    if held is None:
        made = keyed.withColumns({"embedding": F.lit(None).cast("array<double>"), "embedding_fault": F.lit(None).cast("string")})
    else:
        made = keyed.join(held.select(F.col("key").alias(name), "embedding", F.col("fault").alias("embedding_fault")), name, "left")
    return made if key else made.drop("_key")
