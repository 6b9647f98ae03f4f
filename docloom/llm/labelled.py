"""Bounded samples of labelled texts for the classifiers, and Arrow columns that score every text."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.texts import fold
from docloom.sources.tables import materialize

FOLDS = 5
#: A worker forgets the words it has seen after so many, so that its memory stays bounded.
_WORDS = 250_000


def fit_on_sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], featurize: Callable[[str], object], train: Callable[[list, np.ndarray, np.ndarray], object]):
    """``train(features, labels, totals)`` in one task, on at most ``rows[y]`` texts of each label y.

    Rows whose crc32(doc_id) mod FOLDS is 0 are held out and never read as
    labels; null ids and labels take no part, an id with both labels counts
    for both. The sample is the first rows by a hash of the id, then by the id
    and a hash of the text, of all rows of the learning folds that have a label:
    it depends neither on the order of the tables nor on repeated rows, which
    count once in it. Texts are read whole, of any length; the task that
    trains gets ``featurize(text)``, made where the text was scanned, so what it
    holds follows the distinct words of a text. ``totals`` are the counts of
    labels 0 and 1 over all labelled rows of the learning folds, so that
    ``train`` can undo what the bounds do to the shares. Only the model, whose
    size is fixed, comes to the driver.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(list(rows)) & (fold("id", FOLDS) != 0)).distinct()
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"))
    labelled = materialize(slim.join(usable, "id"), "labelled")
    counted = dict(labelled.groupBy("y").agg(F.count(F.lit(1))).collect())
    totals = np.array([counted.get(0, 0), counted.get(1, 0)], np.float64)
    distinct, wanted = labelled.distinct(), None
    for y, n in rows.items():
        part = distinct.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id", "text_hash").limit(n)
        wanted = part if wanted is None else wanted.union(part)

    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pickle.dumps(featurize(t)))

    # Bounded by sum(rows.values()).
    found = docs.select(F.col("doc_id").alias("id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "text_hash"])
    sample = found.select("id", "y", "text_hash", made("text").alias("features")).dropDuplicates(["id", "y", "text_hash"])

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["id", "y", "text_hash"])
        return pd.DataFrame({"model": [pickle.dumps(train([pickle.loads(f) for f in sample["features"]], sample["y"].to_numpy(np.float64), totals))]})

    model = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").first()
    return pickle.loads(model[0]) if model else train([], np.zeros(0), totals)


def score_column(score: Callable[[list, dict], np.ndarray], text: Column, limit: int = 1 << 20) -> Column:
    """An Arrow UDF column: ``score(texts, words seen before)`` over blocks of about ``limit`` characters."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in batches:
            sizes = texts.str.len().to_numpy()
            out, begin, held = np.zeros(len(texts)), 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or held and held + sizes[i] > limit:
                    if begin < i:
                        out[begin:i] = score(texts.iloc[begin:i].tolist(), known)
                    if len(known) > _WORDS:
                        known.clear()
                    begin, held = i, 0
                held += sizes[i] if i < len(texts) else 0
            yield pd.Series(out)
    return run(text)
