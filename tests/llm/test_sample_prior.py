import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    """Nine rows in ten have label 1, and the texts say nothing about it."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=20)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = [(i, int(rng.random() < 0.9)) for i in range(1500)]
    return docs, spark.createDataFrame([(i, y, y) for i, y in labels], "doc_id long, quality int, toxic int")


def test_a_cut_sample_keeps_the_prior(tables):
    docs, labels = tables
    model = quality.fit(docs, labels, quality.QualityConfig(rows=160))  # 80 of each label
    scores = np.array([r[0] for r in docs.select(quality.quality(docs, model)).collect()])
    assert scores.mean() == pytest.approx(0.9, abs=0.06)


def test_the_base_rate_of_toxicity_is_that_of_all_rows(tables):
    docs, labels = tables
    base = lambda n: toxicity.fit(docs, labels, toxicity.ToxicityConfig(buckets=1 << 10, steps=2, rows_per_label=(n, n))).base
    assert base(80) == pytest.approx(base(5_000)) and base(80) > 1.9
