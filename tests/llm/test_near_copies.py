import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicate_stage_keeps_one_of_each_near_copy(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "FOLLOWERS", block)
    rng = random.Random(4)
    texts = [None, "", "  ", "one two", "One  TWO", "one two three"]
    for _ in range(12):
        w = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 120))]
        texts.append(" ".join(w))
        for _ in range(6):
            copy = list(w)
            for _ in range(rng.randint(0, 4)):  # about five shingles a change: similarities from 1 to below 0.8
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy).upper() if rng.random() < .2 else " ".join(copy))
    rows = list(enumerate(texts))
    want = sorted(set(brute_components(texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert 10 < len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want
    assert corpus_pipeline.drop_near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_large_families_are_split_and_still_joined(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "FOLLOWERS", 8)
    w = [f"w{i}" for i in range(200)]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(w) + " end"), F.col("id").cast("string")).alias("text"))
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [0]


def test_chains_that_their_leader_is_unlike(spark, monkeypatch):
    """Each text is like its neighbours only, so links beyond the leader decide; the band values are made equal for all."""
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    texts = [" ".join(f"w{j}" for j in range(8 * i, 8 * i + 100)) for i in range(20)] + ["other words " * 5]
    classes = [(i, t, [1, 2 + i % 2], f"k{i}") for i, t in enumerate(texts)]
    made = spark.createDataFrame([(i, b, k) for i, _, b, k in classes], "class long, bands array<long>, row_key string")
    docs = spark.createDataFrame([(t, k) for _, t, _, k in classes], "text string, k string")
    links = {tuple(sorted((r.a, r.b))) for r in near_copies._class_links(made, docs, "k").collect()}
    root = brute_components(texts)
    assert all(root[a] == root[b] for a, b in links) and len(set(root)) == 2
    at = list(range(len(texts)))
    for a, b in sorted(links):
        at = [min(at[a], at[b]) if x in (at[a], at[b]) else x for x in at]
    assert at == root
