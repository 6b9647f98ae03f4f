import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import embedding, maxmin
from docloom.operators.embedding import EmbeddingConfig


def caller(folder, fail=None, wrong=None):
    """An embedding that leaves a file for each call."""
    def embed(texts):
        if fail and any(fail in t for t in texts):
            raise ConnectionError("lost")
        (folder / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] + ([2.0] if wrong and wrong in t else []) for t in texts]
    return embed


def asked(folder):
    calls = [f.read_text().split("\n") for f in folder.iterdir()]
    return sorted(t for c in calls for t in c), max(map(len, calls), default=0)


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def texts(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "key long, text string").repartition(3)


CONFIG = EmbeddingConfig(model="m", dimensions=2, batch=4, upload=5, retries=0)


def test_each_text_is_asked_for_once(spark, tmp_path, calls):
    store = embedding.embedding_store(f"{tmp_path}/s", 4)
    rows = texts(spark, "a", "bb", "a", None, "", *[f"t{i}" for i in range(10)])
    made = {r.key: (r.embedding, r.embedding_fault) for r in embedding.embed_once(rows, "text", store, caller(calls), CONFIG).collect()}
    assert asked(calls)[0] == sorted({"a", "bb", *[f"t{i}" for i in range(10)]}) and asked(calls)[1] <= 4
    assert made[0] == made[2] == ([1.0, 1.0], None) and made[1] == ([2.0, 1.0], None) and made[3] == made[4] == (None, None)
    assert embedding.fill(store, texts(spark, "a", "new"), "text", caller(calls), CONFIG) == 1
    assert asked(calls)[0].count("a") == 1 and asked(calls)[0].count("new") == 1
    other = EmbeddingConfig(model="other", dimensions=2, retries=0)
    assert embedding.fill(store, texts(spark, "a"), "text", caller(calls), other) == 1
    assert embedding.fill(store, texts(spark, "a"), "text", caller(calls), CONFIG, force=True) == 1
    assert asked(calls)[0].count("a") == 3
    assert embedding.embed_once(rows.filter("false"), "text", embedding.embedding_store(f"{tmp_path}/none"), caller(calls), CONFIG).columns == ["key", "text", "embedding", "embedding_fault"]


def test_a_job_that_is_broken_off_asks_for_the_rest_only(spark, tmp_path, calls):
    store = embedding.embedding_store(f"{tmp_path}/s", 4)
    rows = texts(spark, *[f"t{i}" for i in range(30)], "poison")
    with pytest.raises(Exception, match="lost"):
        embedding.fill(store, rows, "text", caller(calls, fail="poison"), CONFIG)
    held = {r.key for r in store.read(spark).collect()} if store.read(spark) is not None else set()
    before = len(asked(calls)[0])
    left = embedding.fill(store, rows, "text", caller(calls), CONFIG)
    assert left == 31 - len(held) and len(asked(calls)[0]) - before == left
    assert store.read(spark).count() == 31 and embedding.fill(store, rows, "text", caller(calls), CONFIG) == 0


def test_texts_whose_vector_cannot_be_used_have_a_fault(spark, tmp_path, calls):
    store = embedding.embedding_store(f"{tmp_path}/s", 4)
    made = {r.text: (r.embedding, r.embedding_fault) for r in embedding.embed_once(texts(spark, "a", "bad", "c"), "text", store, caller(calls, wrong="bad"), CONFIG).collect()}
    assert made == {"a": ([1.0, 1.0], None), "bad": (None, "unexpected_dimensions"), "c": ([1.0, 1.0], None)}
    assert embedding.fill(store, texts(spark, "a", "bad"), "text", caller(calls), CONFIG) == 1
    assert store.read(spark).filter("fault is not null").count() == 0


def test_calls_are_repeated():
    tried, slept = [], []

    def flaky(items):
        tried.append(items)
        if len(tried) < 4:
            raise TimeoutError
        return items

    assert embedding.retried(flaky, 3, 0.5, slept.append)(["x"]) == ["x"] and slept == [0.5, 1.0, 2.0]
    tried.clear()
    with pytest.raises(TimeoutError):
        embedding.retried(flaky, 1, 0.5, slept.append)(["x"])
    assert len(tried) == 2
    for bad in ({"retries": 11}, {"retries": -1}, {"batch": 0}, {"dimensions": 0}, {"distance": "far"}, {"pause": -1.0}):
        with pytest.raises(ValueError):
            EmbeddingConfig(**bad)
    assert EmbeddingConfig().fingerprint == "local:hashed:32:cosine:none"


@pytest.mark.parametrize("batch", [1, 3, 5, 100])
def test_units_of_several_documents_fill_each_call(batch):
    sizes, calls = [3, 0, 7, 1, 1, 12, 2], []

    def embed(items):
        calls.append(len(items))
        return [[float("nan")] if "d3" in t else [1.0, 2.0] if t == "d5.11" else [1.0 + i] for i, t in enumerate(items)]

    docs = [(d, [f"d{d}.{i}" for i in range(n)], "broken before" if d == 4 else None) for d, n in enumerate(sizes)]
    got = list(maxmin.vectors_in_turn(iter(docs), embed, batch))
    assert [(p, None if v is None else len(v), f) for p, v, f in got] == [
        (0, 3, None), (1, 0, None), (2, 7, None), (3, None, "invalid_vector"), (4, None, "broken before"), (5, None, "inconsistent_dimensions"), (6, 2, None)]
    calls.clear()
    sound = lambda items: calls.append(len(items)) or [[1.0]] * len(items)
    assert sum(len(v) for _, v, f in maxmin.vectors_in_turn(iter([(d, t, None) for d, t, _ in docs]), sound, batch)) == 26
    assert len(calls) == -(-26 // batch) and np.sum(calls) == 26


def test_the_key_of_a_text_comes_with_its_embedding(spark, tmp_path, calls):
    rows = texts(spark, "a", "\u00e9", "e\u0301", "", None).withColumnRenamed("key", "id")
    made = embedding.embed_once(rows, "text", embedding.embedding_store(f"{tmp_path}/s"), caller(calls), CONFIG, key="key")
    assert sorted(made.columns) == ["embedding", "embedding_fault", "id", "key", "text"]
    keys = {r.id: r.key for r in made.collect()}
    assert keys[1] == keys[2] != keys[0] and keys[0].endswith(f":{CONFIG.fingerprint}") and keys[3] is keys[4] is None
    assert asked(calls)[0] == ["a", "e\u0301"]


def test_the_query_looks_through_each_text_once_for_its_rows(spark):
    """The key is made once, and only it goes into the join."""
    import __spark_entry__ as entry

    plan = entry.queries()["embedding_once"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Project" in line)
    assert plan.count("sha2(") == 1 and "text" not in join
