import random

import pytest
from pyspark.sql import functions as F

from docloom.sources.store import Store

SCHEMA = "id int, v string, _key int"


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def held(store, spark, version=None):
    return sorted(map(tuple, store.read(spark, version).collect()), key=str)


def test_batches_against_a_dictionary(spark, tmp_path):
    rng, store, want = random.Random(5), Store(f"{tmp_path}/s", "id", buckets=5), {}
    assert store.read(spark) is None and store.version(spark) == 0
    for n in range(1, 7):
        batch = [(rng.choice([None, *range(30)]), f"{n}-{i}", rng.randint(0, 99)) for i in range(rng.choice([0, 3, 12]))]
        gone = rng.sample(range(30), 4) if n % 2 else []
        for k in gone:
            want.pop(k, None)
        firsts = {}
        for r in sorted(batch, key=lambda r: r[1]):
            firsts[r[0]] = r
        want |= firsts
        assert store.merge(rows(spark, *batch), [F.desc("v")], removed=spark.createDataFrame([(k,) for k in gone], "id int")) == n
        assert held(store, spark) == sorted(want.values(), key=str)


def test_rows_of_a_key_are_replaced_together_and_versions_stay(spark, tmp_path):
    store = Store(f"{tmp_path}/s", "id", buckets=3)
    store.merge(rows(spark, (1, "a", 0), (1, "b", 0), (2, "c", 0), (None, "n", 0)))
    store.merge(rows(spark, (1, "d", 0), (None, "m", 0), (None, "m", 0)))
    assert held(store, spark) == [(1, "d", 0), (2, "c", 0), (None, "m", 0), (None, "m", 0)]
    assert held(store, spark, 1) == [(1, "a", 0), (1, "b", 0), (2, "c", 0), (None, "n", 0)]
    with pytest.raises(ValueError, match="columns"):
        store.merge(rows(spark, (1, "a", 0)).drop("v"))
    store.merge(rows(spark), removed=spark.createDataFrame([(1,), (2,), (None,)], "id int"))
    assert held(store, spark) == [] and store.version(spark) == 3
    assert store.read(spark).columns == ["id", "v", "_key"]


def test_interrupted_and_repeated_batches_leave_one_version(spark, tmp_path, monkeypatch):
    store = Store(f"{tmp_path}/s", "id", buckets=4)
    store.merge(rows(spark, *[(i, "old", 0) for i in range(20)]), batch_id="b0")
    batch = rows(spark, *[(i, "new", 0) for i in range(0, 20, 3)])

    def broken(*args, **more):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", broken)  # the step before the manifest
        with pytest.raises(RuntimeError):
            store.merge(batch, batch_id="b1")
    assert store.version(spark) == 1 and {r.v for r in store.read(spark).collect()} == {"old"}
    assert [store.merge(batch, batch_id="b1") for _ in range(3)] == [2, 2, 2]
    assert store.merge(rows(spark, (0, "other", 0)), batch_id="b0") == 1
    assert held(store, spark) == sorted(((i, "old" if i % 3 else "new", 0) for i in range(20)), key=str)


def test_only_touched_buckets_are_written_and_old_files_go(spark, tmp_path):
    store = Store(f"{tmp_path}/s", "id", buckets=8)
    store.merge(rows(spark, *[(i, "x", 0) for i in range(200)]))
    for v in "abc":
        store.merge(rows(spark, (7, v, 0)))
    folders = sorted((tmp_path / "s" / "data").iterdir(), key=lambda p: p.stat().st_mtime)
    assert [len(list(f.glob("_bucket=*"))) for f in folders] == [8, 1, 1, 1]
    assert store.vacuum(spark, keep=2) == 2
    assert len(held(store, spark)) == len(held(store, spark, 3)) == 200 and (7, "c", 0) in held(store, spark)
    with pytest.raises(ValueError):
        store.vacuum(spark, keep=0)
