"""Every stage of the pipeline on a table with nulls, repeats, ties, a long text and clashing columns, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `row_key` string, `Times` string, `_copy` string, `a.b` string"
rng = random.Random(11)
SYLLABLES = [a + b for a in "bdfglmnprst" for b in "aeiou"]


def prose(n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n))


ITEM = prose(20) + "? " + prose(10)
LONG = prose(60_000)
TEXTS = [None, "", " \n", "one", *(prose(rng.randint(8, 90)) for _ in range(160)), LONG, LONG + " tail", prose(30) + " " + ITEM + " " + prose(30), "krzxa " * 3 + prose(12)]
ROWS = [(i if i != 7 else None, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "k", "t", "c", "d") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[20], ROWS[20], (20, TEXTS[21], *ROWS[20][2:]), (900, TEXTS[30], "de", *ROWS[30][3:])]


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    train = [(i, prose(30) + (" krzx" + rng.choice(SYLLABLES) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(1000, 1600)]
    docs = spark.createDataFrame(ROWS, COLUMNS)
    labelled = spark.createDataFrame([(i, t, "en", "a", len(t), "k", "t", "c", "d") for i, t, _ in train], COLUMNS)
    spark.createDataFrame([(i, 1, y) for i, _, y in train], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, prose(20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, labelled


def test_toxicity(spark, tables):
    folder, docs, labelled = tables
    both = docs.union(labelled)
    model = toxicity.fit(both, spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        words = (text or "").lower().split()
        said = [sum(float(model.evidence[g]) for g in grams) / len(grams) for grams in (toxicity.ngrams(w, model.config) for w in words)]
        return model.bias + sum(said) / len(said) if words else model.base

    got = rows_of(corpus_pipeline.drop_toxic(spark, both, folder))
    assert got == Counter(tuple(r) for r in both.collect() if score(r.text) < 0)
    kept = {t for _, t, *_ in got}
    assert TEXTS[-1] not in kept and TEXTS[10] in kept and None in kept
    assert corpus_pipeline.drop_toxic(spark, both.filter("false"), folder).count() == 0


def test_near_duplicates(spark, tables):
    folder, docs, _ = tables
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles((r[1] or "").lower().split()) for r in ROWS]
    root = list(range(len(ROWS)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    first = {}
    for r, row in zip(root, ROWS):
        first[r] = min(first.get(r, (True, 10**9)), (row[0] is None, row[0] if row[0] is not None else 0))
    got = rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, folder))
    assert Counter(r[0] for r in got.elements()) == Counter(None if last else i for last, i in first.values())
    assert set(got) <= set(ROWS) and max(got.values()) == 1


def test_decontamination(spark, tables):
    folder, docs, _ = tables
    got = rows_of(corpus_pipeline.drop_leaks(spark, docs, folder))
    assert got == Counter(r for r in ROWS if ITEM not in (r[1] or ""))
    assert corpus_pipeline.drop_leaks(spark, docs.filter("false"), folder).count() == 0


def test_mixture(spark, tables):
    folder, docs, _ = tables
    got = rows_of(corpus_pipeline.mix_sources(spark, docs, folder))
    had = Counter(ROWS)
    assert all(n <= 2 * had[r] and (r[1] or "").split() for r, n in got.items())
    size, taken = Counter(), Counter()
    for r, n in had.items():
        size[r[3]] += n * len((r[1] or "").split())
    for r, n in got.items():
        taken[r[3]] += n * len(r[1].split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 60_001 and all(taken[s] <= 2 * size[s] for s in size)
    assert got == rows_of(corpus_pipeline.mix_sources(spark, docs.repartition(5), folder))
    assert corpus_pipeline.mix_sources(spark, docs.filter("false"), folder).count() == 0


def test_shards_and_the_whole_run(spark, tables, tmp_path):
    folder, docs, labelled = tables
    got = corpus_pipeline.shard(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in ROWS)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.union(labelled).write.parquet(f"{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = step.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == columns, name
    want = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).select("doc_id", "shard", "slot")
    assert rows_of(want) == rows_of(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "shard", "slot"))
    assert step.filter(F.col("text").contains(ITEM)).count() == 0
