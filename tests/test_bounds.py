"""What the tasks of the chunker and of the search hold and look at."""

import pyarrow as pa

from docloom.jobs import queries
from docloom.operators import maxmin


class Captured:
    """A table that keeps what it is given to run."""

    def __init__(self, df):
        self.df, self.schema = df, df.schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_task_plans_documents_in_slices(spark):
    """A batch of any number of documents comes back in slices, cut units in their place."""
    texts = [" ".join(f"w{j}" for j in range(1 + i % 7)) for i in range(600)]
    units = [[{"text": t, "separator": "\n\n", "forced": False}] for t in texts]
    d = spark.createDataFrame([("d", "v", units[0])], "document_id string, document_version string, units array<struct<text string, separator string, forced boolean>>")
    batch = pa.RecordBatch.from_pydict({"document_id": [str(i) for i in range(600)], "document_version": ["v"] * 600, "units": units})
    run = maxmin.plan_chunks(Captured(d), maxmin.ChunkingConfig(min_tokens=1, target_tokens=5, max_tokens=8), count=lambda ts: [len(t) for t in ts])
    made = list(run(iter([batch])))
    assert max(b.num_rows for b in made) <= 256 and sum(b.num_rows for b in made) == 600
    rows = pa.Table.from_batches(made).to_pylist()
    assert [r["document_id"] for r in rows] == [str(i) for i in range(600)]
    for text, row in zip(texts, rows):
        assert "".join((u["separator"] if i else "") + u["text"] for i, u in enumerate(row["units"])) == text
        assert all(u["forced"] == (len(text) > 8) for u in row["units"]) and max(row["tokens"]) <= 8


def test_partitions_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "DOCUMENTS", 10)
    assert queries._spread(spark.range(95)).rdd.getNumPartitions() == 10
