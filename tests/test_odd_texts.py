"""Queries over texts without words, against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

_TEXTS = [("", "en"), (" \n\n\t", "en"), (None, "fr"), ("", "xx"), (None, None), ("One. Two.", None), ("  Lead. And trail. \n", "es"), ("w " * 100, "en"), ("w " * 101, "en"), ("x, y. z. ", "de")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO d VALUES (?, ?, ?, 's', ?)", [(i, t, lang, len(t or "")) for i, (t, lang) in enumerate(_TEXTS)] + [(None, "No id.", "en", 6)])
    c.execute(f"COPY d TO '{at}/documents.parquet' (FORMAT parquet)")
    return str(at)


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    got, wanted = entry.queries()[name](spark, folder), c.execute(entry.oracle_sql()[name])
    assert got.columns == [x[0] for x in wanted.description]
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter(wanted.fetchall())
    return rows


def test_a_document_without_words_keeps_its_row(spark, folder):
    rows = same_as_sql(spark, folder, "forced_token_split")
    assert rows[(0, None, None, None, False)] == rows[(2, None, None, None, None)] == 1


def test_documents_without_sentences_are_not_counted(spark, folder):
    rows = same_as_sql(spark, folder, "sentence_stats")
    assert {r[0]: r[3] for r in rows} == {None: 1, "es": 1, "en": 2, "de": 1}
