"""Parents and chunks rendered in one pass; sentences and NFC by quicker patterns."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.functions import identity, text
from docloom.operators import maxmin, sentences
from test_odd_texts import folder, same_as_sql  # noqa: F401


def test_chunks_of_both_levels_are_rendered_once(spark, folder):  # noqa: F811
    found = entry.queries()["parent_chunks"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate ", found)) == len(re.findall(r"MapInArrow ", found)) == len(re.findall("Relation ", found)) == 1
    assert same_as_sql(spark, folder, "parent_chunks")


def test_families_are_the_chunks_of_both_plans(spark):
    texts = [("d", "Aa bb. Cc dd ee. Ff gg. Hh ii. Jj kk ll."), ("e", "One."), ("f", "")]
    schema = "document_id string, document_version string, elements array<struct<element_id string, element_type string, text string, heading_path array<string>, page_number int, order int>>"
    docs = sentences.units(spark.createDataFrame([(i, None if i == "e" else "v", [("e", "paragraph", t, ["H"], 1, 0)]) for i, t in texts], schema))
    c = maxmin.ChunkingConfig(min_tokens=1, target_tokens=2, max_tokens=3)
    plan = maxmin.plan_chunks(docs, c, parents=maxmin.ParentConfig(6))
    parents, children = maxmin.render_families(plan, c)
    rows = lambda d, names: sorted(map(str, d.select(*names).collect()))
    for made, alone in ((children, maxmin.render_chunks(plan, c)), (parents, maxmin.render_chunks(plan.withColumn("runs", F.col("parents")), c, "semantic_max_min_parents"))):
        names = [n for n in alone.columns if n != "parent_chunk_id"]
        assert set(names) <= set(made.columns) and rows(made, names) == rows(alone, names)
    of = {i: p.chunk_id for p in parents.collect() for i in p.child_chunk_ids}
    held = children.collect()
    assert len(held) > 4 and of == {r.chunk_id: r.parent_chunk_id for r in held} and len(set(of.values())) == 4


def test_abbreviations_behind_any_number_of_dots(spark):
    rows = [(k, before, "." * k) for k in range(0, 14) for before in ("", "x", " ", "5")]
    docs = spark.createDataFrame([(i, f"{b}{dots}etc.) Rain{dots} No.") for i, (_, b, dots) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: r.s for r in docs.select("doc_id", sentences.sentences(F.col("text")).alias("s")).collect()}
    for i, (k, before, dots) in enumerate(rows):
        wanted = [f"{before.strip()}{dots}etc.)", f"Rain{dots}", "No."]
        wanted = wanted if before == "x" else [" ".join(wanted[:2]), wanted[2]]
        assert got[i] == (wanted if k else [*wanted[:-2], f"{wanted[-2]} {wanted[-1]}"]), (k, before)


def test_patterns_of_characters(spark):
    """The quicker pattern finds the characters that are not composed for sure, and the list of spaces is that of the class."""
    held = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    d = spark.createDataFrame([(c,) for c in held], "c string")
    found = {r.c for r in d.filter(F.col("c").rlike(identity._OTHER)).collect()}
    assert found == {c for c in held if not re.match(f"[{identity._COMPOSED}]", c)}
    assert {r.c for r in d.filter(F.col("c").rlike(text.SPACE)).collect()} == set(text.SPACES) == {c for c in held if c.isspace()}
