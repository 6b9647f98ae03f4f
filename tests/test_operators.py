import io
import random
import re
import zipfile

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.functions import identity
from docloom.jobs import answering
from docloom.operators import answers, chunking, context, documents, maxmin, quality, retrieval, sentences


def split(spark, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [[tuple(x) for x in r[0]] for r in d.orderBy("doc_id").select(sentences.spaced_sentences(F.col("text"))).collect()]


def test_sentences(spark):
    got = split(spark, "  Prof. Wu saw 2.5 owls.  They sat!\nWhy there?", '"Go." She went', "Up\n \ndown", "ña. b", "oñ. b", "", None, "see fig. 3 in St. Ives. y")
    assert got == [[("  ", "Prof. Wu saw 2.5 owls."), ("  ", "They sat!"), ("\n", "Why there?")], [("", '"Go."'), (" ", "She went")], [("", "Up"), ("\n \n", "down")],
                   [("", "ña. b")], [("", "oñ."), (" ", "b")], [], [], [("", "see fig. 3 in St. Ives."), (" ", "y")]]


def scanned(text):
    """Sentences by reading the text from character to character."""
    spans, cuts, at = [], [(m.start(), m.end()) for m in re.finditer(r"\n\s*\n", text)], 0
    for stop, after in [*cuts, (len(text), len(text))]:
        begin = i = at
        while i < stop:
            end = i + 1
            while end < stop and text[end] in "\"'’”)]}":
                end += 1
            run = re.search(r"[A-Za-z][A-Za-z.]*\.$", text[:i + 1])
            short = text[i] == "." and run and (run[0].lower() in sentences.ABBREVIATIONS or len(run[0]) == 2)
            if text[i] in ".!?" and not short and (end == stop or text[end].isspace()):
                spans.append((begin, end))
                begin = i = end
            else:
                i += 1
        spans.append((begin, stop))
        at = after
    spans = [(e - len(text[b:e].lstrip()), b + len(text[b:e].rstrip())) for b, e in spans if text[b:e].strip()]
    return [(text[spans[n - 1][1] if n else 0:b], text[b:e]) for n, (b, e) in enumerate(spans)]


def test_marks_in_a_text_are_kept(spark):
    a, b, c = "\ufdd0", "\ufdd1", "\ufdd3"
    assert [[t for _, t in x] for x in split(spark, f"Price {a} five. Next{a} one.", f"{b}{c} x{a}{b}. {b}", f"{a}. {b}{c}{b}")] == [
        [f"Price {a} five.", f"Next{a} one."], [f"{b}{c} x{a}{b}.", b], [f"{a}.", f"{b}{c}{b}"]]


def test_sentences_of_any_text(spark):
    rng = random.Random(3)
    parts = ["Dr.", "e.g.", "a.", "word", "x.Mr.", "..Mr.", "3.14", "end.", "no!", '"Yes."', "U.S.)", "wait...", "é.", "\n", "  ", "\n\n", "\t\n \n", "\u00a0", "z.\n", "(No.)", "!?", "’", ".", "\x1c"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    assert split(spark, *texts) == [scanned(t) for t in texts]


def config(**more):
    return maxmin.ChunkingConfig(**{"min_tokens": 1, "target_tokens": 20, "max_tokens": 40} | more)


def words_of(counts):
    return maxmin.RunCounts([{"text": " ".join(["w"] * n), "separator": " "} for n in counts])


def runs(vectors, counts, **more):
    numbers = maxmin.bounded_clusters(np.array(vectors, float), words_of(counts), config(**more))
    return np.bincount(numbers).tolist()


def test_max_min_rule_is_strict():
    assert runs([[1, 0], [.99, .01], [-1, 0]], [5, 3, 4]) == [2, 1]
    assert runs([[1, 0], [0, 1]], [1, 1], initialization_constant=1.0, hard_threshold=0.0) == [1, 1]


def test_oversized_and_undersized_clusters():
    same = [[1, 0]] * 4
    assert runs(same, [2] * 4, target_tokens=4, max_tokens=4) == [2, 2]
    assert runs([[1, 0], [0, 1], [.1, .995]], [1, 1, 1], min_tokens=2, target_tokens=2, max_tokens=2, hard_threshold=.9, initialization_constant=.5) == [1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 6)), min_size=1, max_size=40))
def test_bounds_hold(units):
    vectors = np.array([[np.cos(a), np.sin(a)] for _, a in units])
    counts = np.array([n for n, _ in units])
    numbers = maxmin.bounded_clusters(vectors, words_of(counts), config())
    assert (np.diff(numbers) >= 0).all() and (np.bincount(numbers, counts) <= 40).all()


def merged_slowly(clusters, size, unit, c):
    """All options are looked at anew before every merge; size(first, stop) counts a run."""
    while True:
        options = [(maxmin.affinity(unit, clusters[j], clusters[j + 1]), j < i, i, j) for i, r in enumerate(clusters) if size(r.start, r.stop) < c.min_tokens
                   for j in (i - 1, i) if 0 <= j < len(clusters) - 1 and size(clusters[j].start, clusters[j + 1].stop) <= c.max_tokens]
        if not options:
            return clusters
        j = max(options)[3]
        clusters = [*clusters[:j], range(clusters[j].start, clusters[j + 1].stop), *clusters[j + 2:]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 15), st.integers(0, 3), st.booleans()), min_size=1, max_size=30))
def test_merging_from_a_heap_is_merging_slowly(units):
    unit = np.array([[np.cos(a), np.sin(a)] for _, a, _ in units])
    counts, c = np.array([n for n, *_ in units]), config(min_tokens=12, target_tokens=20, max_tokens=40)
    cuts = [0, *(i for i in range(1, len(units)) if units[i][2]), len(units)]
    clusters = [range(a, b) for a, b in zip(cuts, cuts[1:])]
    assert maxmin._merge_undersized(clusters, words_of(counts), unit, c) == merged_slowly(clusters, lambda a, b: counts[a:b].sum(), unit, c)


def cut_slowly(cluster, size, unit, c):
    """Every end is counted for every cut."""
    out, start = [], cluster.start
    while size(start, cluster.stop) > c.max_tokens:
        fitting = [(size(start, e), e) for e in range(start + 1, cluster.stop) if size(start, e) <= c.max_tokens]
        far = [((unit[e - 1] * unit[e]).sum(), abs(n - c.target_tokens), e) for n, e in fitting if n >= c.target_tokens]
        end = min(far)[-1] if far else max(fitting)[-1]
        out.append(range(start, end))
        start = end
    return [*out, range(start, cluster.stop)]


def chunked_slowly(units, vectors, count, c):
    def size(first, stop):
        text = "".join((u["separator"] if i else "") + u["text"] for i, u in enumerate(units[first:stop]))
        return count([text])[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    numbers = maxmin.cluster_fold(unit, c)
    starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(units)]
    cut = [r for a, b in zip(starts, starts[1:]) for r in cut_slowly(range(a, b), size, unit, c)]
    return [(r.start, r.stop) for r in merged_slowly(cut, size, unit, c)], size


def byte_pairs(texts, cache=[]):
    if not cache:
        cache.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return [max(1, len(e.ids)) for e in cache[0].encode_batch(texts, add_special_tokens=False)]


def letters(texts):
    return [max(1, len(t)) for t in texts]


def falling(texts):
    """A counter that falls when a run ends with x."""
    return [max(1, len(t) - 9 * t.endswith("x")) for t in texts]


def words_joined(texts):
    return [max(1, len(t.split())) for t in texts]


UNITS = st.lists(st.tuples(st.text("abx ,.\u00e9\u4e2d", min_size=1, max_size=12).map(lambda t: t.strip() or "a"), st.sampled_from(["", " ", "\n\n", "  \n "]), st.integers(0, 4)), min_size=1, max_size=25)


@pytest.mark.parametrize("count", [letters, byte_pairs, falling, words_joined])
@settings(max_examples=80, deadline=None)
@given(UNITS, st.sampled_from([(1, 8, 14), (6, 12, 20), (13, 14, 30)]))
def test_bounds_hold_for_rendered_text(count, made, bounds):
    """No chunk is over the maximum, and chunks are those of the plain rule, which counts every run."""
    c = maxmin.ChunkingConfig(min_tokens=bounds[0], target_tokens=bounds[1], max_tokens=bounds[2])
    units = [{"text": t, "separator": g} for t, g, _ in made]
    vectors = np.array([DIRECTIONS[k] for *_, k in made])
    counts = maxmin.RunCounts(units, count, rising=count is letters or count is words_joined)
    numbers = maxmin.bounded_clusters(vectors, counts, c)
    stops = np.cumsum(np.bincount(numbers)).tolist()
    want, size = chunked_slowly(units, vectors, count, c)
    assert list(zip([0, *stops], stops)) == want
    assert all(size(a, b) <= c.max_tokens for a, b in want)


#: Of length one, with cosines of 1, 1/2, 0 and -1/2 that are exact.
DIRECTIONS = [[1, 0, 0, 0], [0, 1, 0, 0], [.5, .5, .5, .5], [.5, .5, -.5, -.5], [.5, -.5, .5, -.5]]


@settings(max_examples=100, deadline=None)
@given(UNITS, st.integers(9, 30))
def test_counters_that_fall_stay_within_the_maximum_when_said_to_rise(made, most):
    c = maxmin.ChunkingConfig(min_tokens=most // 2, target_tokens=most - 2, max_tokens=most)
    units = [{"text": t[:9], "separator": g} for t, g, _ in made]
    for count in (falling, byte_pairs):
        counts = maxmin.RunCounts(units, count)
        stops = np.cumsum(np.bincount(maxmin.bounded_clusters(np.array([DIRECTIONS[k] for *_, k in made]), counts, c))).tolist()
        assert all(counts.one(a, b) <= most for a, b in zip([0, *stops], stops))


def test_runs_are_counted_few_times():
    rng, asked = np.random.default_rng(4), []
    units = [{"text": "w" * n, "separator": " "} for n in rng.integers(1, 30, 4000).tolist()]
    counts = maxmin.RunCounts(units, lambda ts: asked.extend(map(len, ts)) or letters(ts))
    numbers = maxmin.bounded_clusters(np.tile([[1.0, 0.0]], (4000, 1)), counts, config(min_tokens=80, target_tokens=450, max_tokens=600))
    assert np.bincount(numbers).min() > 10 and sum(asked) < 40 * sum(len(u["text"]) for u in units)
    text = " ".join("v" * n for n in rng.integers(1, 9, 60_000).tolist())
    asked.clear()
    pieces = maxmin.split_by_tokens(text, 100, lambda ts: asked.extend(map(len, ts)) or letters(ts))
    assert "".join(g + p for g, p in pieces) == text and max(len(p) for _, p in pieces) <= 100 and sum(asked) < 40 * len(text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n\u00e9", max_size=60), st.integers(1, 12))
def test_pieces_are_the_longest_that_fit(text, most):
    pieces = maxmin.split_by_tokens(text.strip(), most, letters)
    assert "".join(g + p for g, p in pieces) == text.strip()
    at = 0
    for gap, piece in pieces:
        at += len(gap) + len(piece)
        rest = text.strip()[at - len(piece):]
        fitting = [m.end() for m in re.finditer(r"\S+(?=\s|$)", rest) if m.end() <= most]
        assert len(piece) == (fitting[-1] if fitting else most)


def test_a_long_document_is_merged_in_seconds():
    rng = np.random.default_rng(1)
    numbers = maxmin.bounded_clusters(rng.normal(size=(20_000, 16)), words_of(rng.integers(1, 30, 20_000).tolist()), maxmin.ChunkingConfig())
    assert len(numbers) == 20_000 and (np.bincount(numbers) > 0).all()


@pytest.mark.parametrize("bad", [{"min_tokens": 500, "target_tokens": 400, "max_tokens": 600}, {"overlap_tokens": 1}, {"hard_threshold": 2.0}, {"similarity_coefficient": 0.0}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        maxmin.ChunkingConfig(**bad)


ELEMENTS = "document_id string, document_version string, elements array<struct<element_id:string,element_type:string,text:string,heading_path:array<string>,page_number:int,order:int>>"


def test_chunks_are_traceable(spark):
    rows = [("d", "v", [("e0", "heading", "Top Part", ["Top"], 1, 0), ("e1", "paragraph", "one two three four five six seven", ["Top"], 2, 1)]), ("blank", "v", [("e", "paragraph", "  ", [], None, 0)])]
    made = maxmin.chunk_documents(sentences.units(spark.createDataFrame(rows, ELEMENTS)), config(target_tokens=2, max_tokens=3)).orderBy("chunk_index").collect()
    assert {r.document_id for r in made} == {"d"} and all(r.token_count <= 3 for r in made)
    assert any(r.forced_token_split for r in made) and (made[0].page_start, made[-1].page_end) == (1, 2)
    assert [r.previous_chunk_id for r in made] == [None, *[r.chunk_id for r in made[:-1]]] and made[-1].next_chunk_id is None
    assert made[0].heading_path == ["Top"] and [r.chunk_index for r in made] == list(range(len(made)))


def one_paragraph(spark, *texts):
    return sentences.units(spark.createDataFrame([(f"d{i}", "v", [("e", "paragraph", t, [], None, 0)]) for i, t in enumerate(texts)], ELEMENTS))


def test_parents_and_children(spark):
    texts = [("e0", "heading", "Part one", ["One"], None, 0), ("e1", "paragraph", "aa bb. cc dd ee. ff gg. hh.", ["One", "x"], None, 1), ("e2", "heading", "Part two", ["Two"], None, 2), ("e3", "paragraph", "ii jj. kk.", ["Two"], None, 3)]
    docs = spark.createDataFrame([("d", "v", texts), ("e", "v", texts[:1]), ("blank", "v", [])], ELEMENTS)
    c = config(target_tokens=2, max_tokens=4)
    with pytest.raises(ValueError):
        maxmin.ParentConfig(0)
    plan = maxmin.plan_chunks(sentences.units(docs), c, parents=maxmin.ParentConfig(6))
    parents, children = (sorted(x.collect(), key=lambda r: (r.document_id, r.chunk_index)) for x in maxmin.render_families(plan, c))
    of = {r.chunk_id: r for r in parents}
    assert len(of) == len(parents) and {r.parent_chunk_id for r in children} == set(of) and all(r.token_count <= 6 and r.parent_chunk_id is None for r in parents)
    for r in parents:
        own = [x for x in children if x.parent_chunk_id == r.chunk_id]
        assert [x.chunk_id for x in own] == list(r.child_chunk_ids) and own[0].unit_start == r.unit_start and own[-1].unit_end == r.unit_end
        assert len({tuple(x.heading_path[:1]) for x in own}) == 1 and all(x.content in r.content for x in own)
    assert len([r for r in parents if r.document_id == "d"]) >= 3 and not {r.chunk_id for r in children} & set(of)
    single = maxmin.plan_chunks(sentences.units(docs), c, count=lambda ts: list(map(len, ts)), parents=maxmin.ParentConfig(12))
    assert all(p["tokens"] <= 12 or p["children"] == 1 for r in single.collect() for p in r.parents)


def test_chunks_keep_what_lies_between_sentences(spark):
    text = "Rain  fell.\nIt  stayed wet.\n\n \nThen sun. And\twind and more of it again."
    whole = maxmin.chunk_documents(one_paragraph(spark, text), config(), embed=lambda ts: [[1.0]] * len(ts)).collect()
    assert [r.content for r in whole] == [text] and whole[0].token_count == 14
    parts = maxmin.chunk_documents(one_paragraph(spark, text), config(target_tokens=2, max_tokens=3)).orderBy("chunk_index").collect()
    at = 0
    for r in parts:
        at = text.index(r.content, at) + len(r.content)
    assert "".join("".join(r.content.split()) for r in parts) == "".join(text.split()) and any("\t" in r.content for r in parts)


def test_token_counters_and_embeddings_are_the_callers(spark):
    letters = lambda ts: [max(1, len(t)) for t in ts]
    made = maxmin.chunk_documents(one_paragraph(spark, "abcdefghij kl mn. op"), config(target_tokens=5, max_tokens=6), count=letters).orderBy("chunk_index").collect()
    assert all(len(r.content) == r.token_count <= 6 for r in made) and "".join(r.content for r in made).replace(" ", "") == "abcdefghijklmn.op"
    calls = []

    def embed(ts):
        return [[float("nan") if "bad" in t else 1.0] for t in ts]

    plan = maxmin.plan_chunks(one_paragraph(spark, "good one.", "bad one.", ""), config(), embed=embed)
    assert {r.document_id: (r.fault, len(r.runs)) for r in plan.collect()} == {"d0": (None, 1), "d1": ("invalid_vector", 0), "d2": (None, 0)}
    assert maxmin.embedded(list("abcde"), lambda ts: calls.append(len(ts)) or [[1.0]] * len(ts), 2).shape == (5, 1) and calls == [2, 2, 1]
    for wrong, why in ((lambda ts: [[1.0]], "unexpected_vector_count"), (lambda ts: [[0.0]] * len(ts), "zero_length_vector"), (lambda ts: [[1.0] * (1 + len(t)) for t in ts], "inconsistent_dimensions")):
        with pytest.raises(maxmin.ProviderFault, match=why):
            maxmin.embedded(["a", "bc"], wrong, 32)
    with pytest.raises(maxmin.ProviderFault):
        maxmin.counted(["a"], lambda ts: [True])
    with pytest.raises(maxmin.ProviderFault, match="character_over_maximum"):
        maxmin.split_by_tokens("abc", 1, lambda ts: [2] * len(ts))


def test_sections_are_packed(spark):
    rows = [("d", [("e0", "heading", "Top", ["Top"], None, 0), ("e1", "paragraph", "aa bb.\ncc dd ee.  ff", ["Top"], None, 1), ("e2", "paragraph", "g h", ["Top"], None, 2), ("e3", "paragraph", "i", ["Top", "x"], None, 3)])]
    docs = spark.createDataFrame(rows, "document_id string, elements " + ELEMENTS.split("elements ")[1])
    got = [(r.content, r.heading_path, r.first_order, r.last_order, r.token_count) for r in chunking.structure_chunks(docs, 4).orderBy("chunk_index").collect()]
    assert got == [("Top\n\naa bb.", ["Top"], 0, 1, 3), ("cc dd ee.  ff", ["Top"], 1, 1, 4), ("g h", ["Top"], 2, 2, 2), ("i", ["Top", "x"], 3, 3, 1)]
    assert [r.token_count for r in chunking.structure_chunks(docs, 100).orderBy("chunk_index").collect()] == [9, 1]


def test_heading_stack_nests_by_position(spark):
    items = [("heading", 1, "a"), ("heading", 3, "b"), ("heading", 3, "c"), ("heading", 2, "d")]
    d = spark.createDataFrame([(items,)], "items array<struct<type:string,level:int,text:string>>")
    assert d.select(documents.heading_paths(F.col("items"))).first()[0] == [["a"], ["a", "b"], ["a", "b", "c"], ["a", "d"]]


def test_layout_items(spark):
    schema = "source_identifier string, item_order int, label string, text string, level int, tree_level int, pages array<int>, enumerated boolean, marker string, language string, rows int, columns int"
    rows = [("r.pdf", 0, "title", "Report", None, 0, [1], None, None, None, None, None), ("r.pdf", 1, "picture", "x", None, 0, [1], None, None, None, None, None),
            ("r.pdf", 2, "list_item", "first", None, 2, [2, 1], True, "3.", None, None, None), ("r.pdf", 3, "text", " -- ", None, 0, [1], None, None, None, None, None),
            ("r.pdf", 4, "page_footer", "p 1", None, 0, [], None, None, None, None, None)]
    got = documents.map_items(spark.createDataFrame(rows, schema)).orderBy("order").collect()
    assert [r.element_type for r in got] == ["title", "list_item", "other"]
    whole = "\n\n".join(r.text for r in got)
    assert all(whole[r.char_start:r.char_end] == r.text for r in got)
    profiles = spark.createDataFrame([("r.pdf", False, None, True), ("none.pdf", False, "success", True), ("locked.pdf", True, None, False)], "source_identifier string, encrypted boolean, status string, has_images boolean")
    docs = {r.source_identifier: r for r in documents.assemble(documents.map_items(spark.createDataFrame(rows, schema)), profiles).collect()}
    assert (docs["r.pdf"].text, docs["r.pdf"].title, docs["r.pdf"].reason, len(docs["r.pdf"].elements)) == (whole, "Report", None, 3)
    assert (docs["none.pdf"].reason, docs["locked.pdf"].reason) == ("scanned_pdf", "encrypted_pdf")
    assert got[1].list.ordinal == 3 and got[1].page_numbers == [1, 2] and got[2].source_role == "page_footer"


def test_text_files(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.txt").write_bytes(b"Warm rain.\t \r\n\r\n\r\n\r\nCold \xfe wind.\n")
    (tmp_path / "b.txt").write_text("\t\n \n")
    got = {r.source_identifier: r for r in documents.parse_text(documents.read_files(spark, str(tmp_path), "text/plain"), "txt").collect()}
    assert got["x/same.txt"].text == "Warm rain.\n\nCold � wind." and got["x/same.txt"].reason is None and len(got["x/same.txt"].elements) == 1
    assert got["x/same.txt"].document_id != got["y/same.txt"].document_id and got["x/same.txt"].source_name == "same.txt"
    assert got["b.txt"].reason == "empty_document"
    wrong = documents.parse_text(documents.read_files(spark, str(tmp_path), "application/pdf"), "txt")
    assert {r.reason for r in wrong.collect()} == {"unsupported_format"}


@pytest.mark.parametrize("root, path, want", [("s3a://bucket/in/", "s3a://bucket/in/a/b.txt", "a/b.txt"), ("/data/in", "file:/data/in/c.txt", "c.txt"), ("hdfs://n:8020/", "hdfs://n:8020/d.txt", "d.txt")])
def test_paths_below_a_root(spark, root, path, want):
    assert spark.range(1).select(documents.relative_path(F.lit(path), root)).first()[0] == want


def test_markdown_files(spark, tmp_path):
    (tmp_path / "m.md").write_text("# Harbour Notes\n\nTwo **old** boats:\n\n- Heron\n- Tern\n")
    (tmp_path / "n.md").write_text("<!-- nothing to see -->")
    got = {r.source_name: r for r in documents.parse_text(documents.read_files(spark, str(tmp_path), "text/markdown"), "markdown").collect()}
    assert got["m.md"].title == "Harbour Notes" and "**" not in got["m.md"].text and "Heron" in got["m.md"].text
    assert got["n.md"].reason == "empty_document"


@pytest.mark.parametrize("source, want", [
    ("a `x < y` b", "a x &lt; y b"), ("```\ncode & more\n```", "code &amp; more"), ("R&D &copy; 3 < 4", "R&amp;D &copy; 3 &lt; 4"), ("\\*no\\* *yes*", "*no* yes"),
    ("see <https://a.b/c> now<br>here", "see https://a.b/c nowhere"), ("Head\n====\n\nbody __bold\nline__", "Head\nbody bold\nline"), ("> quoted\n> [t](u) ![i](v)", "quoted\nt "),
    ("see [the site][s] and [s] or [S][] or [x]\n\n[s]: https://a.b/c 'Title'\n[unused]:\n  <https://d>\nend", "see the site and s or S or [x]\nend"),
    ("![an image][pic]\n\n[pic]: p.png", ""), ("[a]: b\n\n- item [a]", "item a"), ("no [def] here [1][2]", "no [def] here [1][2]"),
    ("1. one\n2. two\n\n***\n\n    kept <raw>", "one\ntwo\n\nkept &lt;raw&gt;"), ("a | b\n--|--\n1 | 2", "a | b\n--|--\n1 | 2")])
def test_markdown_text(spark, source, want):
    from docloom.functions.text import flatten_html
    from docloom.operators.markdown import to_html
    assert spark.range(1).select(flatten_html(F.lit(to_html(source)))).first()[0] == want.strip()


def word_file(*blocks):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{''.join(blocks)}</w:body></w:document>")
    return held.getvalue()


def test_word_files(spark, tmp_path):
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    (tmp_path / "a.docx").write_bytes(word_file(p("  Cafe\u0301 ", "hours "), p(" "), "<w:tbl><w:tr><w:tc>" + p("cell") + "</w:tc></w:tr></w:tbl>", "<w:sdt><w:sdtContent>" + p("late") + "</w:sdtContent></w:sdt>"))
    (tmp_path / "b.docx").write_bytes(word_file(p("")))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    got = {r.source_name: r for r in documents.parse(documents.read_files(spark, str(tmp_path), documents.DOCX), "docx").collect()}
    a = got["a.docx"]
    assert (a.text, [e.text for e in a.elements], [e.order for e in a.elements], a.reason) == ("Cafe\u0301 hours\n\nlate", ["Cafe\u0301 hours", "late"], [0, 1], None)
    want = spark.range(1).select(identity.element_id(F.lit(a.document_id), F.lit("1.0.0"), F.lit(0), F.lit("Caf\u00e9 hours"))).first()[0]
    assert a.elements[0].element_id == want and (got["b.docx"].reason, got["c.docx"].reason) == ("empty_document", "conversion_failed")
    assert {r.reason for r in documents.parse_docx(documents.read_files(spark, str(tmp_path), "text/plain")).collect()} == {"unsupported_format"}


def test_windows(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.fixed_windows(d, 4, 1).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.content) for r in got] == [(1, "0 1 2 3"), (1, "3 4 5 6"), (1, "6 7 8 9")]


def test_context_budget(spark):
    d = spark.createDataFrame([(1, 1, 50, "a"), (1, 2, 70, "b"), (1, 3, 40, "c")], "q int, rank int, n int, id string")
    r = context.assemble_context(d, "q", "rank", "n", "id", max_tokens=100, max_chunks=2).first()
    assert (r.included, r.excluded, r.token_count) == (["a", "c"], ["b"], 90)


def fitting(sizes, max_tokens, max_chunks):
    out, used = [], 0
    for i, n in enumerate(sizes):
        if len(out) < max_chunks and used + n <= max_tokens:
            out.append(i)
            used += n
    return out, used


def test_contexts_are_those_of_a_plain_fold(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in [None, *range(60)]:
        sizes = [rng.choice([None, -2, 0, 1, 5, 30, rng.randint(1, 200)]) for _ in range(rng.choice([1, 3, 200]))]
        rows += [(g, None if i + 1 == len(sizes) and i else i // 2, n, f"{i:04}") for i, n in enumerate(sizes)]
        got, used = fitting([max(n or 0, 0) for n in sizes], 150, 7)
        want[g] = ([f"{i:04}" for i in got], [f"{i:04}" for i in range(len(sizes)) if i not in got], used)
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "included int, used int, size int, tokens string").repartition(6)
    made = context.assemble_context(d, "included", "used", "size", "tokens", 150, 7)
    assert made.columns == ["included", "included", "excluded", "token_count"]
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == want
    assert context.context_decisions(d.filter("false"), "included", "used", "size", "tokens").count() == 0
    with pytest.raises(ValueError):
        context.context_decisions(d, "included", "used", "size", "tokens", max_chunks=0)


def test_a_candidate_behind_many_that_are_too_large_is_found(spark):
    rows = [(1, i, 700 if i < 120 else 10, i) for i in range(150)]
    r = context.assemble_context(spark.createDataFrame(rows, "q int, r int, n int, i int"), "q", "r", "n", "i", 600, 6).first()
    assert (r.included, len(r.excluded), r.token_count) == (list(range(120, 126)), 144, 60)


def test_a_group_of_a_million_candidates(spark):
    rows = spark.range(1_000_000).select(F.lit("one").alias("q"), (F.col("id") * 7919 % 1_000_003).alias("r"), (F.abs(F.hash("id")) % 5000 + 300).alias("n"), "id")
    made = context.context_decisions(rows, "q", "r", "n", "id", 6000, 12)
    found = made.agg(F.count(F.lit(1)).alias("all"), F.count_if("included").alias("taken"), F.max("used").alias("used"), F.count_distinct("item").alias("items")).first()
    local = sorted((r.r, r.n) for r in rows.select("r", "n").collect())
    got, used = fitting([n for _, n in local], 6000, 12)
    assert tuple(found) == (1_000_000, len(got), used, 1_000_000)


def test_search_leaves_out_bad_vectors_and_itself(spark):
    nan = float("nan")
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = retrieval.search(d, d.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (5, 0.0)]


def test_rows_of_one_id_are_dealt_and_answered_each(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 100)
    monkeypatch.setattr(retrieval, "QUERIES", 1)
    rows = spark.range(1000).select(F.lit(7).alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 1000.0).alias("embedding"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), F.col("id") % 4)).alias("doc"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 0.0])], "vec_id int, embedding array<double>")
    found = retrieval.search(rows, asked, retrieval.RetrievalConfig(top_k=4, max_per_document=1), "doc").collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == sorted((1, k, 7) for k in (1, 2, 3) for _ in range(2))


def test_upsert_and_rejections(spark):
    old = spark.createDataFrame([(1, "a", 9), (2, "b", 1)], "id int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2)], "id int, v string, t int")
    assert sorted(map(tuple, retrieval.upsert(old, new, "id", [F.desc("t")]).collect())) == [(1, "d", 2), (2, "b", 1)]
    with pytest.raises(ValueError):
        retrieval.RetrievalConfig(top_k=0)
    with pytest.raises(ValueError):
        retrieval.metadata_filter(old, date_from=2, date_to=1)


def test_violations_and_answers(spark):
    d = spark.createDataFrame([("rejected", None, None, 1), ("completed", "d", None, 0)], "status string, document_id string, document_version string, chunk_count int")
    assert [r[0] for r in d.select(quality.outcome_violations()).collect()] == [["rejected_chunks"], ["missing_document"]]

    def slow(prompts):
        if prompts == ["slow"]:
            raise TimeoutError
        return answers.echo(prompts)

    got = {r["query"]: (r.answer, r.code, r.status) for r in answers.answer(spark.createDataFrame([("hi",), ("slow",), ("",)], "query string"), slow).collect()}
    assert got == {"hi": ("echo: hi", None, 200), "slow": (None, "provider_timeout", 504), "": (None, None, 422)}


def test_capped_search(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 4))
    d = spark.createDataFrame([(i, x.tolist(), i % 3 if i < 60 else 7) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in retrieval.search(d, d.filter("vec_id < 5"), retrieval.RetrievalConfig(top_k=6, max_per_document=2), "label").orderBy("query_id", "rank").collect()]
    want = []
    for q in range(5):
        scores = sorted((-round(float(v[q] @ x / np.linalg.norm(v[q]) / np.linalg.norm(x)), 6), i) for i, x in enumerate(v) if i != q)
        held, rank = {}, 0
        for s, i in scores:
            owner = i % 3 if i < 60 else 7
            held[owner] = held.get(owner, 0) + 1
            if held[owner] <= 2 and rank < 6:
                rank += 1
                want.append((q, rank, i, -s))
    assert got == want


def test_queries_are_answered_from_chunks(spark):
    docs = one_paragraph(spark, "Herons nest by the river.", "Bakers rise early for bread.", "Old clocks tick slowly at night.")
    chunks = maxmin.chunk_documents(docs, config(), embed=maxmin.hashed_embeddings)
    asked = spark.createDataFrame([("q1", "bread bakers early"), ("q2", "")], "query_id string, query string")
    found = {r.query_id: r for r in answering.contexts(asked, chunks, max_tokens=12, max_chunks=2).collect()}
    assert found["q1"].context.startswith("Bakers rise early for bread.") and found["q1"].token_count <= 12 and len(found["q1"].sources) == 2 and len(found["q1"].excluded) == 1
    assert (found["q2"].context, found["q2"].sources) == ("", [])
    got = {r["query"]: r for r in answering.answer_queries(asked, chunks, max_tokens=5).collect()}
    assert got["bread bakers early"].answer == "echo: Bakers rise early for bread.\n\nbread bakers early" and len(got["bread bakers early"].sources) == 1
    assert (got[""].status, got[""].sources) == (422, [])


def test_conversion_states(spark):
    d = spark.createDataFrame([(1, None), (2, "SUCCESS"), (3, "partial_success"), (4, "Failure")], "i int, s string").orderBy("i")
    both = d.select(*[documents.conversion_reason(F.col("s"), p).isNotNull() for p in ("pdf", "docx")]).collect()
    assert [tuple(r) for r in both] == [(False, False), (False, False), (True, False), (True, True)]


def test_orders_rise(spark):
    d = spark.createDataFrame([(1, [(0,), (2,)]), (2, [(0,), (0,)]), (3, [])], "i int, elements array<struct<order:int>>")
    assert [r[0] for r in d.orderBy("i").select(quality.order_violations(F.col("elements"))).collect()] == [[], ["order_not_rising"], ["no_elements"]]
