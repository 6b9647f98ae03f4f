import itertools
import random
import re
from html import unescape

import numpy as np
import pytest

from docloom.llm import html_text
from docloom.llm.dom import Block, leaf_blocks, names
from docloom.llm.layouts import invented, labelled_copies
from docloom.sources.tables import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(read_table(spark, SF, "pages"))


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_leaf_blocks():
    assert texts("<p>a <b>b<br>c</b>d<p>e&amp;&lt;&nbsp;f &am g<li>h<li>i</ul>") == ["a b cd", "e&< f &am g", "h", "i"]
    assert texts('x<script>var t="</p><p>";</script>y<!-- <p>z</p> --><style>p{}</style>w') == ["xyw"]
    assert texts("<title>t</title><td>1<td>2<tr><td>3") == ["1", "2", "3"]
    assert texts('<p title="a > b">c</p><p title=\'x\' y>d</p>1 < 2 <3 </ x') == ["c", "d", "1 < 2 <3 </ x"]
    assert texts("<script>never closed <p>x") == [] and texts("a<!-- open <p>x") == ["a"] and texts("a<!-->b") == ["ab"]
    assert texts("") == texts("<p></p> <div>") == [] and texts("plain\u00a0\n text") == ["plain text"]
    assert texts('<a href="x>y') == ["y"] and texts('a<p class="x>y<p>z') == ["a", "y", "z"]
    assert texts("<noscript>a<p>b") == ["a", "b"] and texts("<noscript>a</noscript>b<svg/>c<TEXTAREA>d</TextArea>") == ["bc"]
    linked = leaf_blocks("<p><a href=x>ab</a>cd</p><p>ef<a>gh</p><p>ij")
    assert [b.linked for b in linked] == [0.5, 0.5, 0]
    first, second = leaf_blocks('<div class="postBody siteNav"><ul id=x><li>a</li></ul></div><p hidden>b</p>')
    assert {"c:post", "c:body", "c:nav", "t:ul"} < first.cues and second.near == ("n:c:hidden",)
    assert names('class="cookiebanners"', {"cookie", "banner"}) == ("cookie", "banner")


def test_deep_and_long_pages_take_linear_work():
    assert len(texts("<div class=a><b>x" * 100_000)) == 100_000
    assert len(texts("<p x=\"1<ul><li>" * 50_000 + "y")) > 0
    assert texts("<p>" + "word " * 500_000) == ["word " * 499_999 + "word"]
    assert len(texts("<noscript>a<p>" * 50_000)) == 50_000


def random_field(rng, steps):
    field = html_text.Field({}, rng.normal(size=2), rng.normal(size=(html_text.EDGES, 2, 2)), frozenset())
    return field, rng.normal(size=steps) * 2, [0, *rng.integers(0, html_text.EDGES, steps - 1).tolist()]


def score(field, emissions, kinds, labels):
    return field.first[labels[0]] + sum(e for e, y in zip(emissions, labels) if y) + sum(field.pairs[k][a, b] for k, a, b in zip(kinds[1:], labels, labels[1:]))


def test_viterbi_finds_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for steps in (1, 2, 5, 9):
        for _ in range(20):
            field, emissions, kinds = random_field(rng, steps)
            best = max(itertools.product((0, 1), repeat=steps), key=lambda y: score(field, emissions, kinds, y))
            assert field.decode(emissions, kinds) == list(best)
    assert field.decode([], []) == []


def test_likelihood_is_that_of_all_labellings_and_its_gradient_that_of_differences():
    rng = np.random.default_rng(2)
    index = {f"f{i}": i for i in range(5)}
    pages = []
    for steps in (1, 3, 4, 6):
        pages.append(([[f"f{i}" for i in rng.choice(5, rng.integers(1, 4), replace=False)] for _ in range(steps)], [0, *rng.integers(0, 3, steps - 1).tolist()], rng.integers(0, 2, steps).tolist()))
    batches = html_text._batches(pages, index, size=3)
    theta = rng.normal(size=5 + 2 + 4 * html_text.EDGES)
    value, gradient = html_text.log_likelihood(theta, 5, batches)
    field = html_text.Field({}, theta[5:7], theta[7:].reshape(-1, 2, 2), frozenset())
    want = 0.0
    for found, kinds, labels in pages:
        emissions = [sum(theta[index[f]] for f in row) for row in found]
        want += score(field, emissions, kinds, labels) - np.logaddexp.reduce([score(field, emissions, kinds, y) for y in itertools.product((0, 1), repeat=len(kinds))])
    assert value == pytest.approx(want)
    for i in range(len(theta)):
        step = np.eye(len(theta))[i] * 1e-6
        assert gradient[i] == pytest.approx((html_text.log_likelihood(theta + step, 5, batches)[0] - html_text.log_likelihood(theta - step, 5, batches)[0]) / 2e-6, abs=1e-5)


def truth(html):
    inside = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", html, re.S)[1])
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", inside)).split())


def test_whole_table(spark, model):
    pages = read_table(spark, SF, "pages")
    got = {r.page_id: r for r in html_text.main_text(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert all((got[r.page_id].text, got[r.page_id].url, got[r.page_id].n_chars) == (truth(r.html), r.url, len(truth(r.html))) for r in rows)


def test_held_out_layouts(model):
    rng, right, pages, wrong, blocks = random.Random(77), 0, 0, 0, 0
    for _ in range(120):
        page, labels = invented(rng)
        for made, want in labelled_copies([b.text for b, y in zip(page, labels) if y], [b.text for b, y in zip(page, labels) if not y], rng):
            found = html_text.features(made)
            got = model.decode([sum(model.weights.get(f, 0) for f in row) for row in found], html_text.edges(made))
            faults = sum(a != b for a, b in zip(got, want))
            right, pages, wrong, blocks = right + (not faults), pages + 1, wrong + faults, blocks + len(want)
    assert wrong / blocks < 0.03 and right / pages > 0.8


MAIN = ["A day at the river", "The water was cold and clear in the morning, and nobody else had come yet.", "We stayed until the sun went down behind the hills, then walked home slowly."]
SIDE = "<h3>More stories</h3><ul><li><a href=1>Boats and men</a></li><li><a href=2>How to fish</a></li></ul>"


@pytest.mark.parametrize("begin,end", [
    ("<article>", "</article>"), ("<main><div class='post-content'>", "</div></main>"), ("<div id='main-content'>", "</div>"), ("<div role='main'><section class='story'>", "</section></div>"),
    ("<table><tr><td class='content'>", "</td></tr></table>")])
def test_other_pages(model, begin, end):
    h1, a, b = MAIN
    html = f"""<!DOCTYPE html><HTML><body class="single"><div class="cookie-consent"><p>We use cookies to make this site better for you. <button>Accept</button></p></div>
    <header class="site-header"><a href="/">The Daily Thing</a><form action="/search"><input name=q><button>Search</button></form></header>
    <nav class="main-nav"><ul><li><a href="/a">Home</a><li><a href="/b">World news</a><li><a href="/c">Sports</a></ul></nav>
    {begin}<h1>{h1}</h1><p>{a.replace("and", "<em>and</em>", 1)}</p><div class="advert"><p>Buy our new shoes today, they are the best shoes you can get.</p></div><p>{b}{end}
    <section id="comments" class="comment-list"><h2>2 Comments</h2><div class="comment"><b>Jane</b><p>I was there too last summer, and it was lovely all day long.</p></div>
    <div class="comment"><p>Nice story, thank you for writing it down for us.</p></div></section>
    <aside class="sidebar">{SIDE}</aside><div class="newsletter-signup"><form><p>Get our letter every week, free of charge.</p><input type=email><button>Sign up</button></form></div>
    <footer><p>&copy; 2021 The Daily Thing. All rights reserved.</p></footer></body></html>"""
    assert model.extract(html, {}, {}) == " ".join(MAIN)


def test_edge_cases(spark, model):
    long = "<html><body><nav><a href=x>menu</a></nav><article><h1>Title</h1>" + "<p>Some words that make a sentence here.</p>" * 20_000 + "</article></body></html>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>One whole sentence of the text is here.</p></article>", "x"), (3, "u", long, "x"), (3, "u", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted(html_text.main_text(pages, model).collect(), key=lambda r: (r.n_chars, r.page_id or 0))
    assert [(r.page_id, r.n_chars) for r in got[:3]] == [(1, 0), (2, 0), (None, 39)] and [r.text for r in got[:3]] == ["", "", "One whole sentence of the text is here."]
    assert got[3] == got[4] and got[3].text == "Title" + " Some words that make a sentence here." * 20_000
    assert html_text.main_text(pages.filter("false"), model).count() == 0


def test_a_table_without_marked_pages_has_a_model(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (2, "u", None)], "page_id long, url string, html string")
    model = html_text.fit(pages)
    assert model.weights and isinstance(leaf_blocks("<p>x")[0], Block)
    assert html_text.main_text(pages, model).count() == 2
