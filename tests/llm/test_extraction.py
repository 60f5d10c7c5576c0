"""Leaf blocks on hand-made pages, the random field on held-out pages and against all labellings, odd rows."""

import itertools
import math
import time

import numpy as np
import pytest

from heddlework.llm import extraction
from heddlework.llm.common import prepare
from heddlework.llm.leaf_blocks import Block, leaf_blocks

FOLDER = "/root/testdata/sf0.01"
PAGES = "page_id bigint, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def htmls(spark):
    return [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(htmls):
    return extraction.fit(extraction.training_pages(htmls[:120]))


def texts(html):
    return [b.text for b in leaf_blocks(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []), (None, []), ("a < b &amp; c &lt;d&gt; &eacute;&#233;&#x1F600; &amp", ["a < b & c <d> éé\U0001f600 &"]),
        ("<p><b>One.<br><p>Two <i>x</i>y</p>three", ["One.", "Two xy", "three"]),
        ("<div>a<p>b</p>c<ul><li>d<li>e</ul>f</div>", ["a", "b", "c", "d", "e", "f"]),
        ("<p>a\n\t  b&nbsp; c </p><!-- <p>no</p> --><script>var t='</p><p>no'</script><style>p{}</style>d", ["a b c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>", ["a", "b", "c", "d", "e"]),
        ('<p title="a>b" class=x>c</p><p data-x=\'>\'>d', ["c", "d"]), ("</p></div>a<//>b</ x>c<1>", ["abc<1>"]),
        ("<!DOCTYPE html><title>no</title><textarea>no</textarea>a<br/>b<img src=x>c", ["a bc"]), ("x<!-- open", ["x"]), ("x<script>open", ["x"]),
    ],
)
def test_leaf_blocks(html, want):
    assert texts(html) == want


def test_names_links_and_containers():
    a, b, c = leaf_blocks('<div id="mainMenu" class="nav-bar"><a href=x>go</a></div><section><p>t <a>l</a></p><p>u</p></section>')
    assert {"main", "menu", "nav", "bar", "<div"} <= set(a.around) and (a.linked, b.linked) == (2, 1)
    assert b.container == c.container != a.container and "menu" not in b.around


@pytest.mark.parametrize(
    "html",
    ["<" * 10**6, "<!--" * 300_000, '<p a="' * 200_000, "<div>" * 300_000 + "x", "<i><p>" + "<b>" * 200_000 + "</i>" * 200_000,
     "<ul><div>" * 100_000 + "<li>x</li>" * 100_000, "<script>" * 200_000, "<p" + " " * 10**6, "&" * 10**6, "x" * 5_000_000],
)
def test_no_page_takes_long(html, model):
    start = time.time()
    model.main_blocks(html)
    assert time.time() - start < 20


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_and_gradient_against_all_labellings(seed):
    r = np.random.default_rng(seed)
    page = [Block("word " * int(r.integers(1, 9)), str(r.choice(["p", "li", "div"])), (), 0, int(r.integers(0, 2)), -1, bool(r.integers(0, 2))) for _ in range(7)]
    found = extraction.features(page)
    weights = {f: float(r.normal()) for f in {f for fs in found for f in fs}}
    model = extraction.Model(weights, r.normal(size=(3, 2, 2)))

    def score(labels):
        pairs = sum(model.pairs[extraction.relation(b, a)][x][y] for a, b, x, y in zip(page, page[1:], labels, labels[1:], strict=False))
        return pairs + sum(weights[f] for fs, y in zip(found, labels, strict=True) if y for f in fs)

    assert math.isclose(score(model.decode(page)), max(map(score, itertools.product((0, 1), repeat=len(page)))))


def test_held_out_pages_are_whole(htmls, model):
    for html in htmls[120:]:
        assert [b.text for b in model.main_blocks(html)] == [b.text for b in extraction.labelled(html) if b.wanted]


def test_held_out_layouts(htmls, model):
    right = wrong = 0
    for k, html in enumerate(htmls[120:]):
        main = [b.text for b in extraction.labelled(html) if b.wanted]
        laid = extraction._Layout(10**7 + k, main[0], main[1:30] or main, ["Some link"], main).html()
        for b, label in zip(leaf_blocks(laid, mark=extraction.MARK), model.decode(leaf_blocks(laid, model.names)), strict=True):
            right, wrong = right + (b.wanted == bool(label)), wrong + (b.wanted != bool(label))
    assert wrong < 0.02 * right


PLAIN = """<html><head><title>no</title></head><body><div id="top"><a href=/>Site</a> <a href=/x>News</a></div>
<div class="cookie-banner"><p>We use cookies. <a>Accept</a></p></div><div class="left-sidebar"><h3>Popular</h3><ul><li><a>Some story here</a></li></ul></div>
<div><h1>My Title</h1><p>First paragraph of the text, which is quite long and has a few commas, really.</p><p>Second.</p>
<ul><li>item one of list</li><li>item two</li></ul><p>Third   paragraph with some &amp; words in it.</p></div>
<div id="comments"><h2>2 comments</h2><div class=comment><p>Great article, I really liked it very much, thanks!</p></div></div>
<div class=footer>&copy; me</div></body></html>"""
WANTED = "My Title\nFirst paragraph of the text, which is quite long and has a few commas, really.\nSecond.\nitem one of list\nitem two\nThird paragraph with some & words in it."


def test_odd_rows(spark, model):
    prepare(spark)
    long = "<article>" + "<p>A sentence of the long page, with a comma.</p>" * 30_000 + "</article>"
    rows = [(1, "u", PLAIN), (1, "u", PLAIN), (None, None, None), (2, "", ""), (3, "x", "no tags at all"), (4, "l", long), (5, "n", "<nav><a>x</a></nav>")]
    got = extraction.extract_text(spark.createDataFrame([(*r, "t", "n") for r in rows], PAGES), model).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.url or "") for r in got) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 1] == [WANTED] * 2
    assert [r.text for r in got if r.page_id in (None, 2, 5)] == [""] * 3
    assert [r.text.count("\n") for r in got if r.page_id == 4] == [29_999]


def test_empty_table_is_trained_on_fillers(spark):
    prepare(spark)
    none = spark.createDataFrame([], PAGES)
    trained = extraction.train(none)
    assert extraction.extract_text(none, trained).collect() == []
    named = PLAIN.replace("<div><h1>", "<article><h1>").replace('words in it.</p></div>', 'words in it.</p></article>')
    assert [b.text for b in trained.main_blocks(named)] == WANTED.split("\n")
