import html
import itertools
import math
import random
import re

import pytest

from clausemill.llm import html_crf
from clausemill.llm.html_blocks import blocks_of
from clausemill.llm.html_crf import features
from clausemill.llm.html_pages import labelled_page
from clausemill.llm.query_html import op6_html_text


@pytest.fixture(scope="module")
def model():
    return html_crf.default_model()


def test_held_out_accuracy(model):
    r, wrong, blocks_seen, whole = random.Random(99), 0, 0, 0
    for _ in range(200):
        page, texts = labelled_page(r)
        blocks = blocks_of(page)
        got = html_crf.viterbi([html_crf.features(b) for b in blocks], *model)
        bad = sum(y != (b.text in texts) for y, b in zip(got, blocks, strict=True))
        wrong, blocks_seen, whole = wrong + bad, blocks_seen + len(blocks), whole + (bad == 0)
    assert wrong <= 0.01 * blocks_seen and whole >= 0.95 * 200


def test_viterbi_against_all_paths():
    r = random.Random(2)
    for _ in range(30):
        emit = {f: (r.gauss(0, 1), r.gauss(0, 1)) for f in "abcdef"}
        move = [[r.gauss(0, 1), r.gauss(0, 1)], [r.gauss(0, 1), r.gauss(0, 1)]]
        rows = [r.sample("abcdef", 2) for _ in range(r.randint(1, 7))]
        score = lambda ys: sum(emit[f][y] for fs, y in zip(rows, ys, strict=True) for f in fs) + sum(move[a][b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert math.isclose(score(html_crf.viterbi(rows, emit, move)), score(best))


def test_blocks_of_broken_html():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts("<p>a<p>b<b>c<br>d</p>e") == ["a", "b c d".replace(" c", "c"), "e"]
    assert texts("a < b &amp; c&nbsp;d &lt;p&gt;") == ["a < b & c d <p>"]
    assert texts("<ul><li>x<li>y</ul>z<script>var t='</p>'; if (a<b) {}</script>w") == ["x", "y", "zw"]
    assert texts("<style>p{}</style><!-- <p>no</p> --><div title='a>b'>c</div><div title=\"open>d") == ["c", "d"]
    assert texts("<script>never closed <p>x</p>") == [] and texts("") == [] and texts("<p></p> \n<div>\t</div>") == []
    assert texts("<h1>a</h2>b<h3>c") == ["a", "b", "c"]
    assert blocks_of("<div class=ad><p>x</p></div>")[0].path == [("div", "ad"), ("p", "")]


def test_heads_without_an_end_tag(model):
    article = "<article><h1>Some title here</h1><p>Some text that is here, and a bit more of it.</p></article>"
    want = "Some title here\nSome text that is here, and a bit more of it."
    for start in ("<html><head><title>x</title><body>", "<html><head><title>x</title>", "<head><meta charset=utf-8><script>a<b</script>\n<link rel=x>", "<title>x</title>", "<head></head><body>", "<HEAD><style>p{}</style></HEAD>"):
        assert html_crf.main_text(start + article, model) == want, start
    assert [b.text for b in blocks_of("<head><title>x</title>loose text<p>more")] == ["loose text", "more"]
    assert [b.text for b in blocks_of("<head> \n <title>x</title> </head>y")] == ["y"]


def test_long_and_deep_pages_are_read_whole(model):
    long = "<article>" + "<p>Word word word word.</p>" * 3000 + "</article>"
    assert html_crf.main_text(long, model).count("\n") == 2999
    assert html_crf.main_text("<div>" * 3000 + "<article><p>Some text that is here.</p></article>", model) == "Some text that is here."
    assert len(blocks_of("<" * 20_000 + "a" * 10)) == 1
    blocks_of("<a b='" * 2_000)


def test_rows_nulls_ties_and_other_columns(spark, model):
    page = "<nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Title here</h1><p>Body  text &amp; more.</p></article><footer>&copy; x</footer>"
    rows = [(1, page, "a", "u"), (1, page, "a", "u"), (2, None, "a", "u"), (None, "", "a", "u"), (3, "<nav><a href=x>only menu</a></nav>", "a", "u")]
    out = html_crf.extract(spark.createDataFrame(rows, "page_id long, html string, text string, url string"), model=model)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(((r.page_id or 0), r.text) for r in out.collect()) == [(0, ""), (1, "Title here\nBody text & more."), (1, "Title here\nBody text & more."), (2, ""), (3, "")]
    assert out.limit(0).collect() == []


def test_query_on_the_pages(spark, sf_dir):
    got = {r.page_id: r for r in op6_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", article))
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_time_and_memory_grow_with_the_page():
    import time

    def took(page):
        began = time.perf_counter()
        blocks = blocks_of(page)
        for b in blocks:
            features(b)
        return time.perf_counter() - began, blocks

    makers = [
        lambda n: "<span>" * n + "</b>" * n + "x",
        lambda n: "<div>x" * n,
        lambda n: "<p>" + "<span>" * n + "<hr>x" * n,
        lambda n: "<div class=menu>x<i>" * n + "</u></div>" * n,
        lambda n: "<ul>" + "<li>x<b>" * n,
    ]
    for make in makers:
        (small, _), (large, blocks) = took(make(2_000)), took(make(16_000))
        assert large < 32 * max(small, 0.01), (large, small)
    deep = took("<div>x" * 4_000)[1]
    assert len({id(b.above) for b in deep}) == 4_000 and deep[-1].path[:2] == [("div", ""), ("div", "")] and len(deep[-1].path) == 4_000
