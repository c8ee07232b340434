import html
import itertools
import re

import numpy as np
import pytest

from postmill.llm import html_content
from postmill.llm.queries import op7_html_content


@pytest.fixture(scope="module")
def model():
    return html_content.train()


def article(page):
    """The article's blocks, found by its own tags alone."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    plain = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b) if "<br>" in b else re.sub(r"</?b>", "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_query_returns_every_article_whole(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op7_html_content(spark, sf).collect()
    assert {(r.page_id, r.url) for r in rows} == {(p.page_id, p.url) for p in pages.values()} and len(rows) == len(pages)
    same = [r.text == article(pages[r.page_id].html) for r in rows]
    assert np.mean(same) >= 0.99 and all(r.n_chars == len(r.text) for r in rows)


def test_parts_that_are_no_content_stay_out(model):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p><button>Yes</button></div>
    <div id="content"><h1>Head &amp; line</h1><p>First   part<br>goes&nbsp;on <a href="/x">here</a>.<p>Second &eacute; part
    <div class="ad">Buy now.</div><ul><li>point one<li>point two</ul></div>
    <aside><p>Read also this other thing, which is long enough to look like text.</p></aside>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree at all with it.</p></div></section>
    <form><label>Mail</label><input name="m"><p>Subscribe to it.</p></form>
    <footer><p>&copy; Site. All rights reserved.</p></footer></body></html>"""
    assert html_content.texts_of([page], model) == [
        "Head & line\n\nFirst part goes on here.\n\nSecond \u00e9 part\n\npoint one\n\npoint two"
    ]


def test_marginals_of_labelled_pages_kept_back(model):
    trees = [html_content.parsed(p) for p in html_content.labelled_pages(120, seed=77)]
    x, parent, is_text, levels = html_content._matrix(trees)
    share, _ = html_content.marginals(x @ model[0], model[1], parent, is_text, levels)
    truth = np.concatenate([html_content._labels(t) for t in trees])
    assert ((share > 0.5) == truth)[is_text].mean() > 0.94


def test_messages_give_the_marginals_of_all_labellings():
    rng = np.random.default_rng(0)
    parent, is_text = np.array([0, 0, 0, 1, 1, 3]), np.array([0, 0, 1, 0, 1, 1], bool)
    unary, tie = rng.standard_normal(6), rng.standard_normal((2, 2, 2))
    levels = [np.array([1, 2]), np.array([3, 4]), np.array([5])]
    total, each = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        score = sum(unary[k] * y[k] for k in range(6))
        score += sum(tie[int(is_text[k]), y[parent[k]], y[k]] for k in range(1, 6))
        total += np.exp(score)
        each += np.exp(score) * np.array(y)
    share, pairs = html_content.marginals(unary, tie, parent, is_text, levels)
    assert np.allclose(share, each / total)
    assert np.allclose(pairs[1:].sum(axis=1)[:, 1], share[1:])


def test_edge_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "   "), (4, "plain text only"), (5, "<p>a</p></p></div><p>b"), (6, "<" * 3000), (7, "<div>" * 3000 + "deep"),
            (8, "<article><p>" + "word " * 50_000 + "</p></article>"), (8, "<article><p>x</p></article>"), (None, "<script>never ends")]
    df = spark.createDataFrame([(i, h, "t", 0) for i, h in rows], "page_id long, html string, text string, n_chars int")
    got = df.select("page_id", html_content.content(df["html"], model).alias("text")).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    by = [r.text for r in got]
    assert by[0] == by[1] == by[2] == "" and by[7] == " ".join(["word"] * 50_000) and by[8] == "x" and by[9] == ""
    assert df.limit(0).select(html_content.content(df["html"], model)).collect() == []


def test_optional_tags_may_be_left_out(model):
    inner = "<article><h1>Head</h1><p>First part of the text goes on.<p>Second part of the text.</article>"
    text = "Head\n\nFirst part of the text goes on.\n\nSecond part of the text."
    heads = ["<html><head><title>T</title><body>", "<html><head><title>T</title>", "<head><meta charset=utf-8><title>T</title>",
             "<title>T</title>", "<html><head><title>T</title></head>", "<head><template><p>x</p></template><style>p{}</style><body>",
             "<head><noscript><link href=x></noscript><script>a<b</script>\n<body>", "<head><noscript><img src=x></noscript><body>", ""]
    assert html_content.texts_of([h + inner for h in heads], model) == [text] * len(heads)
    assert html_content.texts_of(["<head><title>T</title>Bare text", "<head>\n<title>T</title>"], model) == ["Bare text", ""]
    late = "<html><head></head><body><article><p>One part of the text.</p><head><p>Two parts of the text.</p></article>"
    assert html_content.texts_of([late], model) == ["One part of the text.\n\nTwo parts of the text."]


def test_formulas_drawings_and_fallbacks_of_an_article_are_text(model):
    page = """<html><head><title>T</title></head><body><article><h1>Head</h1>
    <p>Where <math><msup><mi>x</mi><mn>2</mn></msup></math> holds and <object data=f><param name=a>the file</object> or
    <canvas>the chart</canvas> is <noscript>plainly</noscript> seen<script>no()</script>.</p>
    <p>In <svg><title>no</title><desc>no</desc><g><text>the drawing</text></g></svg> it is
    <select><option>no</select></p></article></body></html>"""
    assert html_content.texts_of([page], model) == [
        "Head\n\nWhere x2 holds and the file or the chart is plainly seen.\n\nIn the drawing it is"
    ]
