from itertools import product

import numpy as np
import pytest

from rowsmith.llm import main_text
from rowsmith.llm.dom import attribute_tokens, read
from rowsmith.llm.layouts import Layout

SCHEMA = "page_id bigint, url string, html string, text string, row string"


@pytest.fixture(scope="module")
def model():
    return main_text.learn(None, layouts=400)


def blocks(html):
    page = read(html)
    return [t for t in page.text if t]


@pytest.mark.parametrize("html, expected", [
    ("", []),
    ("plain", ["plain"]),
    ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p><b>a<br><p>b &amp; c&nbsp;\n d</p>", ["a", "b & c d"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]),
    ("<script>if (a<b) x('</p>')</script>a<style>b</style><!-- c -->", ["a"]),
    ("a<noscript><p>b</noscript>c", ["a", "b", "c"]),
    ("E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math> holds", ["E = mc2 holds"]),
    ("a<object data='x'><p>b</p></object>c", ["a", "b", "c"]),
    ("a<svg><p>b<svg><g></g></svg>c<video>d", ["a", "bcd"]),
    ("a<svg title='>'>b</svg>c<svg><svg/>d</svg>e", ["ace"]),
    ("a<svg><svg><text>x</text></svg><text>y</text></svg>b<svg/>c", ["abc"]),
    ("a<select><option>x</option></select>b<iframe>c<title>d<textarea>e<title>f", ["abcdef"]),
    ("<style>x</style>a<style>never closed", ["a"]),
    ("a<script>never closed", ["a"]),
    ("a < b <3 c", ["a < b <3 c"]),
    ("x<em>y</em>z <a href='>'>w</a>", ["xyz w"]),
    ("<div class='a\">b</div>c", ["b", "c"]),
    ("a<div", ["a"]),
    ("<h2>a</h3>b", ["a", "b"]),
    ("</p></div>a&lt;b&#233;", ["a<bé"]),
    ("<title>t</title><textarea>x</textarea><DIV>A</DIV>", ["A"]),
])
def test_blocks_of_pages(html, expected):
    assert blocks(html) == expected


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert blocks(deep) == ["x"]
    assert blocks("<svg>" * 20_000 + "x" + "<title>" * 20_000 + "y") == ["xy"]
    assert len(blocks("<p>" + "a " * 100_000 + "<p>b" * 2000)) == 2001


def test_attribute_tokens():
    assert attribute_tokens(' class="storyBody main-col2" id=top data-x="y" hidden') == ("story", "body", "main", "col", "top", "hidden")
    assert attribute_tokens(' style="display: none"') == ("hidden",) and attribute_tokens("") == ()


def test_labellings_are_the_likeliest_without_contradictions():
    r = np.random.default_rng(0)
    for _ in range(60):
        n = r.integers(1, 9)
        parent = np.array([-1] + [r.integers(0, i) for i in range(1, n)])
        inner = set(parent.tolist())
        text = ["" if i in inner else r.choice(["", "t", "t"]) for i in range(n)]
        nodes = main_text.Nodes(np.zeros(n, np.int64), parent, ["div"] * n, [()] * n, text, np.zeros(n), np.zeros(n))
        margin = r.normal(size=n) * 3
        best, choice = 0.0, np.zeros(n, bool)
        for kept in product([False, True], repeat=int(n)):
            fits = all(not k or ((p < 0 or kept[p]) and (t or any(kept[j] for j in range(n) if parent[j] == i))) for i, (k, p, t) in enumerate(zip(kept, parent, text)))
            total = sum(m for m, k in zip(margin, kept) if k)
            if fits and total > best:
                best, choice = total, np.array(kept)
        assert (main_text.decode(nodes, margin) == choice).all()


def test_main_text_of_layouts_never_seen(model):
    held = [Layout(10_000 + i) for i in range(150)]
    found = model.texts([read(x.html) for x in held])
    exact = [f == "\n".join(" ".join(b.split()) for b in x.main) for f, x in zip(found, held)]
    assert np.mean(exact) > 0.75
    assert np.mean([e for e, x in zip(exact, held) if not x.plain]) > 0.8


def test_pages_with_everything_around_the_article(spark, model):
    inner = "<h1>Title here</h1><p>First &eacute; paragraph, with words.</p><p>Second  one\n here.</p>"
    page = (
        '<html><head><title>T</title></head><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>'
        f'<div class="cookie-notice">We use cookies.</div><article>{inner}<div class="ad">Buy this now.</div></article><aside class="sidebar"><p>Read also <a href="/c">this</a></p></aside>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree at all.</p></div></section><form>Mail <input></form><footer>&copy; us</footer></body></html>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (1, "u", page), (None, "u", "<nav><a href='/'>x</a></nav>")]
    df = spark.createDataFrame([(*r, "t", "r") for r in rows], SCHEMA)
    found = [(x["row"]["page_id"], x["text"]) for x in main_text.extract(df, model).collect()]
    expected = "Title here\nFirst é paragraph, with words.\nSecond one here."
    assert found[:4] == [(1, expected), (2, ""), (3, ""), (1, expected)] and len(found) == 5
    assert main_text.extract(df.where("false"), model).count() == 0


def test_learning_from_pages_that_name_their_article(spark):
    html = "<body><nav><a href='/'>m</a></nav><article><p>one two three.</p></article></body>"
    df = spark.createDataFrame([(i, "u", html if i % 2 else "<div>none", "t", "r") for i in range(40)], SCHEMA)
    model = main_text.learn(df, layouts=60, sample_pages=20)
    assert {x["text"] for x in main_text.extract(df.where("page_id % 2 = 1"), model).collect()} == {"one two three."}
