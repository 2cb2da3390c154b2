import html
import itertools
import math
import random
import re
import time
from collections import Counter

import pytest

from tuplewise.llm import html_text
from tuplewise.llm import html_text as H

from .conftest import DATA


@pytest.fixture(scope="module")
def model():
    return H.default_model()


PAGE = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now. It is cheap.</div><article><h1>The   title</h1><p><b>First &amp; foremost, a  paragraph\nof text.<br><p>Second one &lt;here&gt;.</p></article><footer>&copy; site &middot; More words here.</footer>'


def test_article(model):
    assert H.main_text(PAGE, model) == "The title\n\nFirst & foremost, a paragraph of text.\n\nSecond one <here>."


@pytest.mark.parametrize(("part", "gone"), [
    ('<aside class="sidebar"><p>Related words stand here.</p></aside>', "Related"), ('<div class="cookie notice"><p>We use cookies on this site.</p></div>', "cookies"),
    ('<section class="comments"><h3>Comments</h3><div class="comment"><p>What a fine article this is.</p></div></section>', "fine"), ('<form><label>Name</label><input><button>Send</button></form>', "Name"),
    ('<header class="banner"><p>The site of the day.</p></header>', "site"),
])
def test_boilerplate_goes(model, part, gone):
    text = "<p>This is the only real paragraph of the page, and it says quite enough.</p><p>Here is one more, so that it isn't alone.</p>"
    for html in (f"<body>{part}<article><h1>Head</h1>{text}</article></body>", f"<body><main>{text}</main>{part}</body>"):
        out = H.main_text(html, model)
        assert "only real paragraph" in out and gone not in out


def test_accuracy_on_drawn_pages(model):
    rng, tp, fp, fn = random.Random(5), 0, 0, 0
    for _ in range(150):
        html, good = H.draw_page(rng)
        got = {w.strip(".").lower() for w in H.main_text(html, model).split()}
        tp, fp, fn = tp + len(got & good), fp + len(got - good), fn + len(good - got)
    assert tp / (tp + fp) > 0.99 and tp / (tp + fn) > 0.98


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small tree."""
    nodes = H.parse("<article><h1>a</h1><div class=ad><p>b</p></div></article>")
    features = H.node_features(nodes)
    unary = [sum(model.weights.get(f, 0.0) for f in fs) for fs in features]
    total, on = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(u * x for u, x in zip(unary, labels, strict=True)) + sum(model.edge[labels[n.parent]][labels[i]] for i, n in enumerate(nodes) if i))
        total += w
        on = [o + w * x for o, x in zip(on, labels, strict=True)]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), on, strict=True))


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "</p></div>", "<![CDATA[x]]>", "<!-- never closed", "<script>x", "&#0;&#xfffffff;", "<div>" * 3000 + "x", "<table><tr><td>a<tr><td>b", "\x00<p>\x00"])
def test_broken_html_is_no_error(model, html):
    assert isinstance(H.main_text(html, model), str)


def test_operator(spark, model):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", None), (3, "w", "<p>" + "long text. " * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = H.extract_text(pages).collect()
    assert len(out) == 5 and H.extract_text(pages.limit(0)).count() == 0
    assert {r.page_id: r.n_chars for r in out}[2] == 0 and all(r.n_chars == len(r.text) for r in out)


def words(text):
    return Counter(text.split())


def test_real_pages_held_out(spark):
    """Pages of the tables, which the model never saw, labelled by what their authors put into <article>: precision and recall by words."""
    found = wanted = right = 0
    pages = html_text.extract_text(spark.read.parquet(f"{DATA}/pages.parquet"), keep=("page_id", "html")).collect()
    for r in pages:
        inside = re.findall(r"<article>(.*?)(?:</article>|<footer>|$)", r.html or "", re.S)
        inside = re.sub(r"<(script|style|form|aside)\b.*?</\1>|<div class=.(?:ad|comment)[^>]*>.*?</div>|<!--.*?-->", " ", " ".join(inside), flags=re.S)
        want, got = words(html.unescape(re.sub(r"<[^>]+>", " ", inside))), words(r.text)
        found, wanted, right = found + got.total(), wanted + want.total(), right + (got & want).total()
    assert len(pages) >= 50 and right / found > 0.99 and right / wanted > 0.99


def test_hand_labelled_pages():
    model = html_text.default_model()
    cases = [
        ("<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, we are done.</p></article><footer>&copy; 2020 All rights</footer>", "Where x=2 holds, we are done."),
        ("<main><h1>Title here</h1><p>Press the <button>Save</button> key to keep the long document you wrote.</p></main><div class=sidebar><a href=1>One</a><a href=2>Two</a></div>", "Title here\n\nPress the Save key to keep the long document you wrote."),
        ("<div class=content><p>A chart <svg><text>42 percent</text></svg> stands in this longer paragraph.</p><p>And more of it follows here &amp; there.</p></div><script>x()</script>", "A chart 42 percent stands in this longer paragraph.\n\nAnd more of it follows here & there."),
        ("<article><p>First paragraph of the story, quite long.<p>Second\n paragraph\tof the story.</article><form><label>Name</label><input><select><option>a</select></form>", "First paragraph of the story, quite long.\n\nSecond paragraph of the story."),
    ]
    for source, want in cases:
        assert html_text.main_text(source, model) == want


def plain_marginals(model, nodes):
    """Every labelling of a small tree, weighed one by one."""
    features = html_text.node_features(nodes)
    score = [sum(model.weights.get(f, 0.0) for f in fs) for fs in features]
    total, on = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(s * x for s, x in zip(score, labels, strict=True)) + sum(model.edge[labels[n.parent]][x] for n, x in zip(nodes[1:], labels[1:], strict=True)))
        total += w
        for i, x in enumerate(labels):
            on[i] += w * x
    return [x / total for x in on]


def test_text_equals_a_plain_version():
    """Whole extraction against enumeration of all labellings, over drawn pages small enough for it."""
    model, rng, seen = html_text.default_model(), random.Random(4), 0
    while seen < 12:
        source, _ = html_text.draw_page(rng)
        nodes = html_text.parse(source)
        if len(nodes) > 13:
            continue
        seen += 1
        on = plain_marginals(model, nodes)
        runs = sorted((at, t) for n, p in zip(nodes, on, strict=True) if p >= 0.5 for at, t in n.runs)
        assert html_text.main_text(source, model) == "\n\n".join(t for _, t in runs)


def test_deep_and_long_pages_are_linear():
    model = html_text.default_model()
    for source in ("<div>" * 60_000 + "text", "<p><button>" + "<div>" * 40_000, "<b>" * 60_000 + "x", "<ul><li>" * 30_000 + "y", "<p>a</i>" * 30_000, "<table><tr><td>" * 20_000 + "z"):
        began = time.time()
        html_text.main_text(source, model)
        assert time.time() - began < 12
