import html
import random
import re

import numpy as np
from tallyflow.llm import html_extract as hx


def article_text(page):
    """Plain expectation for the tables' template: blocks of the article element."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    clean = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in parts)
    return "\n".join(x for x in clean if x)


def test_query_equals_plain_extraction(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in hx.op6_html_extract(spark, sf).collect()}
    expected = {i: (t := article_text(h), len(t)) for i, h in pages.items()}
    assert got == expected


def test_held_out_layouts():
    rng = random.Random(77)
    pages = [hx.parse(hx.labelled_page(rng), labelled=True) for _ in range(150)]
    one, _ = hx.sum_product(hx.Forest.of(pages), hx.trained())
    truth = np.array([t for p in pages for t in p.truth])
    assert np.mean((one > 0.5) == truth) > 0.985


def test_marginals_equal_enumeration():
    page = hx.parse("<body><div class=x><p>one</p><p>two <a href=1>three</a></p></div><nav>four</nav></body>")
    forest = hx.Forest.of([page])
    rng = np.random.default_rng(2)
    weights = hx.Weights(rng.normal(size=hx.TABLE), rng.normal(size=(2, 2, 2)))
    one, both = hx.sum_product(forest, weights)
    n = len(forest.parents)
    unary = np.bincount(forest.owner, weights.unary[forest.feature], minlength=n)
    total, single, edge = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        w = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(weights.pair[forest.kinds[i], y[forest.parents[i]], y[i]] for i in range(1, n)))
        total += w
        for i in range(n):
            single[i] += w * y[i]
            if i:
                edge[i, y[forest.parents[i]], y[i]] += w
    assert np.allclose(one, single / total)
    assert np.allclose(both, edge[1:] / total)


def test_parser_cases():
    def blocks(text):
        return [t for _, t, _ in hx.parse(text).blocks]

    assert blocks(None) == blocks("") == []
    assert blocks("<p>a<p>b<b>c<br><p>d") == ["a", "bc", "d"]
    assert blocks("x <!-- <p>no</p> --> y<script>var t='</p>';</script>z") == ["x y z"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("<div title='a > b'>t &lt;x&gt; &amp&a&nbsp;u</div>") == ["t <x> &&a u"]
    assert blocks("<p>cut <scr") == blocks("<p>cut <a href='x") == ["cut"]
    assert blocks("<p>cut <!-- open") == ["cut"]
    assert len(hx.parse("<div>" * 5000 + "deep").tags) == 5001


def test_elements_hide_no_text_after_them():
    cases = {
        "<article><p>a</p><svg/><p>b</p></article>": "a\nb",
        "<article><p>a</p><iframe src=x /><p>b</p></article>": "a\nb",
        "<article><p>a</p><iframe src=x><p>b</p></article>": "a\nb",
        "<article><p>a</p><button>Go<p>b</p></article>": "a\nb",
        "<article><p>a</p><select><option>no<option>no</select><p>b</p></article>": "a\nb",
        "<article><p>a</p><video><div>no</div></video><p>b</p></article>": "a\nb",
        "<article><div>a <svg><text>no</text><g><path d='1'/></g></svg> b</div><p>c</p></article>": "a b\nc",
        "<article><p>a <math>x</math> b</p></article>": "a x b",
        "<article><p>a <object data=q>shown</object> b</p></article>": "a shown b",
        "<article><p>a</p><noscript>shown</noscript></article>": "a\nshown",
        '<article><p title="x>b</p><p>c</p></article>': "b\nc",
        "<article><p>a</p><textarea>no<p>b</p></article>": "a\nno\nb",
    }
    pages = [hx.parse(x) for x in cases]
    assert ["\n".join(t for _, t, _ in p.blocks) for p in pages] == list(cases.values())
    assert hx.main_texts(pages, hx.trained()) == list(cases.values())
    assert [t for _, t, _ in hx.parse("<p>a</p><script>x<p>b</p>").blocks] == ["a"], "the rest is code"


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", "<article><h1>T</h1><p>" + "word and word. " * 20000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((r.page_id or 0, r.n_chars, r.text[:3]) for r in hx.extract(df).collect())
    assert got == [(0, 300001, "T\nw"), (1, 0, ""), (2, 0, ""), (2, 0, "")]
    assert hx.extract(df.limit(0)).collect() == []


def prose(n, about="the matter"):
    return " ".join(f"Sentence number {k} tells something about {about}, plainly." for k in range(1, n + 1))


def test_pages_without_known_names():
    """Articles that no tag or name tells: bare bodies, unknown and foreign names, table layouts."""
    a, b, c = prose(4), prose(2, "a harbour"), prose(7, "old clocks")
    cases = {
        f"<body><p>{a}</p><p>{b}</p></body>": [a, b],
        f"<body><h1>Title here</h1><p>{c}</p></body>": ["Title here", c],
        f"<p>{b}</p>": [b],
        f"<div>{a}</div>": [a],
        f'<div id="wrap"><div class="inner"><h1>T</h1><p>{c}</p></div></div>': ["T", c],
        f'<div id="inhalt"><p>{a}</p><p>{b}</p></div>': [a, b],
        f'<div class="contenido"><h2>Titulo</h2><p>{c}</p><p>{a}</p></div>': ["Titulo", c, a],
        f'<table><tr><td><a href="/">Home</a></td><td><p>{c}</p></td></tr></table>': [c],
        f"<table><tr><td><a href=/>Home</a><td>{a}</table>": [a],
        f'<body><nav><ul><li><a href=/>A</a></li></ul></nav><p>{a}</p><p>{b}</p><footer>c 2020</footer></body>': [a, b],
        f'<html><body><div class="q1"><div class="q2"><p>{c}</p></div></div></body></html>': [c],
        f'<html><body><section><h1>Report</h1><p>{a}</p><p>{c}</p></section></body></html>': ["Report", a, c],
        f'<body><div class="kopf"><a href=/>Start</a> <a href=/x>Mehr</a></div><div class="haupt"><h2>Titel</h2><p>{c}</p></div></body>': ["Titel", c],
    }
    texts = hx.main_texts([hx.parse(x) for x in cases], hx.trained())
    assert texts == ["\n".join(x) for x in cases.values()]


def test_ends_of_comments_and_scripts():
    def blocks(text):
        return [t for _, t, _ in hx.parse(text).blocks]

    assert blocks("<p>x</p><!--><p>a</p><!---><p>b</p><script>1</script foo><p>c</p><script>2</script/><p>d</p><!-- no --!><p>e</p>") == ["x", "a", "b", "c", "d", "e"]
    for tag in ("canvas", "video", "audio controls"):
        assert blocks(f"<p>a</p><{tag}><p>b</p>") == ["a", "b"]
    assert blocks("<p>a</p><canvas><p>no</p></canvas><p>b</p><canvas><p>c</p>") == ["a", "b", "c"]
