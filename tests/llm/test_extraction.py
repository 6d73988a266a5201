from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from waybook.llm import extraction, page_examples


@pytest.fixture(scope="module")
def model():
    return extraction.train(page_examples.pages())


def test_held_out_pages(model):
    maker = page_examples._Maker(77)
    held = [maker.page() for _ in range(60)]
    labels = [extraction.parse(p, labelled=True) for p in held]
    trees = extraction.forest([extraction.parse(p) for p in held])
    content = extraction.marginals(model, trees)[0] >= 0.5
    right = total = 0
    at = 0
    for page in labels:
        for text, label in zip(page.text, page.label):
            right += len(text) * (content[at] == bool(label))
            total += len(text)
            at += 1
    assert right > 0.97 * total


def test_marginals_are_those_of_all_states():
    rnd = np.random.default_rng(1)
    pages = [extraction.parse("<body><nav><p>a<p>b</nav><article><div>c<p>d</div>e</article>"), extraction.parse("x")]
    trees = extraction.forest(pages)
    model = extraction.Model(rnd.normal(size=(2, extraction.FEATURES)), rnd.normal(size=(2, 2, 2)))
    n, kind = len(trees.parent), trees.kinds()
    own = np.bincount(trees.rows, model.weights[kind[trees.rows], trees.columns], minlength=n)
    total, share, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in itertools.product((0, 1), repeat=n):
        inner = [i for i in range(n) if trees.parent[i] >= 0]
        w = np.exp(sum(own[i] * state[i] for i in range(n)) + sum(model.pairs[kind[i], state[trees.parent[i]], state[i]] for i in inner))
        total += w
        share += w * np.array(state)
        for i in inner:
            pair[i, state[trees.parent[i]], state[i]] += w
    p, both = extraction.marginals(model, trees)
    assert np.allclose(p, share / total) and np.allclose(both, pair / total)


def test_text(model):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href=/x>menu</a></li><li><a href=/y>more</a></li></ul></nav>"
        "<!-- <p>no</p> --><div class='ad'>Buy this now. It is cheap.</div><article><h1>A&nbsp;head</h1><p>One&amp;<b>tw</b>o  \n three.<br>Four<p>Five &lt;b&gt; six.</p><p>Seven is a longer sentence here.</article>"
        "<section class=comments><p>Reader</p><p>I do not think so at all.</p></section><footer>&copy; site. All rights.</footer>"
    )
    assert extraction.texts(model, [page]) == ["A head One&two three. Four Five <b> six. Seven is a longer sentence here."]


def words_of(source):
    return " ".join(" ".join(extraction.parse(source).text).split())


@pytest.mark.parametrize("name", ["button", "select", "svg", "object", "template", "noscript"])
def test_what_is_left_out_ends_with_its_element(name):
    article = "<article><p>One two. <b>Three</b></p></article>"
    for page in (
        f"<div><{name}><span>x</span> y</{name}></div>{article}",
        f"<div><{name}><span>x</span> y</div>{article}",
        f"<{name}>x{article}",
        f'<{name}/>{article}',
        f'<{name} class="a=b" />{article}',
        f"<{name}>x<{name}>y</{name}></{name}>{article}" if name not in ("button", "select") else f"<{name}>x<{name}>y</{name}>{article}",
        f"<{name}><!-- </{name}> --><div>x<script>'</{name}>'</script></div></{name}>{article}",
    ):
        assert words_of(page) == "One two. Three", page
    assert words_of(f"<p><a><{name}>x</a> One.</p>{article}") == "One. One two. Three"
    assert words_of(f"<body><{name} data=/a/>x</{name}>{article}") == "One two. Three"


def test_many_open_elements_are_read_once():
    assert words_of("<svg><p>w " * 20_000 + "</svg>").count("w") == 19_999
    page = "<svg><p>w " * 20_000
    assert words_of(page).count("w") == 20_000


def test_quotes_open_values_only():
    for tag in ("<a href=x title=don't>", "<a don't href=x>", '<a href=x"y title=z>', "<a href=/x?a='b>", "<a href='x>y' title = \"a>b\">"):
        assert words_of(f"<p>{tag}One</a> isn't two.</p><article><p>It's \"three\"</p></article>") == "One isn't two. It's \"three\"", tag
    assert words_of("<p title='>x'>One<br/>two<p class=\"'\">three") == "One two three"


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "<p>deep text here, a sentence.</p>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "<p <b>>"), (3, "u", "<p <b>>"), (4, "u", "<article>" + "<b>" * 5000 + "<p>Word word. " * 5000), (5, "u", deep), (6, "u", "<script>x"), (7, "u", "</p></div>a<a href='x>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = extraction.extracted(df).collect()
    assert sorted(((r["page_id"], r["url"]) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2, 6)} == {""}
    assert next(r["n_chars"] for r in got if r["page_id"] == 4) == 11 * 5000 - 1
    assert extraction.extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<a " * 300_000, "<!" * 300_000, "<" * 300_000, "<script>" + "</script " * 200_000, '<a b=">" ' * 100_000, "<a<" * 200_000, "<p>" + "<a b='x\" " * 100_000 + ">"])
def test_broken_tags_take_linear_time(page):
    start = time.process_time()
    extraction.parse(page)
    assert time.process_time() - start < 5


def test_tags_without_an_end():
    texts = lambda page: [t for t in extraction.parse(page).text if t]
    assert texts("<p>one</p> two <a href=x <b") == ["one", "two <a href=x <b"]
    assert texts('<p>one</p><a title="x <p>two</p>') == ["one", "two"]
    assert texts("<p>one <!-- two > three") == ["one"]
    assert texts("<p>one<script> two </script three") == ["one"]
    assert texts('<p title="a>b">one</p><img alt=a<b>two') == ["one", "two"]
