"""Main texts against texts that don't come from the reader, and what bounds a page's memory and time."""

import html as h
import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tilewise.llm import html_text

BLOCKS = "p|h1|h2|h3|br|div|ul|li|section|table|tr|td|blockquote"


def stripped(inner):
    """The text of a piece of clean markup."""
    inner = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner, flags=re.S)
    inner = re.sub(rf"</?({BLOCKS})\b[^>]*>", "\n", inner)
    return " ".join(h.unescape(re.sub(r"<[^>]+>", "", inner)).split())


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: stripped(re.search(r"<article[^>]*>(.*)</article>", r["html"], re.S)[1]) for r in pages.collect() if r["html"] and "<article" in r["html"]}
    got = {r["page_id"]: r["text"] for r in html_text.op2(spark, sf_dir).collect()}
    assert len(want) > 30 and sum(got[i] == t for i, t in want.items()) >= 0.98 * len(want)


def built(rng, names):
    """(html, main text) of a page whose parts lie in divs: without names, or with names that tell nothing or mislead."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    div = lambda x: f'<div class="{rng.choice(names)}">{x}</div>' if names else f"<div>{x}</div>"
    menu = div("<ul>" + "".join(f'<li><a href="/{i}">{word()}</a></li>' for i in range(rng.randint(4, 9))) + "</ul>")
    head, paras = prose(5), [" ".join(prose(rng.randint(8, 25)) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(4, 9))]
    main = div(f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paras))
    side = div("".join(f'<p><a href="/x{i}">{word()} {word()}</a></p>' for i in range(rng.randint(2, 5))))
    foot = div(f"&copy; {word()} <a href=/about>{word()}</a>")
    return f"<html><head><title>{head}</title><body>{menu}{main}{side}{foot}</body></html>", " ".join([head, *paras])


def test_layouts_without_telling_names(spark, sf_dir):
    model = html_text.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rng, found, exact = random.Random(12), [], []
    for names in ([], ["x1", "c-77", "wrap"], ["sidebar", "widget", "x1"]):
        pairs = [built(rng, names) for _ in range(40)]
        rows = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(pairs)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"].split() for r in html_text.main_text(rows, model).collect()}
        shares = []
        for i, (_, text) in enumerate(pairs):
            want, mine = text.split(), got[i]
            both = len(set(want) & set(mine))
            shares.append(2 * both / (len(set(want)) + len(set(mine))))
        found.append(float(np.mean(shares)))
        exact.append(sum(got[i] == text.split() for i, (_, text) in enumerate(pairs)))
    assert min(found) >= 0.9, found
    assert exact[0] >= 20 and min(exact) >= 5, exact


def test_head_without_an_end():
    read = lambda x: [b.text for b in html_text.Reader().read(x)]
    assert read("<html><head><title>t</title><meta charset=utf-8><body><article><p>All of it.</article>") == ["All of it."]
    assert read("<head><title>t</title><link rel=x><style>p{}</style><p>One<p>Two") == ["One", "Two"]
    assert read("<head><script>var a;</script>text in the head</head><p>after") == ["text in the head", "after"]
    assert read("<title>open<p>after") == ["after"]
    assert read("<p>one<select><option>a<option>b<p>two</p>") == ["one", "two"]
    assert read("<p>one<select><option>a</select>two") == ["one", "two"]


def test_foreign_elements_and_comments_without_an_end():
    read = lambda x: [b.text for b in html_text.Reader().read(x)]
    assert read('<article><svg><path d="x"><p>Text</p></article><p>more') == ["Text", "more"]
    assert read("<article><math><mrow><div>Text</div></article>") == ["Text"]
    assert read("<p>a<svg><g><text>hidden</text><span>b</span> c</p>") == ["ab c"]
    assert read("<p>a<svg><foreignObject><div>hidden</div></foreignObject></svg>b</p>") == ["a", "b"]
    assert read("<p>a<svg><title>t</title><circle/></svg>b") == ["ab"]
    assert read("<p>a<!-- unclosed comment <p>b</p> text") == ["a"]
    assert read("<p>a</p><![CDATA[ b <p>c") == ["a"] == read("<p>a</p><!DOCTYPE x") == read("<p>a</p><?xml b")
    assert read("<p>a<!-- closed --> b <p>c &am") == ["a b", "c &am"]


def test_large_pages_take_bounded_memory():
    page = "<body>" + "".join(f'<div class="c{i % 50}"><p>Word {i} of the text.</p></div>' for i in range(20_000))
    deep = "<div class='a b'>" * 20_000 + "<p>at the end" + "</div>" * 20_000 + "<p>after"
    tracemalloc.start()
    pages = [html_text.Reader().read(x) for x in [page, deep] + ["<p>a<p>b"] * 62]
    assert [b.text for b in pages[1]] == ["at the end", "after"]
    model = html_text.Labeller()
    x = [html_text.vectors(b) for b in pages]
    scores = model.scores(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(s) for s in scores[:3]] == [20_000, 2, 2] and peak < 500 << 20
    alone = model._forward(x[0][None], np.array([20_000]))[0][0]
    assert np.allclose(alone, scores[0], atol=1e-6)


def test_fit_doesnt_follow_the_layout(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one, two = (html_text.fit(p, train_pages=20, epochs=1) for p in (pages, pages.repartition(7, F.rand(3))))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
