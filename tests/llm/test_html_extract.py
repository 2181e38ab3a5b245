import html
import itertools
import random
import re
import time

import numpy as np

from tracelens.llm import html_extract as h

SCHEMA = "page_id bigint, url string, html string, text string, n_chars bigint"
W = h.prior_weights()

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="page"><header><h1>Site name</h1><p>Welcome, this is our site.</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav><div class="ad">Buy this thing today, it is good.</div>
<article><header><h1>Title &amp; more</h1></header><p>First  para with 1 < 2 and <b>bold</b>&nbsp;text.<p>Second &lt;para&gt; is here.
<aside><p>Read also this other long story of ours.</p></aside><div class="share-buttons">Share this</div><p>Short.</p><!-- <p>gone</p> --></article>
<section id="comments"><h3>Comments</h3><p>I do not agree with any of this, my friends.</p></section>
<form><label>Mail</label><button>Go</button></form><div class="cookieNotice">We use cookies.</div><footer>&copy; us</footer><script>x="<p>no</p>"</body></html>"""


def test_page_with_all_kinds_of_boilerplate():
    assert h.main_text(PAGE, W) == "Title & more\nFirst para with 1 < 2 and bold text.\nSecond <para> is here.\nShort."


def test_page_without_semantic_tags():
    page = ("<div class=menu><a href=a>A</a> <a href=b>B</a></div><div id='content'><p>" + "Some words of a real text. " * 8
            + "</p><p>One more paragraph of it, not long.</p></div><div class='sidebar'>Latest items and so on.</div>")
    assert h.main_text(page, W) == ("Some words of a real text. " * 8).strip() + "\nOne more paragraph of it, not long."


def test_broken_markup_ends():
    for page in ("<p>a", "<", "<p", "</", "<!--", "<!-- x", "<script>", "<p class=\"x>text</p>", "a < b > c", "<article>&am</article>", "&" * 1000,
                 "<b>" * 3000 + "x", "</p>" * 3000, "<p \"" * 5000, "<script" * 3000, "<!" * 5000):
        h.main_text(page, W)
    assert h.main_text("<article><p>cut &am</p></article>", W) == "cut &am"


def cut_cost(cost, edges, labels):
    return sum(max(0, c) if not x else max(0, -c) for c, x in zip(cost, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        cost = [rng.choice([-3, -1, -0.5, 0.5, 1, 2, rng.gauss(0, 2)]) for _ in range(n)]
        edges = [(i, j, rng.random() * 3) for i in range(n) for j in range(i) if rng.random() < 0.5]
        best = min(cut_cost(cost, edges, x) for x in itertools.product([True, False], repeat=n))
        assert abs(cut_cost(cost, edges, h.min_cut(cost, edges)) - best) < 1e-9


def chain_cost(cost, weights):
    """The least cost of labelling a chain, by a pass over it."""
    keep, drop = max(0, -cost[0]), max(0, cost[0])
    for c, w in zip(cost[1:], weights, strict=True):
        keep, drop = max(0, -c) + min(keep, drop + w), max(0, c) + min(drop, keep + w)
    return min(keep, drop)


def test_min_cut_of_long_chains_is_minimal():
    rng = random.Random(5)
    for n in (50, 2000, 80_000):
        for spread in (0.1, 1, 4):
            cost = [rng.gauss(0, spread) for _ in range(n)]
            weights = [rng.choice([0.2, 0.4, 0.8]) for _ in range(n - 1)]
            edges = [(i, i + 1, w) for i, w in enumerate(weights)]
            assert abs(cut_cost(cost, edges, h.min_cut(cost, edges)) - chain_cost(cost, weights)) < 1e-6 * n


def test_pages_of_many_mixed_blocks_and_deep_tags_take_linear_time():
    begin = time.monotonic()
    paragraph, advert = "<p>A sentence of the real text is here.</p>", "<div class=ad><p>Buy this thing today.</p></div>"
    page = "<article>" + (paragraph + advert) * 40_000 + "</article>"
    assert h.main_text(page, W).split("\n") == ["A sentence of the real text is here."] * 40_000
    deep = 60_000
    for page in ("<b>" * deep + "<p>x</p>" * deep, "<b>x" * deep + "</i>" * deep + "</b>" * deep, "<div>" * deep + "x" + "</div>" * deep,
                 "<b><p>x" * deep, "<" * 20 * deep, "<a" * deep + ">", "<li><i>x" * deep + "</i>" * deep, "<!" * 10 * deep):
        h.main_text(page, W)
    assert time.monotonic() - begin < 120


def test_cut_decides_where_blocks_alone_mislead():
    # No semantic tags or names: a line without a sentence amid paragraphs is text, a lone paragraph amid links is not.
    text = "<p>" + "Some words of a real text that goes on. " * 5 + "</p>"
    line = "<div>E is m c squared</div>"
    links = "".join(f"<div><a href={k}>Item {k}</a></div>" for k in range(4))
    for page, blocks, changed in ((text + line + text, 3, 1), (text + line + text + line + text, 5, 2), (links + "<p>Follow us</p>" + links, 9, 1)):
        found = h.blocks_of(page)
        alone = [c > 0 for c in h.costs_of(found, W)]
        labels = h.label_blocks(found, W)
        assert len(found) == blocks and sum(a != b for a, b in zip(alone, labels, strict=True)) == changed
        assert all(labels) if page.startswith("<p>") else not any(labels)


def test_article_text_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extract(pages).collect()}
    for p in pages.collect():
        body = re.search("<article>(.*?)</article>", p.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_odd_rows(spark):
    rows = [(1, "u", None, "t", 0), (2, None, "", "t", 0), (None, "u", PAGE, "t", 0), (3, "u", PAGE, "t", 0), (3, "u", PAGE, "t", 0),
            (4, "u", "<article>" + "<p>long text here.</p>" * 4000 + "</article>", "t", 0)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = h.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars > 0) for r in got) == [("1", False), ("2", False), ("3", True), ("3", True), ("4", True), ("None", True)]
    assert next(r for r in got if r.page_id == 4).text.count("\n") == 3999
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_training_keeps_prior_for_unseen_features():
    w = h.train(np.array([[1.0] + [0.0] * (len(h.FEATURES) - 1)] * 10), np.ones(10))
    assert w[0] > W[0] and np.allclose(w[1:], W[1:])
