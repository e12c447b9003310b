import html
import re

import numpy as np

from tideline.llm import htmltext as H
from tideline.llm.queries import QUERIES


def test_blocks_paths_and_references():
    page = "<!-- x --><html><head><title>T &amp; t</title><script>var a='</p>';</script><style>p{}</style></head><body>lead<p>a  &eacute;\n b<b>c</b><p>d<ul><li>x<li>y</ul><img src='>'>tail<a href='/q'>go</a></body>"
    texts, paths, linked = H.blocks(page)
    assert texts == ["T & t", "lead", "a é bc", "d", "x", "y", "tailgo"]
    assert len(paths) == len(linked) == 7 and 0 < linked[-1] < 1 and linked[0] == 0
    for bad in ("", None, "<", "<<p>a", "</p></p>", "<script>", '<p class="x>a', "<p" * 50):
        H.blocks(bad)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = H.Lstm()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = H.padded([rng.standard_normal((n, H.INPUT)) for n in (4, 2)])
    y = rng.integers(0, 2, mask.shape)

    def loss():
        p = net.forward(x, mask)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads, _ = net.gradients(x, mask, y)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            held = flat[k]
            flat[k] = held + 1e-3
            up = loss()
            flat[k] = held - 1e-3
            down = loss()
            flat[k] = held
            assert abs((up - down) / 2e-3 - g.reshape(-1)[k]) < 2e-3, name


def test_held_out_pages():
    net, maker = H.trained(), H.Pages(99)
    right = total = 0
    for _ in range(150):
        whole, labels, _ = H.labelled_page(maker)
        got = net.label([H.features(whole)[1]])[0]
        right += int(((got >= 0.5) == (labels > 0)).sum())
        total += len(labels)
    assert right / total > 0.985


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inside))
    return "\n".join(p for p in parts if p)


def test_query_extracts_the_article(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op9_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    right = sum(r.text == article(pages[r.page_id].html) for r in got)
    assert right >= 0.99 * len(got) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>Some text of the article.</p></article></body></html>", "x"), (3, "u", "<body><article><h1>T</h1>" + "<p>More words stand here.</p>" * 3000 + "</article></body>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert [r.text for r in got[:3]] == ["", "", "Title here\nSome text of the article."] and got[3].text.count("\n") >= 2990
    assert H.extract(df.filter("false")).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    n = 40_000
    pages = ['<a href="' * n, '<a href="' * n + ">", '<a ">"' * n + "'", "<script>" * n, "<script" * n, "<div>" * n + "x", "<dd><ul>" + "<blockquote>" * n + "<dd></dd>" * n, "<p" * n, "<!--" * n, "<! " * n, "<ul><li>" * n, "<p>x" * n + "</div>" * n, "<" * n, "&" * n, "<style>a</styl" * n]
    for page in pages:
        began = time.perf_counter()
        H.blocks(page)
        assert time.perf_counter() - began < 2, page[:20]


def test_lexing_of_odd_markup():
    assert H.blocks('<p title="a > b">x</p><p>y')[0] == ["x", "y"]
    assert H.blocks('<p title=">x</p><p>y</p>')[0] == ["x", "y"]
    assert H.blocks("<p>a<!-- <p>b</p> --><p>c<!-- d <p>e")[0] == ["a", "c"]
    assert H.blocks("<p>a < b and c > d</p>5 <")[0] == ["a < b and c > d", "5 <"]
