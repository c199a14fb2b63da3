import random

import pytest

from siftwire.llm import html_extract as H


@pytest.fixture(scope="module")
def trees(spark):
    return H.fit(spark)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><!-- no -->
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Other</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph
is here.<br><p>Second&nbsp;one, with <a href="/x">a link</a> &lt;b&gt; in it.</p><div class="ad">Buy this</div><p>Third.</p></article>
<aside class="sidebar"><h3>Related</h3><p>Something else to read here</p></aside><section id="comments"><div class="comment"><p>I think so too</p></div></section>
<form action="/s"><label>Search</label><input></form><footer>&copy; me</footer>"""


def test_page_with_all_parts(spark, trees):
    rows = [(1, PAGE, "old"), (2, None, None), (3, "", ""), (4, "plain &amp; text", ""), (5, "<p>" * 3000 + "x", ""), (6, PAGE, "again"), (7, "<", "")]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), trees).collect()}
    assert got[1] == "Head & line\nFirst paragraph is here.\nSecond one, with a link <b> in it.\nThird."
    assert got[2] == got[3] == "" and got[4] == "plain & text" and got[6] == got[1]
    assert H.extract(spark.createDataFrame([], "page_id long, html string"), trees).count() == 0


def test_unseen_pages(trees):
    rng, good = random.Random(4321), 0
    for _ in range(150):
        page, mark = H._made_up_page(rng)
        order = H.listed(H.parse(page))
        text = H.blocks(order, H.decode(order, trees.probability(H.features(order))))
        good += text.count(mark) == page.count(mark) and all(mark in b for b in text.split("\n") if b)
    assert good >= 130


def test_choices_never_contradict(trees):
    rng = random.Random(1)
    for _ in range(30):
        order = H.listed(H.parse(H._made_up_page(rng)[0]))
        keep = dict(zip(map(id, order), H.decode(order, [rng.random() for _ in order]), strict=True))
        assert all(keep[id(n.parent)] or not keep[id(n)] for n in order[1:])


def text_of(trees, page):
    order = H.listed(H.parse(page))
    return H.blocks(order, H.decode(order, trees.probability(H.features(order))))


def test_depth_and_width_have_no_bound(trees):
    words = "Here stands one plain sentence of an article, long enough to be one."
    for depth in (5, 397, 398, 5000):
        assert text_of(trees, "<body>" + "<div>" * depth + f"<article><p>{words}</p><p>{words}</p></article>" + "</div>" * depth) == f"{words}\n{words}"
    for n in (10, 49, 50, 1999, 2000, 5000):
        page = "<nav><a href=/>Home</a></nav><article><h1>Head</h1>" + "".join(f"<p>{words} {i}</p>" for i in range(n)) + "</article><footer>me</footer>"
        assert text_of(trees, page) == "\n".join(["Head", *(f"{words} {i}" for i in range(n))])


def test_features_of_a_node_do_not_change_with_the_width_of_its_parent():
    at = H.FEATURES.index("same_siblings")
    for n in (3, 60, 3000):
        order = H.listed(H.parse("<article>" + "<p>x</p>" * n + "<div>y</div></article>"))
        rows = H.features(order)
        assert {rows[i, at] for i, node in enumerate(order) if node.tag == "p"} == {n} and rows[-1, at] == 1


def test_text_of_unusual_elements_stays(trees):
    words = "Here stands one plain sentence of an article, long enough to be one."
    page = f"<article><p>{words}</p><p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <noscript>no script</noscript> <object>a thing</object>. {words}</p><script>no()</script></article>"
    assert "".join(text_of(trees, page).split()) == "".join(f"{words} Then x=2 and no script a thing. {words}".split())


def test_pages_that_close_nothing_take_linear_time():
    import time

    hostile = ["<" * 10**6, '<a "' * 250_000, '"' * 10**6, '<"' * 500_000, "<a '\"" * 200_000, "<" * 10**6 + '">', '<a "' * 250_000 + ">", "<a " * 333_000, "<template>" * 100_000, "<head>" * 150_000, "</a>" * 250_000, "<!" * 500_000, "<b><div>" + "<span class=nav>" * 30_000 + "</b>" * 60_000]
    for page in hostile:
        began = time.time()
        order = H.listed(H.parse(page))
        assert time.time() - began < 5, page[:10]
        assert order[0].tag == "html"


def test_stray_signs_are_text():
    def read(page):
        order = H.listed(H.parse(page))
        return H.blocks(order, [True] * len(order))

    assert read("<p>1 < 2 <b>and</b> 3 > 2</p><p>a<3</p>") == "1 < 2 and 3 > 2\na<3"
    assert read('<p>x <a title="1 > 0">y</a> z') == "x y z"
    assert read('<p>open <a "quote</p><p>next</p>') == 'open <a "quote\nnext'
    assert read("<p>cut <b") == "cut <b"
    assert read("<!-- a --><p>b</p><!-- c") == "b"
    assert read("<><p>d</p></ ></>") == "<>\nd"
