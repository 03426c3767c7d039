import html
import itertools
import re
import time

import numpy as np

from gossamer.llm import html_extract as H


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", inner))
    return " ".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_fixture_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = H.op6_crf_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_pages():
    model, right, total = H.train(), 0, 0
    for parts in H.labelled_pages(200, 77):
        page = H.labelled_blocks(parts)
        labels = H.decode([sum(model[0].get(x, 0.0) for x in f) for (_, f), _ in page], model[1])
        right, total = right + sum(a == b for a, (_, b) in zip(labels, page)), total + len(page)
    assert right / total > 0.97


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        s, step = rng.normal(size=n), rng.normal(size=(2, 2))
        value = lambda x: sum(s[i] for i in range(n) if x[i]) + sum(step[a, b] for a, b in zip(x, x[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert H.decode(s.tolist(), step) == [bool(x) for x in best]
    assert H.decode([], np.zeros((2, 2))) == []


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies. <a href=#>Accept</a></div>
<header><a href=/>Site name</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<main><article><h1>Big &amp; new</h1><p>First <b>para</b>graph  of\nthe story&nbsp;here.</p><div class="ad">Buy this thing now.</div><p>Second paragraph of the story, with more words in it.</p>
<script>var x = "<p>no</p>";</script><!-- <p>no</p> --></article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/x>Another story</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div><p>I liked this story very much indeed.</p></div></section>
<form action=/s><label>Your mail</label><input name=m><button>Go</button></form><footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""


def test_page_with_all_kinds_of_parts():
    assert H.main_text(PAGE, H.train()) == "Big & new First paragraph of the story here. Second paragraph of the story, with more words in it."


def test_page_without_article():
    page = PAGE.replace("<main><article>", '<div class="post-content">').replace("</article></main>", "</div>")
    assert H.main_text(page, H.train()) == H.main_text(PAGE, H.train())


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (3, "u", "<article><p>cut here & th", 3), (3, "u", "<article><p>cut here & th", 3), (4, "u", "<article><p>a < b and <3 <", 4)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got[1] == got[2] == "" and got[3] == "cut here & th" and got[4].startswith("a < b and <3")
    assert H.extract(pages.limit(0)).count() == 0


def test_long_and_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 100_000, "<p><b>" * 50_000, "<" * 300_000, "<a href=\"" * 30_000, "<!--" * 100_000, "&amp;" * 200_000, "<article><p>word </p>" * 20_000):
        H.blocks(page)
    assert time.time() - began < 30


def test_letters_that_grow_in_lower_case_do_not_move_the_end_of_a_script():
    for n in (1, 5, 12, 400):
        page = "<p>" + "İ" * n + "</p><script>x</script>REAL TEXT<style>y</STYLE><p>more</p>"
        assert [t for t, _ in H.blocks(page)] == ["İ" * n, "REAL TEXT", "more"]


def test_cues_are_sought_in_the_whole_block_and_attribute():
    (_, f), = H.blocks("<p>" + "word " * 1000 + "All rights reserved.</p>")
    assert "cue-copyright" in f
    assert H.told(' class="' + "px-2 " * 200 + 'sidebar"') == {"side"}
