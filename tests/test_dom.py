import pyarrow as pa

from gossamer.config import ContentRules, LinkRules, ParseRules
from gossamer.functions import dom
from gossamer.operators import extract

FULL = """<html lang="nl"><head><title>Rain over the harbour</title><meta name="description" content="A wet week">
<meta name="keywords" content="rain, harbour ,, boats"><link rel="canonical" href="https://weer.example/harbour">
<meta property="og:title" content="Rain"><meta property="og:description" content="Wet"><meta property="og:image" content="https://weer.example/boat.jpg">
</head><body><h1>Rain</h1></body></html>"""
P, L, C = ParseRules(), LinkRules(), ContentRules()


def get(source, **kw):
    return dom.extract(source, "https://weer.example/port", kw.get("p", P), kw.get("l", L), kw.get("c", C))


def test_metadata():
    got = get(FULL)
    assert got["title"] == "Rain over the harbour" and got["text_content"] is None and got["content"] is None
    assert got["page_metadata"] == {
        "title": "Rain over the harbour", "description": "A wet week", "keywords": ["rain", "harbour", "boats"], "language": "nl",
        "canonical_url": "https://weer.example/harbour", "twitter_card": {},
        "open_graph": {"title": "Rain", "description": "Wet", "image": "https://weer.example/boat.jpg"},
    }
    assert get("<title>Short</title>")["page_metadata"] == {"title": "Short", "open_graph": {}, "twitter_card": {}}
    assert get("<html><head><title>Cut off</title><body><p>x")["title"] == "Cut off"
    assert get("<title>" + "<b>" * 60 + "deep" + "</b>" * 60 + "</title>")["title"] == "deep"
    assert get("<link rel='a b c d e f g h i j canonical' href='/far'>")["page_metadata"]["canonical_url"] == "/far"
    assert get("<title>a<b>c</b></title><meta property='og:title' content=' og '>")["title"] == "og"
    assert get("<title> </title>")["title"] == ""
    assert get("<h1>one <i>two</i></h1>")["title"] == "onetwo"
    assert get("<meta name='description' content=''><meta property='og:description' content='b'>")["page_metadata"]["description"] == "b"
    assert get("<meta name='date' content='x'><meta name='publish-date' content='y'>")["page_metadata"]["published_date"] == "y"
    assert get("<meta name='twitter:card' content='s'>")["page_metadata"]["twitter_card"] == {"card": "s"}
    assert get(FULL, p=ParseRules(extract_metadata=False))["page_metadata"] == {}


LINKS = """<main><a href="/tides">Tides</a><a href="/boats?sort=age#old">Boats</a><a href="https://weer.example/fish">Fish</a>
<a href="crew">Crew</a><a href="logs/day7?">Day 7</a><a href="#depth">Down to the depth</a><a href="#">up</a>
<a href="https://sea.example/chart">Chart</a><a href="mailto:x@y.z">post</a><a href="javascript:go()">go</a><a href="tel:5">ring</a>
<a href="">none</a><a>bare</a><img src="/buoy.png" alt="Buoy"><img src="flags/red.gif"></main>"""


def test_links():
    got = get(LINKS)["links"]
    assert [(x["pos"], x["kind"]) for x in got] == [(i, "anchor") for i in range(7)] + [(7, "image"), (8, "image")]
    root = "https://weer.example"
    assert [x["url"] for x in got] == [f"{root}/tides", f"{root}/boats?sort=age", f"{root}/fish", f"{root}/crew", f"{root}/logs/day7", f"{root}/port", "https://sea.example/chart", f"{root}/buoy.png", f"{root}/flags/red.gif"]
    assert got[5]["text"] == "Down to the depth" and got[7]["text"] == "Buoy"
    assert len(get(LINKS, l=LinkRules(same_domain_only=True))["links"]) == 8
    assert len(get(LINKS, l=LinkRules(max_links_per_page=3, extract_images=False))["links"]) == 3
    assert get("<a href=/x>" + "y" * 300 + "</a>")["links"][0]["text"] == "y" * 200 + "..."
    more = "<link rel='stylesheet' href=/s.css><script src=/a.js></script><iframe src=/f></iframe>"
    assert [x["kind"] for x in get(more, l=LinkRules(extract_stylesheets=True, extract_scripts=True, follow_iframes=True), p=ParseRules(strip_javascript=False))["links"]] == ["stylesheet", "script", "iframe"]


def test_content():
    words = "word " * 30
    assert get(f"<main>m {words}</main><div>d {words}</div><article>a {words}</article>")["text_content"].startswith("a word")
    assert get(f"<section>s {words}</section><div>d {words}</div>")["text_content"].startswith("d word")
    assert get("<body>" + "x" * 99 + "</body>")["content"] is None and get("<body>" + "x" * 100 + "</body>")["content"]["char_count"] == 100
    cut = get("<body>" + "ab " * 100 + "</body>", c=ContentRules(max_content_length=10))
    assert cut["text_content"] == "ab ab ab a" and cut["content"]["word_count"] == 4
    assert "a < b" in get(f"<body>a &amp;lt; b {words}</body>")["text_content"]
    page = f"<body><p>{words}</p><p>short</p><h2>two</h2><h1>one</h1><ul><li>a<ul><li>b</li></ul></li></ul><nav>menu</nav><table><tr><th>h</th></tr><tr><td>1</td></tr></table></body>"
    got = get(page, c=ContentRules(extract_tables=True))["content"]
    assert got["headings"] == [{"level": 1, "text": "one"}, {"level": 2, "text": "two"}] and len(got["paragraphs"]) == 1
    assert got["lists"] == [{"type": "unordered", "items": ["ab"]}, {"type": "unordered", "items": ["b"]}]
    assert got["tables"] == [{"headers": [], "rows": [["h"], ["1"]]}]
    assert get(f"<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>{words}", c=ContentRules(extract_tables=True))["content"]["tables"] == [{"headers": ["h"], "rows": [["1"]]}]
    assert "menu" not in get(page)["text_content"]


def test_rows(spark):
    rows = [("http://h.com/", None, "text/html"), ("http://h.com/", "<p>x", "application/json"), ("http://h.com/", "<p>" + "x" * 6_000_000, "text/html"), ("http://h.com/", FULL, "text/html; charset=utf-8"), ("http://h.com/", FULL, "")]
    got = extract.parsed(spark.createDataFrame(rows, "url string, raw_html string, content_type string"))
    assert [r.drop_reason for r in got.collect()] == ["no html", "not html", "too large", None, None]
    assert extract.parse_stats(got).first().successful == 2
    linked = extract.parsed(spark.createDataFrame([("https://weer.example/port", LINKS)], "url string, raw_html string"))
    assert extract.link_table(linked).count() == 7 and extract.image_table(linked).count() == 2
    assert extract.anchor_texts(linked).first().anchor_texts["https://weer.example/tides"] == "Tides"
    stats = extract.link_stats(linked).first()
    assert (stats.links, stats.images) == (7, 2) and extract.content_stats(linked).first().processed == 1


def test_a_worker_takes_few_pages_at_once():
    """Batches of 10,000 pages are cut by the bytes of their html, whole and in order; the extracts of one piece are held at a time."""
    html = ["x" * n for n in (400, 400, 400, 5000, 10)] + [None, ""] + ["y" * 300] * 10
    batches = [pa.RecordBatch.from_pydict({"k": list(range(len(html))), "_html": html}), pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64()), "_html": pa.array([], pa.string())})]
    got = list(extract.pieces(iter(batches), 1000))
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(len(html)))
    assert max(sum(len(h or "") for h in b.column("_html").to_pylist()[1:]) for b in got) < 1000
    assert len(got) > 5
