from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.config import UrlRules
from gossamer.functions import urls
from gossamer.operators import validate

CASES = [
    ("HTTP://Example.COM", "http://example.com/"),
    ("http://example.com:80/a/", "http://example.com/a"),
    ("http://example.com:8080/a", "http://example.com80/a"),
    ("https://example.com:443/", "https://example.com/"),
    ("https://example.com:4430/x", "https://example.com0/x"),
    ("http://example.com/a//", "http://example.com/a"),
    ("http://example.com//", "http://example.com"),
    ("http://example.com//;p", "http://example.com/;p"),
    ("http://example.com/a/;x", "http://example.com/a;x"),
    ("http://example.com/?b=2&a=1&a=0&c", "http://example.com/?a=1&a=0&b=2&c="),
    ("http://example.com/?q=a%20b~*", "http://example.com/?q=a+b~%2A"),
    ("http://example.com/?q=%zz", "http://example.com/?q=%25zz"),
    ("http://example.com/?q=%ff", "http://example.com/?q=%EF%BF%BD"),
    ("http://example.com/?&", "http://example.com/"),
    ("http://example.com/für?k=é", "http://example.com/für?k=%C3%A9"),
    ("http://example.com/Path#top", "http://example.com/Path"),
    ("http://example.com#top", None),
    ("http://example.museum/", "http://example.museum/"),
    ("http://example.photography/", None),
    ("ftp://example.com/", None),
    (" http://example.com/", None),
    ("http://user@example.com/", None),
    ("http://999.1.1.1/", "http://999.1.1.1/"),
    ("http://localhost:3000/x", "http://localhost:3000/x"),
    ("http://a_b.com/", None),
    ("http://example.com./x", "http://example.com./x"),
    ("http://example.com/a b", None),
    ("http://example.com?x=1", "http://example.com/?x=1"),
    ("http://example.com/" + "a" * 2029, "http://example.com/" + "a" * 2029),
    ("http://example.com/" + "a" * 2030, None),
    ("", None),
    (None, None),
]


def by_library(url, compat_port_bug=True):
    """The normal form by the standard library."""
    p = urlparse(url.strip())
    scheme, authority = p.scheme.lower(), p.netloc.lower()
    port = {"http": ":80", "https": ":443"}.get(scheme, "")
    if port:
        authority = authority.replace(port, "") if compat_port_bug else authority.removesuffix(port)
    path = (p.path.rstrip("/") if len(p.path) > 1 else p.path) or ("/" if not p.path else "")
    query = urlencode(sorted(parse_qs(p.query, keep_blank_values=True).items()), doseq=True) if p.query else ""
    return urlunparse((scheme, authority, path, p.params, query, ""))


def test_format_and_normal_form(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)], "i int, url string")
    got = {r.i: r for r in rows.select("i", urls.is_valid(F.col("url")).alias("ok"), urls.normalized(F.col("url")).alias("n")).collect()}
    for i, (url, want) in enumerate(CASES):
        assert got[i].ok == (want is not None), url
        if want is not None:
            assert got[i].n == want == by_library(url), url


def test_strict_ports(spark):
    for url, want in (("http://h.com:8080/", "http://h.com:8080/"), ("http://h.com:80/", "http://h.com/"), ("https://h.com:4430/", "https://h.com:4430/")):
        assert spark.range(1).select(urls.normalized(F.lit(url), compat_port_bug=False)).first()[0] == want == by_library(url, False)


PIECE = st.text(alphabet="aB1%2~*+=&;/é.-_z", max_size=10)


@settings(max_examples=15, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["http", "HTTPS"]), st.sampled_from(["a.com", "A.co:80", "a.com:443", "b.org:8080"]), PIECE, PIECE, st.booleans()), min_size=60, max_size=90))
def test_native_form_is_the_standard_librarys(spark, parts):
    made = [f"{s}://{h}/{p}" + (f"?{q}" if q else "") + ("#f" if f else "") for s, h, p, q, f in parts]
    got = spark.createDataFrame([(u,) for u in made], "url string").select("url", urls.normalized(F.col("url")).alias("n")).collect()
    for r in got:
        assert r.n == by_library(r.url), r.url


ESCAPE = st.lists(st.sampled_from(["%", "%2", "%25", "%e2", "%82", "%AC", "%C3", "%a9", "%ED", "%a0", "%80", "%F0", "%90", "%9F", "%98", "%E0", "%F4", "%F5", "%BF", "%00", "%FF", "%2B", "%26", "a", "é", "=", "&", "+"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ESCAPE, min_size=200, max_size=300))
def test_escapes_are_the_standard_librarys(spark, queries):
    made = [f"http://a.com/?{q}" for q in queries]
    for r in spark.createDataFrame([(u,) for u in made], "url string").select("url", urls.normalized(F.col("url")).alias("n")).collect():
        assert r.n == by_library(r.url), r.url


def test_drop_reasons_in_order(spark):
    rules = UrlRules(allowed_domains=["good.com", "bad.good.com"], blocked_domains=["bad.good.com"], max_depth=2)
    rows = [("http://good.com/a", 0, None), ("http://x.good.com/a.PDF", 0, "extension"), ("http://good.com/a.pdf", 9, "depth"), ("http://bad.good.com/", 9, "domain"), ("http://notgood.com/", 0, "domain"), ("nope", 9, "format"), ("http://y.bad.good.com/", 0, "domain")]
    got = validate.validated(spark.createDataFrame([r[:2] for r in rows], "url string, depth int"), rules).collect()
    assert [r.drop_reason for r in got] == [r[2] for r in rows]
    assert validate.validated(spark.createDataFrame([("HTTP://A.com", 0)], "url string, depth int"), UrlRules(normalize_urls=False)).first().url == "HTTP://A.com"


@pytest.mark.parametrize("href,base,want", [
    ("/a", "http://h.com/x/y", "http://h.com/a"), ("b?q=1#f", "http://H.com/x/y", "http://h.com/x/b?q=1"), ("//o.com/z", "https://h.com/", "https://o.com/z"),
    ("mailto:a@b", "http://h.com/", None), ("JavaScript:x", "http://h.com/", None), ("", "http://h.com/", None), ("#s", "http://h.com/p", "http://h.com/p"), ("http://[bad", "http://h.com/", None),
])
def test_resolve(href, base, want):
    assert urls.resolve(href, base, ("mailto:", "javascript:")) == want


def test_white_space_is_pythons(spark):
    import random
    import re

    from gossamer.functions import text

    assert set(text.SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    rng = random.Random(1)
    made = ["".join(rng.choice(" \t\n\r\x0b\x1c\x85\xa0\u2003\u3000ab\u00e9") for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", text.clean(F.col("t")).alias("c"), text.word_count(F.col("t")).alias("w"))
    for r in rows.collect():
        assert r.c == re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", r.t)).strip() and r.w == len(r.t.split())
