"""Queries over pages that SQL makes from the table `pages`: each field of a page has a value that SQL can tell.

`MADE` is one expression in the SQL that Spark and the comparing engine share, so both see the same html.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ContentRules, FetchRules, FollowRules, LinkRules, ParseRules, RateRules, RobotsRules, StorageRules, UrlRules
from ..functions import urls
from ..operators import dedup, extract, robots, schedule, sink, validate
from ..sources import fetch, stored
from ..streaming import streams
from . import crawl, stages
from .queries import ORACLE_SQL, QUERIES, SQL_HOST, SQL_NORMAL, SQL_REQUESTS, _requests, flagship, graph_crawl, query, table
from .tables import materialized, shared_folder

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

_ID = "cast(page_id as string)"


def _if(test: str, html: str) -> str:
    return f"case when {test} then {html} else '' end"


#: Head: which of a field's sources a page has goes by its number.
_HEAD = " || ".join([
    f"'<html' || {_if('page_id % 3 = 0', chr(39) + ' lang=' + chr(34) + ' en ' + chr(34) + chr(39))} || '><head>'",
    _if("page_id % 4 < 2", f"'<title> Title ' || {_ID} || ' &amp; more</title>'"),
    _if("page_id % 4 = 2", f"'<title>a<b>c</b></title><meta property=\"og:title\" content=\" Og ' || {_ID} || ' \">'"),
    _if("page_id % 5 = 0", f"'<meta name=\"description\" content=\" Described ' || {_ID} || '\">'"),
    _if("page_id % 5 < 2", f"'<meta property=\"og:description\" content=\"Og described ' || {_ID} || '\">'"),
    _if("page_id % 2 = 0", f"'<meta name=\"keywords\" content=\"k' || {_ID} || ' , two words,, last\">'"),
    _if("page_id % 7 = 0", f"'<meta name=\"author\" content=\"Author ' || {_ID} || '\">'"),
    _if("page_id % 7 < 3", f"'<meta property=\"article:author\" content=\"Writer ' || {_ID} || '\">'"),
    _if("page_id % 6 = 0", f"'<meta property=\"article:published_time\" content=\"2024-01-' || {_ID} || '\">'"),
    _if("page_id % 6 < 4", f"'<meta name=\"date\" content=\"day ' || {_ID} || '\"><meta name=\"publish-date\" content=\"published ' || {_ID} || '\">'"),
    _if("page_id % 3 = 1", f"'<link rel=\"nofollow canonical\" href=\" http://c.example.com/' || {_ID} || ' \">'"),
    _if("page_id % 3 = 1", "'<meta http-equiv=\"content-language\" content=\"fr\">'"),
    _if("page_id % 9 < 4", "'<meta property=\"og:locale\" content=\"de_DE\">'"),
    _if("page_id % 8 < 5", f"'<meta name=\"twitter:card\" content=\"summary\"><meta name=\"twitter:site\" content=\"@s' || {_ID} || '\">'"),
    "'</head>'",
])

#: Body: noise of all kinds, then text, headings, paragraphs, lists and a table.
_BODY = " || ".join([
    "'<body><nav>menu<p>a paragraph of the menu that is long</p></nav><header><h2>brand</h2></header><script>var x = \"<p>not text</p>\";</script><style>p {}</style><!-- a comment <p>hidden</p> -->'",
    f"'<h1>Head ' || {_ID} || '</h1><h3>Third <i>level</i></h3>'",
    _if("page_id % 2 = 0", "'<h2>Second</h2>'"),
    f"'<p>A first paragraph with the number ' || {_ID} || ' &lt; all others.</p><p>short</p>'",
    f"repeat('<p>One more paragraph of some length.</p>', cast(page_id % 4 as int))",
    "'<ul><li>one</li><li>two</li><li> </li></ul><ol><li>first</li></ol><ul></ul>'",
    _if("page_id % 3 = 0", f"'<table><thead><tr><th>key</th><th>value</th></tr></thead><tbody><tr><td>id</td><td>' || {_ID} || '</td></tr><tr></tr></tbody></table>'"),
    "'<button>press</button><aside><ul><li>aside</li></ul></aside><footer><p>the footer has a paragraph as well</p></footer>'",
])

#: Links of all kinds, some twice, some to other hosts, some that are images by their ending.
_LINKS = " || ".join([
    f"'<a href=\"/a' || {_ID} || '\">To <b>a</b></a><a href=\"/a' || {_ID} || '#part\">again</a><a href=\"http://other.example.org/b' || {_ID} || '\"></a>'",
    "'<a href=\"mailto:x@y.z\">mail</a><a href=\"javascript:go()\">go</a><a href=\"/photo.JPG\">photo</a>'",
    _if("page_id % 2 = 0", f"'<img src=\"/i' || {_ID} || '.png\" alt=\" An image \"><img src=\"/plain\">'"),
    "'<link rel=\"alternate stylesheet\" href=\"/s.css\"><link rel=\"next\" href=\"/next\"><script src=\"/x.js\"></script><iframe src=\"/frame?q=1\"></iframe>'",
    "'</body></html>'",
])

MADE = f"select page_id, 'http://h' || cast(page_id % 10 as string) || '.example.com/p' || {_ID} as url, {_HEAD} || {_BODY} || {_LINKS} as html from pages"


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = "'http://h' || cast(page_id % 10 as string) || '.example.com/p' || " + _ID
    return pages.selectExpr("page_id", f"{host} as url", f"{_HEAD} || {_BODY} || {_LINKS} as raw_html")


ALL_CONTENT = ContentRules(extract_tables=True)
ALL_LINKS = LinkRules(extract_stylesheets=True, extract_scripts=True, follow_iframes=True)


@query(f"""
select page_id,
    case page_id % 4 when 0 then 'Title ' || page_id || ' & more' when 1 then 'Title ' || page_id || ' & more' when 2 then 'Og ' || page_id else 'Head ' || page_id end as title,
    case page_id % 5 when 0 then 'Described ' || page_id when 1 then 'Og described ' || page_id end as description,
    case when page_id % 2 = 0 then 'k' || page_id || '|two words|last' end as keywords,
    case page_id % 7 when 0 then 'Author ' || page_id when 1 then 'Writer ' || page_id when 2 then 'Writer ' || page_id end as author,
    case when page_id % 6 = 0 then '2024-01-' || page_id when page_id % 6 < 4 then 'published ' || page_id end as published_date,
    case when page_id % 3 = 1 then 'http://c.example.com/' || page_id end as canonical_url,
    case when page_id % 3 = 0 then 'en' when page_id % 3 = 1 then 'fr' when page_id % 9 < 4 then 'de_DE' end as language
from pages
""")
def p8_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = extract.parsed(_made(spark, sf_dir)).select("page_id", "page_metadata.*")
    return m.select("page_id", "title", "description", F.array_join("keywords", "|").alias("keywords"), "author", "published_date", "canonical_url", "language")


@query("""
select page_id, field, value from (
    select page_id, 'og:title' as field, case when page_id % 4 = 2 then 'Og ' || page_id end as value from pages
    union all select page_id, 'og:description', case when page_id % 5 < 2 then 'Og described ' || page_id end from pages
    union all select page_id, 'og:locale', case when page_id % 9 < 4 then 'de_DE' end from pages
    union all select page_id, 'twitter:card', case when page_id % 8 < 5 then 'summary' end from pages
    union all select page_id, 'twitter:site', case when page_id % 8 < 5 then '@s' || page_id end from pages)
where value is not null
""")
def p9_social_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = extract.parsed(_made(spark, sf_dir)).select("page_id", "page_metadata.*")
    of = lambda prefix, column: m.select("page_id", F.explode(column).alias("k", "value")).select("page_id", F.concat(F.lit(prefix), "k").alias("field"), "value")
    return of("og:", "open_graph").union(of("twitter:", "twitter_card"))


@query("""
select page_id, '1 Head ' || page_id || case when page_id % 2 = 0 then '|2 Second' else '' end || '|3 Thirdlevel' as headings,
    (1 + page_id % 4)::int as n_paragraphs, 'A first paragraph with the number ' || page_id || ' < all others.' as first_paragraph,
    'unordered:one,two|ordered:first' as lists, case when page_id % 3 = 0 then 'key,value;id,' || page_id else '' end as tables
from pages
""")
def p10_page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extract.parsed(_made(spark, sf_dir), content=ALL_CONTENT).select("page_id", "content.*")
    return c.select(
        "page_id", F.array_join(F.transform("headings", lambda h: F.concat_ws(" ", h.level.cast("string"), h.text)), "|").alias("headings"),
        F.size("paragraphs").alias("n_paragraphs"), F.element_at("paragraphs", 1).alias("first_paragraph"),
        F.array_join(F.transform("lists", lambda x: F.concat(x.type, F.lit(":"), F.array_join(x["items"], ","))), "|").alias("lists"),
        F.array_join(F.transform("tables", lambda t: F.concat(F.array_join(t.headers, ","), F.lit(";"), F.array_join(F.transform(t.rows, lambda r: F.array_join(r, ",")), ";"))), "|").alias("tables"),
    )


SQL_TEXT = """
select page_id, 'Head ' || page_id || ' Third level' || case when page_id % 2 = 0 then ' Second' else '' end || ' A first paragraph with the number ' || page_id || ' < all others. short'
    || repeat(' One more paragraph of some length.', (page_id % 4)::int) || ' one two first' || case when page_id % 3 = 0 then ' key value id ' || page_id else '' end || ' To a again mail go photo' as t from pages
"""


@query(f"select page_id, t as text_content, length(t)::int as char_count, len(string_split(t, ' '))::int as word_count from ({SQL_TEXT})")
def p11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body without menus, headers, footers, asides, buttons, frames, scripts, styles and comments."""
    return extract.parsed(_made(spark, sf_dir)).select("page_id", "text_content", "content.char_count", "content.word_count")


@query(f"""
select count(*)::bigint as total, count(*) filter (page_id % 6 not in (0, 1, 2))::bigint as successful, count(*) filter (page_id % 6 in (0, 1, 2))::bigint as failed,
    count(*) filter (page_id % 6 = 1)::bigint as skipped_non_html, (100.0 * count(*) filter (page_id % 6 not in (0, 1, 2)) / count(*))::double as success_rate from pages
""")
def p12_parse_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without html, of another type, and beyond the size limit are dropped and counted; types with parameters or none are read."""
    k = F.col("page_id") % 6
    small = _made(spark, sf_dir).withColumn("raw_html", F.when(k == 0, "").when(k == 2, F.repeat(F.lit("x"), 1024 * 1024 + 1)).otherwise(F.col("raw_html")))
    typed = small.withColumn("content_type", F.when(k == 1, "application/pdf").when(k == 3, "TEXT/HTML; charset=utf-8").when(k == 4, "").otherwise(F.lit(None)))
    return extract.parse_stats(extract.parsed(typed, ParseRules(max_html_size_mb=1)))


SQL_MADE_LINKS = f"""
with m as (select page_id, 'http://h' || page_id % 10 || '.example.com' as h from pages)
select page_id, 'anchor' as kind, h || '/a' || page_id as url, 'Toa' as text from m
union all select page_id, 'anchor', 'http://other.example.org/b' || page_id, '' from m
union all select page_id, 'anchor', h || '/photo.JPG', 'photo' from m
union all select page_id, 'image', h || '/i' || page_id || '.png', 'An image' from m where page_id % 2 = 0
union all select page_id, 'image', h || '/plain', '' from m where page_id % 2 = 0
union all select page_id, 'stylesheet', h || '/s.css', null from m
union all select page_id, 'script', h || '/x.js', null from m
union all select page_id, 'iframe', h || '/frame?q=1', null from m
"""


def _linked(spark: SparkSession, sf_dir: str, rules: LinkRules = ALL_LINKS) -> DataFrame:
    return extract.parsed(_made(spark, sf_dir), ParseRules(strip_javascript=False), rules)


@query(SQL_MADE_LINKS)
def l5_links_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("page_id", F.explode("links").alias("l")).select("page_id", "l.kind", "l.url", "l.text")


@query(f"select page_id, kind, url from ({SQL_MADE_LINKS}) where kind in ('anchor', 'image') and url not like 'http://other%'")
def l6_links_of_the_same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.parsed(_made(spark, sf_dir), link=LinkRules(same_domain_only=True))
    return found.select("page_id", F.explode("links").alias("l")).select("page_id", "l.kind", "l.url")


@query(f"select page_id, count(*) filter (lower(url) like '%.png' or lower(url) like '%.jpg')::bigint as images, count(*) filter (not (lower(url) like '%.png' or lower(url) like '%.jpg'))::bigint as links from ({SQL_MADE_LINKS}) group by page_id")
def l7_links_and_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address belongs to the images table by its ending, whatever element named it."""
    found = _linked(spark, sf_dir).select("page_id", "url", "links")
    links = extract.link_table(found).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("links"))
    images = extract.image_table(found).groupBy(F.col("page_url").alias("url")).agg(F.count("*").alias("images"))
    return found.select("page_id", "url").join(links, "url", "left").join(images, "url", "left").select("page_id", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("links", F.lit(0)).alias("links"))


@query(f"select page_id, url, text from ({SQL_MADE_LINKS}) where text <> ''")
def l8_anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.anchor_texts(_linked(spark, sf_dir)).select("page_id", F.explode("anchor_texts").alias("url", "text"))


@query(f"""
select count(distinct page_id)::bigint as pages, count(*) filter (not image)::bigint as links, count(*) filter (image)::bigint as images, max(n)::int as most_links, (count(*) filter (not image) / count(distinct page_id))::double as mean_links
from (select *, lower(url) like '%.png' or lower(url) like '%.jpg' as image, count(*) filter (not (lower(url) like '%.png' or lower(url) like '%.jpg')) over (partition by page_id) as n from ({SQL_MADE_LINKS}) where kind in ('anchor', 'image'))
""")
def l9_link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_stats(extract.parsed(_made(spark, sf_dir)))


@query(f"""
select page_id, case when page_id % 7 = 0 then 'format' when page_id % 7 = 1 then 'scheme' when page_id % 10 = 3 then 'domain' when page_id % 4 > 2 then 'depth' when page_id % 7 = 2 then 'extension' end as drop_reason from pages
""")
def u7_checks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, scheme, domain, depth, extension: the first that fails names the reason."""
    k = F.col("page_id") % 7
    made = _made(spark, sf_dir).select("page_id", F.when(k == 0, F.concat(F.lit("no url "), F.col("url"))).when(k == 1, F.regexp_replace("url", "^http:", "https:")).when(k == 2, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url")).alias("url"), (F.col("page_id") % 4).cast("int").alias("depth"))
    rules = UrlRules(allowed_schemes=["http"], blocked_domains=["h3.example.com"], max_depth=2, blocked_extensions=[".pdf"])
    return validate.validated(made, rules).select("page_id", "drop_reason")


ORACLE_SQL["u5d_bloom_dedup"] = ORACLE_SQL["u5b_unseen_urls"]  # a filter for a million keys that holds a few hundred errs on none of them


@query(f"""
with k as (select page_id, lower({SQL_NORMAL}) as key from pages), seen as (select distinct key from k where page_id % 2 = 0)
select page_id, key in (select key from seen) as seen, (select count(*) from seen)::bigint as stored from k
""")
def u8_seen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of seen addresses: added twice, looked up for every page, counted, and cleared in the end."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("url"))
    store = dedup.SeenUrls(spark, f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}")
    for _ in range(2):
        store.add(pages.where("page_id % 2 = 0"))
    out = materialized(store.contains(pages).select("page_id", "seen", F.lit(store.count()).cast("long").alias("stored")), "looked_up")
    store.clear()
    return out if store.count() == 0 else out.limit(0)


@query(f"select distinct lower({SQL_NORMAL}) as key from pages")
def t1_stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as a stream, taken to its end: each key once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "pages").select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url")).write.json(f"{folder}/in")
    stream = streams.first_sightings(streams.url_stream(spark, f"{folder}/in"), UrlRules(max_depth=9)).select("key")
    streams.to_folder(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("key string").parquet(f"{folder}/out")


@query(f"""
with r as (select *, row_number() over (order by a, id) as i from ({SQL_REQUESTS})),
k as (select *, i % 2 as c, (i - 1) // 2 as k from r),
g as (select host, id, a as came, d, (k * 1000000 + max(a - k * 1000000) over (partition by c order by i))::bigint as a from k),
n as (select *, row_number() over w as j from g window w as (partition by host order by a, id)),
s as (select *, sum(case when j = 1 then 0 else d end) over w as s from n window w as (partition by host order by a, id))
select host, id, (s + max(a - s) over (partition by host order by a, id) - came)::bigint as wait_us from s
""")
def r9_all_hosts_then_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit over all hosts, then each host's own delay."""
    return schedule.scheduled(_requests(spark, sf_dir), RateRules(strategy="fixed", global_rate_limit=2)).select("host", "id", "wait_us")


SQL_AGED = f"select page_id, {SQL_HOST} as h, length({SQL_HOST}) % 4 as k from pages"


@query(f"select page_id, case when k = 0 then false else true end as allowed, k in (1, 2, 3) as fetch_error, k > 0 as asked_again from ({SQL_AGED})")
def r10_robots_time_to_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules refuse; those of a day ago and older count no more, nor does what was never read, and these hosts are asked again."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    now = F.lit("2024-05-02 12:00:00").cast("timestamp")
    hosts = pages.select(urls.host(F.col("url")).alias("domain")).distinct().withColumn("k", F.length("domain") % 4)
    at = F.when(F.col("k") == 0, F.lit("2024-05-02 00:00:00")).otherwise(F.lit("2024-05-01 11:59:00")).cast("timestamp")
    answers = hosts.where("k < 3").select("domain", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /\n").alias("body"), at.alias("fetched_at"))
    stale = robots.stale_hosts(pages, answers, RobotsRules(), now).select(F.col("domain").alias("_h"), F.lit(True).alias("_stale"))
    judged = robots.with_robots(pages, answers, RobotsRules(), now).withColumn("_h", urls.host(F.col("url")))
    return judged.join(stale, "_h", "left").select("page_id", "allowed", "fetch_error", F.coalesce("_stale", F.lit(False)).alias("asked_again"))


@query(f"""
select page_id, case page_id % 5 when 0 then 'HTTP 404' when 1 then 'Content too large' end as fetch_error, case page_id % 5 when 0 then null when 1 then null when 2 then 'bad ' || chr(65533) || ' byte' when 3 then '' else 'page ' || page_id end as raw_html,
    case when page_id % 5 = 4 then url || '?moved' else url end as final_url from ({MADE})
""")
def h2_decode_and_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no text are replaced, empty bodies kept, large ones refused, redirects remembered."""
    k = F.col("page_id") % 5
    pages = _made(spark, sf_dir)
    body = F.when(k == 1, F.encode(F.repeat(F.lit("x"), 1024 * 1024 + 1), "UTF-8")).when(k == 2, F.unhex(F.lit("62616420FF2062797465"))).when(k == 4, F.encode(F.concat(F.lit("page "), F.col("page_id").cast("string")), "UTF-8"))
    captures = pages.select("url", F.when(k == 0, 404).otherwise(200).alias("status_code"), F.when(k == 4, F.concat("url", F.lit("?moved"))).alias("final_url"), F.lit("text/html").alias("content_type"), body.alias("body"))
    return fetch.from_captures(pages.select("page_id", "url"), captures, FetchRules(max_content_size_mb=1)).select("page_id", "fetch_error", "raw_html", "final_url")


@query("""
select count(*)::bigint as fetched, count(*) filter (page_id % 5 > 0)::bigint as successful, count(*) filter (page_id % 5 = 0)::bigint as failed, count(*) filter (page_id % 10 = 0)::bigint as timeouts,
    sum(case when page_id % 5 > 0 then octet_length(encode(html)) end)::bigint as bytes, avg(page_id % 4 / 2.0)::double as mean_response_time from pages
""")
def h5_fetch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    error = F.when(k % 10 == 0, "ReadTimeout: no answer").when(k % 5 == 0, "HTTP 500")
    answers = table(spark, sf_dir, "pages").select(error.alias("fetch_error"), F.when(k % 5 > 0, F.col("html")).alias("raw_html"), (k % 4 / 2).alias("response_time"))
    return fetch.fetch_stats(answers)


def _stored_folder(spark: SparkSession, sf_dir: str, rules: StorageRules) -> str:
    """A store of the made pages, written twice: the second time with another depth."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    found = extract.parsed(_made(spark, sf_dir)).withColumns({"status_code": F.lit(200), "final_url": F.col("url"), "content_type": F.lit("text/html")})
    for depth in (1, 2):
        sink.write(found.withColumn("depth", F.lit(depth)), rules, folder, F.lit(f"2024-01-0{depth} 00:00:00").cast("timestamp"))
    return folder


@query(f"""
select url, case page_id % 4 when 0 then 'Title ' || page_id || ' & more' when 1 then 'Title ' || page_id || ' & more' when 2 then 'Og ' || page_id else 'Head ' || page_id end as title, 2 as depth, length(html)::int as html_length,
    case when page_id % 3 = 0 then 'en' when page_id % 3 = 1 then 'fr' when page_id % 9 < 4 then 'de_DE' end as language, 'Toa' as anchor
from ({MADE})
""")
def s5_stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored twice are there once, the later row, with html as gzip bytes and metadata as JSON."""
    kept = sink.uncompressed(spark.read.parquet(_stored_folder(spark, sf_dir, StorageRules()) + "/pages"))
    meta = F.from_json("metadata", "page_metadata struct<language: string>, anchor_texts map<string, string>")
    kept = kept.withColumn("m", meta).withColumn("texts", F.map_values("m.anchor_texts"))
    return kept.select("url", "title", "depth", F.length("raw_html").alias("html_length"), "m.page_metadata.language", F.element_at(F.filter("texts", lambda x: x.startswith("To")), 1).alias("anchor"))


@query(f"""
with l as (select m.url as source_url, s.url, s.text from ({SQL_MADE_LINKS}) s join ({MADE}) m using (page_id) where kind in ('anchor', 'image')), twice as (select l.* from l, (select unnest([1, 2])))
select 'links' as stored, source_url as page, url, nullif(text, '') as text from twice where not (lower(url) like '%.png' or lower(url) like '%.jpg')
union all select 'images', source_url, url, null from twice where lower(url) like '%.png' or lower(url) like '%.jpg'
""")
def s6_stored_links_and_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images are appended by every run."""
    folder = _stored_folder(spark, sf_dir, StorageRules(store_html=False))
    links = spark.read.parquet(f"{folder}/links").select(F.lit("links").alias("stored"), F.col("source_url").alias("page"), F.col("target_url").alias("url"), F.col("anchor_text").alias("text"))
    images = spark.read.parquet(f"{folder}/images").select(F.lit("images").alias("stored"), F.col("page_url").alias("page"), F.col("image_url").alias("url"), F.col("alt_text").alias("text"))
    return links.union(images)


@query(f"select url, null::varchar as raw_html, null::varchar as text_content, null::varchar as metadata, 1 as depth from ({MADE})")
def s7_column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules leave out is null; with `ignore` the first row of an address stays."""
    folder = _stored_folder(spark, sf_dir, StorageRules(store_html=False, store_text=False, store_metadata=False, on_conflict="ignore"))
    return spark.read.parquet(f"{folder}/pages").select("url", "raw_html", "text_content", "metadata", "depth")


@query(f"select split_part(url, '/', 3) as domain, count(*)::bigint as pages, min(split_part(url, '/', 3) || '/' || split_part(url, '/', 4)) as first_path from ({MADE}) group by all")
def s8_files_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    sink.write(_made(spark, sf_dir), StorageRules(storage_type="filesystem"), folder)
    return spark.read.parquet(folder).groupBy("domain").agg(F.count("*").alias("pages"), F.min("path").alias("first_path"))


@query(f"select source_url, target_url, anchor_text from (select m.url as source_url, s.url as target_url, nullif(s.text, '') as anchor_text from ({SQL_MADE_LINKS}) s join ({MADE}) m using (page_id) where kind = 'anchor' and s.url not like '%.JPG') order by source_url, target_url, anchor_text limit 10")
def s9_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.link_rows(extract.link_table(extract.parsed(_made(spark, sf_dir), link=LinkRules(extract_images=False))))


@query(f"select url, case page_id % 4 when 0 then 'Title ' || page_id || ' & more' when 1 then 'Title ' || page_id || ' & more' when 2 then 'Og ' || page_id else 'Head ' || page_id end as title from ({MADE})")
def s10_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.titles(extract.parsed(_made(spark, sf_dir)))


@query("""
select count(*) filter (page_id % 8 > 0)::bigint as stored, count(*) filter (page_id % 8 = 0)::bigint as failed, sum(3 + case when page_id % 2 = 0 then 2 else 0 end)::bigint as links_stored, (100.0 * count(*) filter (page_id % 8 > 0) / count(*))::double as success_rate from pages
""")
def s11_storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.storage_stats(extract.parsed(_made(spark, sf_dir)).select((F.col("page_id") % 8 > 0).alias("ok"), "links"))


@query("""
select count(*)::bigint as processed, count(*) filter (page_id % 7 > 1)::bigint as rows_out, count(*) filter (page_id % 7 = 1)::bigint as dropped, count(*) filter (page_id % 7 = 0)::bigint as errors from pages
""")
def f3_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage of a function on records that raises for some of them: these are dropped and counted, the job goes on."""

    def half(record: dict) -> dict | None:
        if record["page_id"] % 7 == 0:
            raise ValueError("a seventh")
        return None if record["page_id"] % 7 == 1 else {"url": record["url"], "half": record["page_id"] / 2}

    pipe = stages.Pipeline().add_stage("half", stages.row_stage(half, "url string, half double"))
    pipe.run_counted(table(spark, sf_dir, "pages").select("page_id", "url"))
    return pipe.stage_stats(spark).select("processed", "rows_out", "dropped", "errors")


@query("""
with s as (select event_type as name, count(*)::bigint as processed, (count(*) filter (event_id % 9 = 0))::bigint as errors, (1 + sum(event_id % 5))::double as seconds from events group by all)
select name, round(processed / seconds, 6)::double as throughput, round(seconds / processed, 6)::double as mean_seconds, seconds / processed = max(seconds / processed) over () as is_slowest, errors / processed > 0.1 as high_errors from s
""")
def f4_throughput_and_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stats = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("processed"), F.count_if(F.col("event_id") % 9 == 0).alias("errors"), (1 + F.sum(F.col("event_id") % 5)).cast("double").alias("runtime_seconds"))
    rates = stages.throughput(stats).select("name", F.round("throughput", 6).alias("throughput"), F.round("mean_seconds", 6).alias("mean_seconds"))
    return rates.join(stages.bottlenecks(stats).drop("mean_seconds"), "name")


@query("select url, true as known_keys, 18::int as keys, url as record_url, (page_id % 3)::int as depth from pages")
def f5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as the JSON of its 18 keys."""
    rows = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).cast("int").alias("depth"))
    packed = stages.to_record(rows)
    keys = F.json_object_keys("record")
    return packed.select("url", (F.array_sort(keys) == F.array_sort(F.array(*(F.lit(k) for k in stages.RECORD_KEYS)))).alias("known_keys"), F.size(keys).alias("keys"), F.get_json_object("record", "$.url").alias("record_url"), F.get_json_object("record", "$.depth").cast("int").alias("depth"))


@query(f"""
with l as (select page_id, s.url, m.url as parent_url from ({SQL_MADE_LINKS}) s join ({MADE}) m using (page_id) where kind in ('anchor', 'image') and not (lower(s.url) like '%.png' or lower(s.url) like '%.jpg'))
select url, parent_url, (page_id % 5 + 1)::int as depth from l where page_id % 5 + 1 <= 3 and url not like 'http://other%'
""")
def j7_frontier_of_the_same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.parsed(_made(spark, sf_dir)).select("url", (F.col("page_id") % 5).cast("int").alias("depth"), F.col("page_id").alias("page_order"), "links")
    return crawl.next_frontier(pages, FollowRules(same_domain_only=True)).select("url", "parent_url", "depth")


@query(f"""
with l as (select page_id, s.url from ({SQL_MADE_LINKS}) s where kind in ('anchor', 'image'))
select count(*)::bigint as found, count(*) filter (page_id % 5 + 1 <= 3 and url not like 'http://other%')::bigint as reinjected, count(*) filter (page_id % 5 + 1 > 3)::bigint as skipped_depth,
    count(*) filter (page_id % 5 + 1 <= 3 and url like 'http://other%')::bigint as skipped_domain, (100.0 * count(*) filter (page_id % 5 + 1 <= 3 and url not like 'http://other%') / count(*))::double as rate from l
""")
def j8_follow_stats_of_the_same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.parsed(_made(spark, sf_dir)).select("url", (F.col("page_id") % 5).cast("int").alias("depth"), "links")
    return crawl.follow_stats(pages, FollowRules(same_domain_only=True))


#: Breadth first over the graph of g1, whose first 40 nodes come in the order of their numbers.
ORACLE_SQL["g3_crawl"] = """
with n as (select count(*) as n from pages), v as (select unnest(range(40)) as i)
select 'http://graph.example.com/p' || i as url, case when i = 0 then 0 when i < 4 then 1 when i < 13 then 2 else 3 end::int as depth,
    case when i > 0 then 'http://graph.example.com/p' || (i - 1) // 3 end as parent_url, i::bigint as page_order, 't' as title
from v, n where n.n >= 40
"""


@query("""
with v as (select unnest(range(40)) as i)
select depth as round, count(*)::bigint as pages_crawled, sum(case when depth < 3 then 3 else 3 end)::bigint as links_found, 0::bigint as errors_count
from (select case when i = 0 then 0 when i < 4 then 1 when i < 13 then 2 else 3 end::int as depth from v) group by depth
""")
def g4_crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of each round of g3's crawl."""
    run = graph_crawl(spark, sf_dir)
    run.run(["http://graph.example.com/p0"])
    rounds = run.stats().withColumn("round", F.when(F.col("pages_crawled") == 1, 0).when(F.col("pages_crawled") == 3, 1).when(F.col("pages_crawled") == 9, 2).otherwise(3))
    return rounds.select("round", "pages_crawled", "links_found", "errors_count")
