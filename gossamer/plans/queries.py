"""Registered queries, one or more for each operator, with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RateRules, RobotsRules, UrlRules
from ..functions import text, urls
from ..operators import dedup, extract, robots, schedule, sink, validate
from ..sources import fetch, stored
from ..sources.seeds import seeds
from . import crawl, stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of SQL that several queries share.
SQL_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
SQL_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
SQL_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
SQL_NORMAL = rf"""
    lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {SQL_HOST}
    || case {SQL_PATH} when '' then '/' when '/' then '/' else rtrim({SQL_PATH}, '/') end
    || case {SQL_QUERY} when '' then '' else '?' || array_to_string(list_sort(string_split({SQL_QUERY}, '&')), '&') end
"""
# The fixture's pages as the extractors see them.
SQL_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
SQL_LINKS = rf"""
    select page_id, url as source_url, pos, target_url from (
        select page_id, url, unnest(range(len({SQL_HREFS}))) as pos,
            unnest(list_transform({SQL_HREFS}, lambda h: regexp_extract(url, '^([a-z]+://)', 1) || {SQL_HOST} || trim(h))) as target_url
        from pages)
"""
SQL_MICROS = "epoch_us(ts)"


@query(r"""
select page_id, url, length(url) <= 2048 and regexp_matches(url, '^(?i)https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$') as is_valid
from pages
""".replace("^(?i)", "(?i)^"))
def u1_url_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.is_valid(F.col("url")).alias("is_valid"))


@query(f"select page_id, {SQL_NORMAL} as normal_form from pages")
def u2_url_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normal_form"))


@query(f"""
select page_id, {SQL_HOST} as host from pages
where ({SQL_HOST} = 'example.com' or {SQL_HOST} like '%.example.com') and not ({SQL_HOST} = 'm.example.com' or {SQL_HOST} like '%.m.example.com' or {SQL_HOST} like 'm.%')
""")
def u3_domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("host", urls.host(F.col("url")))
    return pages.where(urls.domain_allowed(F.col("host"), ["example.com"], ["m.example.com"]) & ~F.col("host").startswith("m.")).select("page_id", "host")


@query(f"""
with listed as (select distinct {SQL_HOST} as domain from pages where page_id % 3 = 0)
select page_id, exists (select 1 from listed where domain = {SQL_HOST} or {SQL_HOST} like '%.' || domain) as is_listed from pages
""")
def u3b_long_domain_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where("page_id % 3 = 0").select(urls.host(F.col("url")).alias("domain"))
    hit = validate.listed_domains(pages, listed, "left_semi").select("page_id", F.lit(True).alias("is_listed"))
    return hit.union(validate.listed_domains(pages, listed, "left_anti").select("page_id", F.lit(False).alias("is_listed")))


@query(f"select page_id, lower({SQL_PATH}) like '%.html' or lower({SQL_PATH}) like '%.pdf' as is_blocked from pages")
def u4_extension_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.has_extension(urls.part(F.col("url"), 3), [".pdf", ".html"]).alias("is_blocked"))


@query(f"""
select page_id, lower({SQL_NORMAL}) as key from pages
qualify row_number() over (partition by lower({SQL_NORMAL}) order by page_id) = 1
""")
def u5_first_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("link_pos"), urls.normalized(F.col("url")).alias("url"))
    return dedup.new_urls(pages).select("page_id", F.lower("url").alias("key"))


@query(f"""
with seen as (select distinct lower({SQL_NORMAL}) as key from pages where page_id % 2 = 0)
select page_id from pages where page_id % 2 = 1 and lower({SQL_NORMAL}) not in (select key from seen)
qualify row_number() over (partition by lower({SQL_NORMAL}) order by page_id) = 1
""")
def u5b_unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("link_pos"), urls.normalized(F.col("url")).alias("url"))
    return dedup.new_urls(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0").select("url")).select("page_id")


@query(f"select count(distinct lower(url))::bigint as unique_urls, (count(*) - count(distinct lower(url)))::bigint as duplicate_urls, count(*)::bigint as total_checked, 'set' as method from (select {SQL_NORMAL} as url from pages)")
def u5c_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_stats(table(spark, sf_dir, "pages").select(urls.normalized(F.col("url")).alias("url")))


@query()
def u5d_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As u5b by a Bloom filter, which may drop a new key with the configured probability (see tests)."""
    from ..config import DedupRules

    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("link_pos"), urls.normalized(F.col("url")).alias("url"))
    rules = DedupRules(method="bloom", bloom_error_rate=0.001)
    return dedup.new_urls(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0").select("url"), rules).select("page_id")


@query(f"""
select host, reason as drop_reason, count(*)::bigint as pages from (
    select {SQL_HOST} as host, case when page_id % 5 > 3 then 'depth' when lower({SQL_PATH}) like '%.html' then 'extension' end as reason from pages)
group by all
""")
def u6_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 5).cast("int").alias("depth"))
    checked = validate.validated(pages, UrlRules(blocked_extensions=[".html"]))
    return checked.groupBy(urls.host(F.col("url")).alias("host"), "drop_reason").agg(F.count("*").alias("pages"))


def _parsed(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("raw_html"))
    return extract.parsed(pages, fields=frozenset(fields))


@query(f"""
select page_id, source_url, (row_number() over (partition by page_id order by pos) - 1)::int as pos, target_url
from (select * from ({SQL_LINKS}) qualify row_number() over (partition by page_id, target_url order by pos) = 1)
""")
def l1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parsed(spark, sf_dir, "links").select("page_id", F.col("url").alias("source_url"), F.explode("links").alias("l"))
    return pages.select("page_id", "source_url", "l.pos", F.col("l.url").alias("target_url"))


@query(f"""
select page_id, target_url from (select *, row_number() over (partition by page_id order by pos) as n from (
    select * from ({SQL_LINKS}) qualify row_number() over (partition by page_id, target_url order by pos) = 1)) where n <= 3
""")
def l2_links_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import LinkRules

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("raw_html"))
    found = extract.parsed(pages, link=LinkRules(max_links_per_page=3), fields=frozenset(("links",)))
    return found.select("page_id", F.explode("links.url").alias("target_url"))


@query(f"""
with l as (select distinct page_id, source_url, target_url from ({SQL_LINKS})), both_ends as (
    select source_url as url, 1 as o, 0 as i from l union all select target_url, 0, 1 from l)
select url, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from both_ends group by url
""")
def l3_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.link_table(_parsed(spark, sf_dir, "links").select("url", "links"))
    both = links.select(F.col("source_url").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select(F.col("target_url").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("url").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query(f"select distinct target_url from ({SQL_LINKS}) l where not exists (select 1 from pages p where p.url = l.target_url)")
def l4_dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.link_table(_parsed(spark, sf_dir, "links").select("url", "links")).select("target_url").distinct()
    return links.join(table(spark, sf_dir, "pages").select(F.col("url").alias("target_url")), "target_url", "left_anti")


SQL_TITLE = "trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;', '&'))"


@query(f"select page_id, {SQL_TITLE} as title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as language from pages")
def p1_title_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "title", "page_metadata").select("page_id", "title", "page_metadata.language")


@query(r"""
select doc_id, length(t)::int as char_count, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))::int as word_count
from (select doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', e'\n\n', 'g'), e' \n\t\r') as t from documents)
""")
def p2_cleaned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("char_count"), text.word_count(F.col("t")).alias("word_count"))


@query("select doc_id, case when length(text) >= 400 then length(substr(text, 1, 3000))::int end as kept_chars from documents")
def p3_length_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.accepted(F.col("text"), 400, 3000)).alias("kept_chars"))


SQL_ARTICLE = r"""
select page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(
    regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '\s*<[^>]*>\s*', ' ', 'g'),
    '&amp;', '&'), '&quot;', '"'), '&#x27;', chr(39)), '[ \t]+', ' ', 'g'), '\n{3,}', e'\n\n', 'g'), e' \n\t\r') as t from pages
"""


@query(f"select page_id, case when length(t) >= 100 then t end as text_content from ({SQL_ARTICLE})")
def p4_page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "content").select("page_id", "text_content")


@query(rf"""
select page_id, case when length(t) >= 100 then length(t)::int end as char_count,
    case when length(t) >= 100 then len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))::int end as word_count from ({SQL_ARTICLE})
""")
def p4b_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "content").select("page_id", "content.char_count", "content.word_count")


@query(rf"""
select count(*)::bigint as processed, count(*) filter (length(t) >= 100)::bigint as successful, count(*) filter (length(t) < 100)::bigint as too_short,
    sum(n)::bigint as words, sum(case when length(t) >= 100 then length(t) end)::bigint as chars, (sum(n) / count(n))::double as mean_words
from (select t, case when length(t) >= 100 then len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) end as n from ({SQL_ARTICLE}))
""")
def p7_content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.content_stats(_parsed(spark, sf_dir, "content"))


@query("select count(*)::bigint as total, count(*)::bigint as successful, 0::bigint as failed, 0::bigint as skipped_non_html, 100.0::double as success_rate from pages")
def p5_parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parse_stats(_parsed(spark, sf_dir, "title"))


@query(f"""
select count(distinct page_id)::bigint as pages, sum(n)::bigint as links, 0::bigint as images, max(n)::int as most_links, (sum(n) / count(distinct page_id))::double as mean_links
from (select p.page_id, coalesce(c.n, 0) as n from pages p left join (select page_id, count(distinct target_url) as n from ({SQL_LINKS}) group by page_id) c using (page_id))
""")
def p6_link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_stats(_parsed(spark, sf_dir, "links"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("host"), F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("arrival_us"), (F.col("event_id") % 3 * 1800).cast("double").alias("crawl_delay"))


SQL_REQUESTS = f"select user_id as host, event_id as id, {SQL_MICROS} as a, (event_id % 3 * 1800 * 1000000)::bigint as d from events"


@query(f"""
with r as (select *, row_number() over w as i from ({SQL_REQUESTS}) window w as (partition by host order by a, id)),
s as (select *, sum(case when i = 1 then 0 else d end) over w as s from r window w as (partition by host order by a, id))
select host, id, (s + max(a - s) over (partition by host order by a, id))::bigint as release_us from s
""")
def r1_fixed_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.scheduled(_requests(spark, sf_dir), RateRules(strategy="fixed")).select("host", "id", "release_us")


@query(f"""
with r as (select *, row_number() over w as i, first_value(d) over w as f from ({SQL_REQUESTS}) window w as (partition by host order by a, id)),
m as (select *, max(a - f * (i - 1)) over (partition by host order by a, id rows between unbounded preceding and 1 preceding) as past from r)
select host, id, (case when past is null or f = 0 then a else greatest(a, f * (i - 1) + past - 4 * f) end)::bigint as release_us from m
""")
def r2_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.scheduled(_requests(spark, sf_dir), RateRules(strategy="token_bucket")).select("host", "id", "release_us")


SQL_SLIDING = """
with r as (select *, row_number() over (partition by {key} order by a, id) as i from ({rows})),
k as (select *, i % {n} as c, (i - 1) // {n} as k from r)
select host, id, (k * {w} + max(a - k * {w}) over (partition by {key}, c order by i))::bigint as release_us from k
"""


@query(SQL_SLIDING.format(key="host", rows=SQL_REQUESTS, n=5, w=5 * 3600 * 1_000_000))
def r3_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RateRules(strategy="sliding_window", default_delay_seconds=3600.0)
    return schedule.scheduled(_requests(spark, sf_dir), rules).select("host", "id", "release_us")


@query(SQL_SLIDING.format(key="host is not null", rows=f"select user_id as host, event_id as id, {SQL_MICROS} // 1000 as a, 0 as d from events", n=2, w=1_000_000))
def r4_global_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir).withColumn("arrival_us", F.floor(F.col("arrival_us") / 1000))
    return schedule.global_limit(rows, 2).select("host", "id", "release_us")


@query(f"""
with r as (select *, row_number() over w as i from ({SQL_REQUESTS}) window w as (partition by host order by a, id)),
s as (select *, sum(case when i = 1 then 0 else d end) over w as s from r window w as (partition by host order by a, id)),
x as (select host, s + max(a - s) over (partition by host order by a, id) - a as wait from s)
select count(*)::bigint as requests, count(*) filter (wait > 10000)::bigint as delayed, sum(wait)::bigint as total_wait_us, avg(wait)::double as mean_wait_us, count(distinct host)::bigint as hosts from x
""")
def r5_rate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.rate_stats(schedule.scheduled(_requests(spark, sf_dir)))


# One host in three has rules, one answers 403, the rest give no answer.
SQL_RULES = f"select page_id, url, {SQL_HOST} as h, length({SQL_HOST}) % 3 as k, {SQL_PATH} as p from pages"


@query(f"""
select page_id, case k when 0 then not starts_with(p, '/de') when 1 then false else true end as allowed, case k when 0 then 2.0::double end as crawl_delay
from ({SQL_RULES})
""")
def r6_robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return robots.with_robots(pages, _answers(pages), RobotsRules()).select("page_id", "allowed", "crawl_delay")


def _answers(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urls.host(F.col("url")).alias("domain")).distinct().withColumn("k", F.length("domain") % 3)
    body = F.lit("User-agent: *\nDisallow: /de\nCrawl-delay: 2\n")
    return hosts.where("k < 2").select("domain", F.when(F.col("k") == 0, 200).otherwise(403).alias("status"), body.alias("body"), F.current_timestamp().alias("fetched_at"))


SQL_GRAPH = """
with recursive n as (select count(*) as n from pages), e as (
    select (row_number() over (order by page_id) - 1) as i from pages
), edges as (
    select i as src, (3 * i + k) % n.n as dst from e, n, (select unnest([1, 2, 3]) as k)
), r as (
    select 0::bigint as node, 0 as depth
    union
    select edges.dst, r.depth + 1 from r join edges on edges.src = r.node where r.depth < {depth}
)
select node, min(depth)::int as depth from r group by node
"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    nodes = crawl.numbered(pages, ["page_id"], "i")
    return nodes.select(F.col("i").alias("src"), F.explode(F.array(*(((3 * F.col("i") + k) % n).cast("long") for k in (1, 2, 3)))).alias("dst"))


@query(SQL_GRAPH.format(depth=12))
def g1_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.reachable(_graph(spark, sf_dir), spark.createDataFrame([(0,)], "node long"), 12)


@query(f"select node, depth from ({SQL_GRAPH.format(depth=3)}) order by depth, node limit 30")
def g2_depth_and_page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.reachable(_graph(spark, sf_dir), spark.createDataFrame([(0,)], "node long"), 3, 30)


def graph_crawl(spark: SparkSession, sf_dir: str) -> crawl.Crawl:
    """A crawl over captured pages that link like the graph of g1."""
    from ..config import CrawlConfig

    edges = _graph(spark, sf_dir).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dst"))
    link = lambda x: F.concat(F.lit('<a href="/p'), x.cast("string"), F.lit('">x</a>'))
    body = F.concat(F.lit("<html><title>t</title><body>"), F.array_join(F.transform("dst", link), " "), F.lit("</body></html>"))
    captures = edges.select(F.concat(F.lit("http://graph.example.com/p"), F.col("src").cast("string")).alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), F.lit("text/html").alias("content_type"), body.alias("body"))
    return crawl.Crawl(spark, CrawlConfig(), captures=captures)


@query()
def g3_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_crawl(spark, sf_dir).run(["http://graph.example.com/p0"]).select("url", "depth", "parent_url", "page_order", "title")


@query("""
select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
""")
def s1_upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return sink.upserted(e.limit(0), e, ["user_id"], ["ts", "event_id"], "replace").select("user_id", "event_id", "event_type")


@query("""
select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1
""")
def s1b_upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return sink.upserted(e.limit(0), e, ["user_id"], ["ts", "event_id"], "ignore").select("user_id", "event_id", "event_type")


SQL_STORED = "select url, length(html)::int as word_count, case when page_id % 10 = 0 then 404 else 200 end as status_code from pages"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.length("html").alias("word_count"), F.when(F.col("page_id") % 10 == 0, 404).otherwise(200).alias("status_code"))


@query(f"select url, word_count from ({SQL_STORED}) where status_code = 200 order by url limit 5")
def s2_ok_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.ok_pages(_stored(spark, sf_dir))


@query(f"select url, word_count, status_code from ({SQL_STORED}) order by url limit 10")
def s2b_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.page_rows(_stored(spark, sf_dir))


@query(f"select (select count(*) from pages)::bigint as pages, (select count(*) from (select distinct page_id, target_url from ({SQL_LINKS})))::bigint as links")
def s2c_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.counts(table(spark, sf_dir, "pages"), extract.link_table(_parsed(spark, sf_dir, "links").select("url", "links")))


@query("select event_id, (props->>'$.k')::bigint as k, event_type from events")
def s3_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", F.from_json("props", "k long").alias("props"))).alias("metadata"))
    read = packed.select("event_id", F.from_json("metadata", "event_type string, props struct<k: long>").alias("m"))
    return read.select("event_id", "m.props.k", "m.event_type")


@query(f"""
select page_id, {SQL_HOST} || '/' || substr(case when trim({SQL_PATH}, '/') = '' then 'index' else replace(trim({SQL_PATH}, '/'), '/', '_') end, 1, 200) as path from pages
""")
def s4_file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sink.file_path(F.col("url")).alias("path"))


@query("""
select case when page_id % 7 = 0 then 'not captured' when page_id % 7 = 1 then 'HTTP 503' end as fetch_error, count(*)::bigint as pages, sum(case when page_id % 7 > 1 then octet_length(encode(html)) end)::bigint as bytes
from pages group by all
""")
def h1_fetch_from_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("u", F.concat("url", F.lit("#"), F.col("page_id")))
    captures = pages.where("page_id % 7 > 0").select(F.col("u").alias("url"), F.when(F.col("page_id") % 7 == 1, 503).otherwise(200).alias("status_code"), F.col("u").alias("final_url"), F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    got = fetch.from_captures(pages.select(F.col("u").alias("url")), captures)
    return got.groupBy("fetch_error").agg(F.count("*").alias("pages"), F.sum(F.octet_length("raw_html")).alias("bytes"))


@query("""
select case when page_id % 7 = 1 then 503 else 404 end as status_code, count(*)::bigint as count from pages where page_id % 7 in (1, 2) group by all
""")
def h4_errors_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("u", F.concat("url", F.lit("#"), F.col("page_id")))
    status = F.when(F.col("page_id") % 7 == 1, 503).when(F.col("page_id") % 7 == 2, 404).otherwise(200)
    captures = pages.where("page_id % 7 > 0").select(F.col("u").alias("url"), status.alias("status_code"), F.col("u").alias("final_url"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    return fetch.errors_by_status(fetch.from_captures(pages.select(F.col("u").alias("url")), captures))


@query(f"""
with l as (select distinct page_id, target_url from ({SQL_LINKS}))
select count(*)::bigint as found, count(*) filter (page_id % 5 + 1 <= 3)::bigint as reinjected, count(*) filter (page_id % 5 + 1 > 3)::bigint as skipped_depth, 0::bigint as skipped_domain from l
""")
def j6_follow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parsed(spark, sf_dir, "links").select("url", (F.col("page_id") % 5).cast("int").alias("depth"), "links")
    return crawl.follow_stats(pages).drop("rate")


@query(f"""
select count(*) filter (k <> 1 and not (k = 0 and starts_with(p, '/de')))::bigint as allowed, count(*) filter (k = 1 or (k = 0 and starts_with(p, '/de')))::bigint as disallowed,
    count(*) filter (k = 2)::bigint as fetch_errors, count(distinct h)::bigint as domains from ({SQL_RULES})
""")
def r7_robots_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return robots.robots_stats(robots.with_robots(pages, _answers(pages)))


@query(f"""
select host, count(*)::bigint as requests, count(*) filter (wait > 10000)::bigint as delayed, sum(wait)::bigint as total_wait_us, max(a + wait)::bigint as last_release_us, (count(*) filter (a + wait > last - 1000000))::bigint as current_rate from (select *, max(a + wait) over (partition by host) as last from (
    with r as (select *, row_number() over w as i from ({SQL_REQUESTS}) window w as (partition by host order by a, id)),
    s as (select *, sum(case when i = 1 then 0 else d end) over w as s from r window w as (partition by host order by a, id))
    select host, a, s + max(a - s) over (partition by host order by a, id) - a as wait from s))
group by host
""")
def r8_host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.host_stats(schedule.scheduled(_requests(spark, sf_dir)))


@query("""
select * from (values ('upper_case', 4::bigint, 0::bigint, 0::bigint, 1.0::double)) as t(name, processed, errors, dropped, success_rate)
""")
def f1_stage_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = stages.Pipeline().add_stage("upper_case")
    pipe.run_counted(seeds(spark, ["a", "b", "c", "d"]))
    all_ = stages.overall(pipe.stage_stats(spark))
    return all_.select(F.lit("upper_case").alias("name"), "processed", "errors", "dropped", "success_rate")


@query("""
select event_id, ['[fetch] timeout'] as errors, (event_id % 5 + 0.5)::double as total_time, true as has_errors from events
""")
def f2_record_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", stages.add_error(F.lit(None).cast("array<string>"), "timeout", "fetch").alias("errors"))
    timings = stages.add_timing(stages.add_timing(F.lit(None).cast("map<string,double>"), "a", F.col("event_id") % 5), "b", F.lit(0.5))
    return e.select("event_id", "errors", stages.total_time(timings).alias("total_time"), stages.has_errors(F.col("errors")).alias("has_errors"))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders from customer")
def x1_semi_and_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).union(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("has_orders")))


@query("select n_name, coalesce(r_name, 'none') as r_name from nation left join (select * from region where r_regionkey > 1) r on r_regionkey = n_regionkey")
def x2_lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").where("r_regionkey > 1")
    n = table(spark, sf_dir, "nation")
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("none")).alias("r_name"))


@query("select l_returnflag, l_linestatus, count(*)::bigint as n, grouping(l_returnflag)::int as g1, grouping(l_linestatus)::int as g2 from lineitem group by rollup (l_returnflag, l_linestatus)")
def x3_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@query("select l_returnflag, l_linestatus, count(*)::bigint as n from lineitem group by cube (l_returnflag, l_linestatus)")
def x3b_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
select user_id, event_id, row_number() over w as n, rank() over (partition by user_id order by event_type) as r, lag(event_id) over w as before
from events window w as (partition by user_id order by ts desc, event_id) qualify row_number() over w <= 5
""")
def x4_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    e = table(spark, sf_dir, "events").withColumns({"n": F.row_number().over(w).cast("long"), "r": F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long"), "before": F.lag("event_id").over(w)})
    return e.where("n <= 5").select("user_id", "event_id", "n", "r", "before")


SQL_HOSTS = f"select distinct {SQL_HOST} as host from pages where url like "


@query(f"""
select host, 'both' as kind from ({SQL_HOSTS} 'http:%' intersect {SQL_HOSTS} 'https:%')
union all select host, 'plain' from ({SQL_HOSTS} 'http:%' except {SQL_HOSTS} 'https:%')
union all select host, 'any' from ({SQL_HOSTS} 'http:%' union {SQL_HOSTS} 'https:%')
""")
def x5_host_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", urls.host(F.col("url")).alias("host"))
    a, b = p.where(F.col("url").startswith("http:")).select("host"), p.where(F.col("url").startswith("https:")).select("host")
    named = lambda d, k: d.select("host", F.lit(k).alias("kind"))
    return named(a.intersect(b), "both").union(named(a.subtract(b), "plain")).union(named(a.union(b).distinct(), "any"))


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*)::bigint as n from events group by all")
def x6_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*)::bigint as n from s group by user_id, k
""")
def x6b_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pages in normal form, first sightings only, with title, words and links."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit(0).alias("depth"), F.col("html").alias("raw_html"), F.col("page_id").alias("link_pos"))
    fresh = dedup.new_urls(validate.validated(pages).where("drop_reason is null").drop("drop_reason"))
    found = extract.parsed(fresh).where("drop_reason is null and error is null")
    return found.select("page_id", "url", urls.host(F.col("url")).alias("host"), "title", F.col("content.word_count").alias("word_count"), F.size("links").alias("n_links"))
