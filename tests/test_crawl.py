import pytest
from pyspark.sql import functions as F

from gossamer.config import CrawlConfig, FetchRules, FollowRules, RobotsRules, StorageRules
from gossamer.operators import dedup, sink
from gossamer.plans import crawl, stages
from gossamer.plans.queries import g3_crawl
from gossamer.sources import fetch, seeds, stored


def page(links, title="t"):
    return f"<html><title>{title}</title><body>" + " ".join(f'<a href="{x}">{x}</a>' for x in links) + "</body></html>"


SITE = {"/": ["/a", "/b", "/missing"], "/a": ["/c", "/b"], "/b": ["/A", "/img.png", "/doc.pdf"], "/c": ["/d"], "/d": ["/e"], "/e": []}


def captures(spark):
    rows = [(f"http://s.com{p}", 200, f"http://s.com{p}", "text/html", page(x)) for p, x in SITE.items()] + [("http://s.com/missing", 404, None, "text/html", "")]
    return spark.createDataFrame(rows, "url string, status_code int, final_url string, content_type string, body string")


def test_crawl_by_depth_and_limits(spark, tmp_path):
    config = CrawlConfig()
    run = crawl.Crawl(spark, config, captures=captures(spark), folder=str(tmp_path / "out"), seen=dedup.SeenUrls(spark, str(tmp_path / "seen")))
    got = {r.url: r for r in run.run(["http://s.com/"]).collect()}
    assert {u.removeprefix("http://s.com"): r.depth for u, r in got.items()} == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/d": 3}
    assert got["http://s.com/c"].parent_url == "http://s.com/a" and run.complete
    lost = {(r.url, r.drop_reason) for r in run.rejected.collect()}
    assert ("http://s.com/missing", "HTTP 404") in lost and ("http://s.com/doc.pdf", "extension") in lost
    assert spark.read.parquet(str(tmp_path / "out/pages")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out/images")).count() == 1
    assert run.stats().agg(F.sum("pages_crawled")).first()[0] == 5 and "pages_crawled: 5" in run.report()
    again = crawl.Crawl(spark, config, captures=captures(spark), seen=dedup.SeenUrls(spark, str(tmp_path / "seen")))
    assert again.run(["http://s.com/"]).count() == 0


def test_page_limit_and_robots(spark):
    config = CrawlConfig(link_reinjection=FollowRules(max_total_pages=2))
    assert sorted(r.url for r in crawl.Crawl(spark, config, captures=captures(spark)).run(["http://s.com/"]).collect()) == ["http://s.com/", "http://s.com/a"]
    table = spark.createDataFrame([("s.com", 200, "User-agent: *\nDisallow: /a\n")], "domain string, status int, body string")
    run = crawl.Crawl(spark, CrawlConfig(robots=RobotsRules()), captures=captures(spark), robots_table=table)
    assert sorted(r.url for r in run.run(["http://s.com/"]).collect()) == ["http://s.com/", "http://s.com/b"]
    assert ("http://s.com/a", "robots") in {(r.url, r.drop_reason) for r in run.rejected.collect()}


def test_graph_crawl_is_by_breadth(spark, sf_dir):
    got = {int(r.url.rsplit("p", 1)[1]): r.depth for r in g3_crawl(spark, sf_dir).collect()}
    n, depth, level = 50, {0: 0}, [0]
    for d in range(1, 4):
        level = list(dict.fromkeys(x for i in level for x in ((3 * i + k) % n for k in (1, 2, 3)) if x not in depth))
        depth |= dict.fromkeys(level, d)
    assert got == depth


def test_follow_counts(spark):
    link = lambda n: [{"pos": i, "kind": "anchor", "url": f"http://h.com/{i}", "text": None} for i in range(n)]
    rows = [(f"http://h.com/p{i}", d, i, link(n)) for i, (d, n) in enumerate([(0, 3), (1, 2), (1, 1), (2, 1)])]
    pages = spark.createDataFrame(rows, "url string, depth int, page_order long, links array<struct<pos:int,kind:string,url:string,text:string>>")
    s = crawl.follow_stats(pages, FollowRules(max_depth=2)).first()
    assert (s.found, s.reinjected, s.skipped_depth, round(s.rate, 2)) == (7, 6, 1, 85.71)
    children = crawl.next_frontier(pages, FollowRules(max_depth=2))
    assert sorted(r.depth for r in children.collect()) == [1, 1, 1, 2, 2, 2]
    assert crawl.next_frontier(pages, FollowRules(max_depth=2, same_domain_only=True)).count() == 6


def test_store_twice(spark, tmp_path):
    link = lambda n: [{"pos": i, "kind": "anchor", "url": f"http://h.com/{i}", "text": "x"} for i in range(n)]
    pages = spark.createDataFrame([("http://h.com/a", 0, "<p>", link(2)), ("http://h.com/b", 1, "<p>", link(1))], "url string, depth int, raw_html string, links array<struct<pos:int,kind:string,url:string,text:string>>")
    folder = str(tmp_path / "store")
    for k in (1, 2):
        sink.store(pages, folder, StorageRules(), F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp"))
        assert spark.read.parquet(f"{folder}/pages").count() == 2 and spark.read.parquet(f"{folder}/links").count() == 3 * k
    assert {r.crawled_at.day for r in spark.read.parquet(f"{folder}/pages").collect()} == {2}
    sink.store(pages, folder, StorageRules(on_conflict="ignore", store_links=False), F.lit("2024-01-09 00:00:00").cast("timestamp"))
    assert {r.crawled_at.day for r in spark.read.parquet(f"{folder}/pages").collect()} == {2}
    kept = spark.read.parquet(f"{folder}/pages")
    assert {r.raw_html for r in sink.uncompressed(kept).collect()} == {"<p>"} and '"anchor_texts":{"http://h.com/0":"x"' in kept.orderBy("url").first().metadata
    sink.store(pages, folder, StorageRules(compress_html=False, store_links=False), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    assert {r.raw_html for r in spark.read.parquet(f"{folder}/pages").collect()} == {"<p>"}
    ok = pages.withColumn("ok", F.col("depth") == 0)
    assert tuple(sink.storage_stats(ok).first()) == (1, 1, 3, 50.0)
    with pytest.raises(ValueError):
        sink.upserted(pages, pages, ["url"], ["depth"], "other")
    import gzip

    assert gzip.decompress(bytes(sink.compressed(pages).first().raw_html)) == b"<p>"
    sink.store_by_host(pages.withColumn("url", F.lit("http://h.com:8/x/y?q=1")), str(tmp_path / "hosts"))
    assert [(r.domain, r.path) for r in spark.read.parquet(str(tmp_path / "hosts")).collect()] == [("h.com_8", "h.com_8/x_y")]


def test_sqlite_store(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as c:
        c.execute("create table pages (id integer primary key, url text, final_url text, title text, content_type text, status_code int, depth int, parent_url text, raw_html text, text_content text, word_count int, char_count int, crawled_at text, metadata text)")
        c.executemany("insert into pages (url, status_code, word_count) values (?, ?, ?)", [(f"u{i:02}", 200 if i % 2 else 404, i) for i in range(20)])
    got = stored.ok_pages(stored.sqlite_table(spark, path, "pages", 3))
    assert [(r.url, r.word_count) for r in got.collect()] == [("u01", 1), ("u03", 3), ("u05", 5), ("u07", 7), ("u09", 9)]


def test_bodies_of_no_use_stay_out_of_the_join(spark):
    """Captures are judged before they meet the addresses; bytes that are no text count as what replaces them."""
    body = "case id when 0 then cast('ok' as binary) when 1 then cast(repeat('x', 1024 * 1024 + 1) as binary) when 2 then unhex(repeat('FF', 400000)) when 3 then cast('gone' as binary) end"
    captures = spark.range(5).selectExpr("concat('http://h.com/', id) as url", "case when id = 3 then 404 else 200 end as status_code", "cast(null as string) as final_url", "'text/html' as content_type", f"{body} as body")
    got = fetch.from_captures(spark.range(6).selectExpr("concat('http://h.com/', id) as url"), captures, FetchRules(max_content_size_mb=1))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Content too large")
    assert [(r.fetch_error, r.raw_html) for r in got.orderBy("url").collect()] == [(None, "ok"), ("Content too large", None), ("Content too large", None), ("HTTP 404", None), (None, ""), ("not captured", None)]


def test_http_fetch_over_a_local_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if self.path == "/no" else 200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>caf\xc3\xa9 \xff</p>")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    got = {r.url.removeprefix(root): r for r in fetch.over_http(seeds.seeds(spark, [root + "/yes", root + "/no"])).collect()}
    server.shutdown()
    assert got["/yes"].raw_html == "<p>café �</p>" and got["/yes"].content_type == "text/html" and got["/yes"].fetch_error is None
    assert got["/no"].fetch_error == "HTTP 404" and got["/no"].raw_html is None


def test_stage_pipeline(spark):
    def drop_b(df):
        return df.withColumn("drop_reason", F.when(F.col("url") == "B", "b").when(F.col("url") == "C", "error"))

    pipe = stages.Pipeline().add_stage("upper_case").add_stage("drop", drop_b)
    rows = seeds.seeds(spark, ["a", "b", "c", "d"])
    assert sorted(r.url for r in pipe.run(rows).collect()) == ["A", "D"]
    with pipe:
        assert pipe.run_counted(rows).count() == 2
    stats = {r.name: r for r in pipe.stage_stats(spark).collect()}
    assert (stats["drop"].processed, stats["drop"].rows_out, stats["drop"].dropped, stats["drop"].errors) == (4, 2, 1, 1)
    total = stages.overall(pipe.stage_stats(spark)).first()
    assert (total.processed, total.errors, total.dropped, total.success_rate) == (8, 1, 1, 7 / 8)
    assert [r.high_errors for r in stages.bottlenecks(pipe.stage_stats(spark)).orderBy("name").collect()] == [True, False]
    assert pipe.run_counted(rows).count() == 4  # stopped: rows pass unseen
    pipe.stages[0].reset_stats()
    assert pipe.stages[0].processed == 0
    record = stages.to_record(rows).first().record
    assert record.count(":") == 18 and '"url":"a"' in record


def test_store_kinds_and_catalog(spark, tmp_path):
    from gossamer.schema import PAGES

    page = spark.createDataFrame([("http://h.com/a", 0, [])], "url string, depth int, links array<struct<pos:int,kind:string,url:string,text:string>>")
    sink.write(page, StorageRules(storage_type="filesystem"), str(tmp_path / "f"))
    sink.write(page, StorageRules(storage_type="json"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "f")).first().path == "h.com/a"
    assert spark.read.parquet(str(tmp_path / "t/pages")).columns == [c.split()[0] for c in PAGES.split(", ")]
    spark.sql("create database if not exists store")
    sink.create_tables(spark, "store")
    assert {r.tableName for r in spark.sql("show tables in store").collect() if not r.isTemporary} == {"pages", "links", "images", "crawl_stats", "seen_urls"}
    assert "all: 0 processed" in stages.Pipeline().add_stage("upper_case").summary(spark)


def test_database_store(spark):
    link = [{"pos": 0, "kind": "anchor", "url": "http://h.com/x", "text": "t"}, {"pos": 1, "kind": "image", "url": "http://h.com/x.png", "text": ""}]
    pages = spark.createDataFrame([("http://h.com/a", 0, "<p>", link)], "url string, depth int, raw_html string, links array<struct<pos:int,kind:string,url:string,text:string>>")
    url = "jdbc:derby:memory:store;create=true"
    for k in (1, 2):
        sink.store_jdbc(pages.withColumn("depth", F.lit(k)), url, StorageRules(), F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp"))
    assert [(r.url, r.depth) for r in spark.read.jdbc(url, "pages").collect()] == [("http://h.com/a", 2)]
    assert spark.read.jdbc(url, "links").count() == 2 and spark.read.jdbc(url, "images").count() == 2


def test_rows_that_raise_are_dropped_and_counted(spark):
    def halve(r):
        if r["n"] == 3:
            raise ValueError("three")
        return None if r["n"] == 4 else {"url": r["url"], "half": r["n"] / 2}

    rows = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "url string, n int")
    pipe = stages.Pipeline().add_stage("halve", stages.row_stage(halve, "url string, half double"))
    assert sorted(r.half for r in pipe.run_counted(rows).collect()) == [0, 0.5, 1, 2.5]
    s = pipe.stages[0]
    assert (s.processed, s.rows_out, s.errors) == (6, 4, 1) and pipe.stage_stats(spark).first().dropped == 1
    found = rows.transform(stages.row_stage(halve, "url string, half double")).where("drop_reason = 'error'").first()
    assert found.stage_error == "ValueError: three"


def test_small_functions(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("http://h.com/a\n\n  http://h.com/b \n")
    assert sorted(r.url for r in seeds.seeds_from_text(spark, str(tmp_path / "seeds.txt"), 2).collect()) == ["http://h.com/a", "http://h.com/b"]
    links = spark.createDataFrame([("b", "x", None), ("a", "y", "t")], "source_url string, target_url string, anchor_text string")
    assert [r.source_url for r in stored.link_rows(links, 1).collect()] == ["a"]
    assert stored.titles(spark.createDataFrame([("u", "t", 1)], "url string, title string, depth int")).columns == ["url", "title"]
    answers = spark.createDataFrame([("a", None, 200, "xy", 0.5), ("b", "ReadTimeout: x", None, None, 1.5)], "url string, fetch_error string, status_code int, raw_html string, response_time double")
    assert tuple(fetch.fetch_stats(answers).first()) == (2, 1, 1, 1, 2, 1.0)


def test_a_broken_run_takes_up_where_it_was(spark, tmp_path):
    ran = []

    def noted(name):
        def stage(df):
            ran.append(name)
            if name == "c" and ran.count("c") == 1:
                raise RuntimeError("broken off")
            return df.withColumn(name, F.lit(1))

        return stage

    def pipe():
        return stages.Pipeline().add_stage("a", noted("a")).add_stage("b", noted("b")).add_stage("c", noted("c"))

    rows = seeds.seeds(spark, ["x", "y"])
    with pytest.raises(RuntimeError):
        pipe().run_counted(rows, str(tmp_path))
    got = pipe().run_counted(rows, str(tmp_path))
    assert ran == ["a", "b", "c", "c"] and got.count() == 2 and got.columns[-3:] == ["a", "b", "c"]


def test_browser_reads_and_closes(monkeypatch):
    import sys
    import types

    closed = []

    class Page:
        def __init__(self, **how):
            self.how, self.url = how, None

        def goto(self, url, **how):
            if "bad" in url:
                raise RuntimeError("no such host")
            self.url = url + "#moved"
            return types.SimpleNamespace(status=203, headers={"a": "b"})

        def wait_for_load_state(self, *_, **__):
            raise TimeoutError("never rests")

        def content(self):
            return "<p>made</p>"

        def close(self):
            closed.append("page")

    browser = types.SimpleNamespace(new_page=lambda **how: Page(**how), close=lambda: closed.append("browser"))

    class Playwright:
        def __enter__(self):
            return types.SimpleNamespace(chromium=types.SimpleNamespace(launch=lambda headless: browser))

        def __exit__(self, *_):
            closed.append("playwright")

    monkeypatch.setitem(sys.modules, "playwright", types.ModuleType("playwright"))
    monkeypatch.setitem(sys.modules, "playwright.sync_api", types.SimpleNamespace(sync_playwright=Playwright))
    import pandas as pd

    rules = FetchRules(use_headless_browser=True, page_load_delay=0.0)
    got = pd.concat(fetch.browsed(iter([pd.DataFrame({"url": ["http://h.com/", "http://bad/"]})]), rules))
    assert got["status_code"].tolist()[0] == 203 and got["final_url"].tolist() == ["http://h.com/#moved", "http://bad/"]
    assert got["raw_html"].tolist() == ["<p>made</p>", None] and got["fetch_error"].tolist() == [None, "RuntimeError: no such host"]
    assert closed == ["page", "page", "browser", "playwright"]


def test_robots_are_asked_once_a_domain(monkeypatch):
    import types

    import pandas as pd
    import requests

    from gossamer.config import RobotsRules

    asked = []

    def answer(self, url, **how):
        asked.append((url, how["headers"]["User-Agent"]))
        if "down" in url:
            raise requests.ConnectionError("no answer")
        return types.SimpleNamespace(status_code=200, content=b"User-agent: *" if "ok" in url else b"\xff")

    monkeypatch.setattr(requests.Session, "get", answer)
    got = pd.concat(fetch.robots_asked(iter([pd.DataFrame({"domain": ["ok.com", "down.com", "odd.com"]})]), RobotsRules(user_agent="me")))
    assert asked == [(f"https://{d}/robots.txt", "me") for d in ("ok.com", "down.com", "odd.com")]
    assert got["body"].tolist() == ["User-agent: *", None, None] and got["status"].tolist()[0] == 200 and got["status"].isna().tolist() == [False, True, True]


def test_requests_wait_for_their_release(monkeypatch):
    import time

    import pandas as pd

    sent = []
    monkeypatch.setattr(fetch, "get", lambda s, url, rules: sent.append((url, time.monotonic())) or {n: None for n in fetch.NAMES})
    frame = pd.DataFrame({"url": ["b", "a", "c"], "release_us": [300_000, 0, 600_000]})
    began = time.monotonic()
    list(fetch.requested(iter([frame]), FetchRules(), 4))
    at = {u: t - began for u, t in sent}
    assert sorted(at, key=at.get) == ["a", "b", "c"] and at["b"] >= 0.3 and at["c"] >= 0.6
