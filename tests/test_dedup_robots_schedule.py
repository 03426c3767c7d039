import random
from collections import deque
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from gossamer.config import DedupRules, RateRules, RobotsRules
from gossamer.operators import dedup, robots, schedule, validate

PATHS = ["page1", "page2", "page1", "page3", "PAGE1", "page4", "page2"]


def frame(spark):
    return spark.createDataFrame([(f"http://h.com/{p}", i) for i, p in enumerate(PATHS)], "url string, link_pos int")


@pytest.mark.parametrize("sensitive,kept", [(False, [0, 1, 3, 5]), (True, [0, 1, 3, 4, 5])])
def test_first_sightings(spark, sensitive, kept):
    rules = DedupRules(case_sensitive=sensitive)
    assert sorted(r.link_pos for r in dedup.new_urls(frame(spark), None, rules).collect()) == kept
    assert sorted(r.link_pos for r in dedup.first_seen(frame(spark), sensitive).where("is_first").collect()) == kept
    stats = dedup.dedup_stats(frame(spark), rules).first()
    assert (stats.unique_urls, stats.duplicate_urls, stats.total_checked) == (len(kept), 7 - len(kept), 7)


def test_a_filter_computes_the_normal_form_once(spark):
    """A filter of many times the size took most of a stream's time; an address and its absence come through."""
    made = spark.range(3).select(F.when(F.col("id") == 0, "HTTP://H.com:80/a/?b=1&a=2#x").when(F.col("id") == 1, "no url").alias("url"), F.lit(0).alias("depth"))
    checked = validate.validated(made)
    kept = checked.where("drop_reason is null")
    forms = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("array_sort")
    assert forms(kept) == forms(checked) > 0
    assert [r.url for r in kept.collect()] == ["http://h.com/a?a=2&b=1"]
    assert sorted((str(r.url), r.drop_reason) for r in checked.where("drop_reason is not null").collect()) == [("None", "format"), ("no url", "format")]


@pytest.mark.parametrize("method", ["set", "database", "bloom"])
def test_against_seen(spark, method):
    rules = DedupRules(method=method, bloom_capacity=1000)
    seen = spark.createDataFrame([("http://h.com/PAGE1",), ("http://h.com/page3",)], "url string")
    assert sorted(r.link_pos for r in dedup.new_urls(frame(spark), seen, rules).collect()) == [1, 5]


def test_bloom_false_positives(spark):
    rules = DedupRules(bloom_capacity=2000, bloom_error_rate=0.01)
    bits = dedup.bloom_filter(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key")), 2000, 0.01)
    known = spark.range(2000).select(dedup.might_contain(F.concat(F.lit("k"), "id"), bits, rules).alias("x"))
    other = spark.range(20000).select(dedup.might_contain(F.concat(F.lit("other"), "id"), bits, rules).alias("x"))
    assert known.where("x").count() == 2000 and other.where("x").count() < 20000 * 0.02
    with pytest.raises(ValueError):
        dedup.new_urls(frame(spark), frame(spark), DedupRules(method="none"))


def test_seen_table_lasts(spark, tmp_path):
    seen = dedup.SeenUrls(spark, str(tmp_path / "seen"))
    assert seen.count() == 0
    seen.add(frame(spark))
    seen.add(frame(spark))
    assert seen.count() == 4
    assert [r.seen for r in seen.contains(spark.createDataFrame([("http://h.com/PAGE4",), ("http://h.com/new",)], "url string")).orderBy("url").collect()] == [True, False]
    seen.clear()
    assert seen.count() == 0


BODY = "User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nAllow: /private/ok\nDisallow: /private\nDisallow: /tmp*\nDisallow: /a%2F\nDisallow: /q?x\nDisallow: /%C3%BC\nDisallow: /s;p\nDisallow: /a%2\nAllow: /a+\nDisallow: /a b\nDisallow: ?x\nCrawl-delay: 2\n"


@pytest.mark.parametrize("agent", ["mycrawler/1.0", "otherbot/2"])
def test_robots_rules(spark, agent):
    paths = ["", "/", "/private", "/private/ok/1", "/privateer", "/tmpx", "/tmp*", "/%70rivate", "/a%2", "/a%2Fb", "/a+b", "/q?x=1&y", "/q?", "/q#", "/s;", "/s;p", "/s;p?z", "/ü", "/%C3%BC", "?x", "/pri\tvate", "/%2e/x%zz", "/a%252F"]
    pages = spark.createDataFrame([(f"http://h.com:81{p}",) for p in paths], "url string")
    table = spark.createDataFrame([("h.com", 200, BODY)], "domain string, status int, body string")
    p = RobotFileParser()
    p.parse(BODY.splitlines())
    for r in robots.with_robots(pages, table, RobotsRules(user_agent=agent)).collect():
        assert r.allowed == p.can_fetch(agent, r.url) and r.crawl_delay == (2.0 if agent.startswith("my") else None)


@pytest.mark.parametrize("status,default,allowed", [(401, "allow", False), (403, "allow", False), (404, "disallow", True), (503, "allow", False), (None, "allow", True), (None, "disallow", False)])
def test_robots_without_rules(spark, status, default, allowed):
    pages = spark.createDataFrame([("http://h.com/x",)], "url string")
    table = spark.createDataFrame([("h.com", status, None)], "domain string, status int, body string")
    rules = RobotsRules(default_on_error=default)
    assert robots.with_robots(pages, table, rules).first().allowed == allowed
    if status is None:
        assert robots.with_robots(pages, table.limit(0), rules).first().allowed == allowed
    assert robots.with_robots(pages, table, RobotsRules(respect_robots_txt=False)).first().allowed


def test_old_answers_do_not_count(spark):
    pages = spark.createDataFrame([("http://h.com/x",)], "url string")
    table = spark.sql("select 'h.com' as domain, 403 as status, '' as body, timestamp'2024-01-01 00:00:00' as fetched_at")
    now = lambda s: F.lit(s).cast("timestamp")
    assert not robots.with_robots(pages, table, RobotsRules(), now("2024-01-01 23:00:00")).first().allowed
    assert robots.with_robots(pages, table, RobotsRules(), now("2024-01-03 00:00:00")).first().allowed
    assert robots.stale_hosts(pages, table, RobotsRules(), now("2024-01-01 23:00:00")).count() == 0
    assert [r.domain for r in robots.stale_hosts(pages, table, RobotsRules(), now("2024-01-03 00:00:00")).collect()] == ["h.com"]


def simulate(rows, strategy, n, d):
    """rows of one host in order: (arrival, delay)."""
    out, window, tokens, at = [], deque(), float(n), None
    for i, (a, delay) in enumerate(rows):
        if strategy == "fixed":
            t = a if not out else max(a, out[-1] + delay)
        elif strategy == "sliding_window":
            t = a if len(out) < n else max(a, out[-n] + n * d)
        else:
            rate = rows[0][1]
            t = a if not out else max(a, out[-1])
            if rate:
                if at is not None:
                    tokens = min(n, tokens + (t - at) / rate)
                if tokens < 1 - 1e-9:
                    t += round((1 - tokens) * rate)
                    tokens = 1.0
                tokens -= 1
            else:
                t = a
            at = t
        out.append(t)
    return out


@pytest.mark.parametrize("strategy", ["fixed", "token_bucket", "sliding_window"])
@pytest.mark.parametrize("spread", [60, 1])
def test_schedules_against_simulation(spark, strategy, spread):
    """spread 1: all requests of a host come at one time, and still lie in several parts."""
    rng, data = random.Random(5), {}
    for h in ("a", "b", "hot"):
        d = rng.choice([1, 2, 3])
        data[h] = sorted((rng.randrange(spread) * 1_000_000, d if strategy == "token_bucket" else rng.choice([1, 2, 4])) for _ in range(400 if h == "hot" else 40))
    rows = [(h, i, a, float(d)) for h, xs in data.items() for i, (a, d) in enumerate(xs)]
    got = schedule.scheduled(spark.createDataFrame(rows, "host string, id long, arrival_us long, crawl_delay double"), RateRules(strategy=strategy, burst_size=3))
    made = {(r.host, r.id): r.release_us for r in got.collect()}
    for h, xs in data.items():
        want = simulate([(a, d * 1_000_000) for a, d in xs], strategy, 3, 1_000_000)
        assert [made[h, i] for i in range(len(xs))] == want


@pytest.mark.parametrize("strategy,a,b", [("fixed", [0, 1, 2, 3], [0, 0.5]), ("token_bucket", [0, 0, 0, 1], [0, 0]), ("sliding_window", [0, 0, 0, 3], [0, 0])])
def test_two_hosts_at_once(spark, strategy, a, b):
    default = 1.0 if strategy == "sliding_window" else 0.5
    rows = [("A", i, 0, 1.0) for i in range(4)] + [("B", i, 0, None) for i in range(2)]
    got = schedule.scheduled(spark.createDataFrame(rows, "host string, id long, arrival_us long, crawl_delay double"), RateRules(default_delay_seconds=default, burst_size=3, strategy=strategy, global_rate_limit=10)).orderBy("host", "id").collect()
    assert [r.release_us / 1e6 for r in got] == a + b


def test_limit_over_all_hosts(spark):
    rng = random.Random(2)
    rows = sorted((rng.randrange(3_000_000), i) for i in range(60))
    got = schedule.global_limit(spark.createDataFrame([("h", i, a) for a, i in rows], "host string, id long, arrival_us long"), 7).orderBy("arrival_us", "id").collect()
    out = []
    for a, _ in rows:
        out.append(a if len(out) < 7 else max(a, out[-7] + 1_000_000))
    assert [r.release_us for r in got] == out
    with pytest.raises(ValueError):
        schedule.scheduled(spark.createDataFrame([("h", 1, 0)], "host string, id long, arrival_us long"), RateRules(strategy="none"))


def test_bloom_is_sized_for_what_was_seen(spark):
    """Fifty times as many seen keys as the capacity: new ones still are dropped with the configured probability only."""
    rules = DedupRules(method="bloom", bloom_capacity=100, bloom_error_rate=0.01)
    seen = spark.range(5000).select(F.concat(F.lit("http://k/"), "id").alias("url"))
    fresh = spark.range(10_000, 14_000).select(F.concat(F.lit("http://k/"), "id").alias("url"))
    assert dedup.new_urls(fresh, seen, rules).count() > 0.97 * 4000
    assert dedup.new_urls(seen, seen.union(seen), rules).count() == 0


def test_a_hot_host_lies_in_several_parts(spark):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("'h' as host", "id", "0L as arrival_us")
    parts, bucket = schedule._bucketed(rows, ["host"])
    sizes = [r["count"] for r in parts.groupBy(bucket).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    assert schedule.scheduled(rows, RateRules(default_delay_seconds=1.0)).agg({"release_us": "max"}).first()[0] == 19_999 * 1_000_000


def test_a_large_filter_is_cut_into_shards(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SENT_BYTES", 1000)
    seen = spark.range(20_000).selectExpr("concat('http://h.com/', id) as url")
    new = spark.range(15_000, 30_000).selectExpr("concat('http://H.com/', id) as url", "array(id) as more")
    rules = DedupRules(method="bloom", bloom_capacity=100, bloom_error_rate=0.01)
    kept = {r.url for r in dedup.new_urls(new, seen, rules).collect()}
    assert all(int(u.rsplit("/")[-1]) >= 20_000 for u in kept) and 9_700 <= len(kept) <= 10_000
    hits = dedup.sharded_hits(new.selectExpr("lower(url) as _key"), seen.selectExpr("url as key"), DedupRules(bloom_capacity=20_000, bloom_error_rate=0.01), 3_000)
    assert 5_000 <= hits.count() <= 5_300
