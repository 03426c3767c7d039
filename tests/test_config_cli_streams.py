import json

import pytest

from gossamer import cli, config
from gossamer.plans import page_queries as Q
from gossamer.streaming import streams


def test_yaml_round_trip_and_defaults(tmp_path):
    path = str(tmp_path / "c" / "x.yaml")
    config.save_yaml(config.CrawlConfig(), path)
    assert config.load_yaml(path) == config.CrawlConfig()
    (tmp_path / "p.yaml").write_text("stages:\n  url_validation: {max_depth: 7, normalize_urls: false, nothing: 1, blocked_extensions: null}\n  robots: {default_on_error: disallow}\npipeline: {queue_size: 50}\n")
    got = config.load_yaml(str(tmp_path / "p.yaml"))
    assert got.url_validation.max_depth == 7 and got.url_validation.normalize_urls and got.robots.default_on_error == "disallow"
    assert got.queue_size == 50 and len(got.url_validation.blocked_extensions) == 28


@pytest.mark.parametrize("text", [None, "", "a: [", "- 1"])
def test_bad_files(tmp_path, text):
    path = tmp_path / "x.yaml"
    if text is not None:
        path.write_text(text)
    with pytest.raises(config.ConfigurationError):
        config.load_yaml(str(path))


def test_validation_and_overrides():
    assert config.validate(config.CrawlConfig())
    for bad in (config.CrawlConfig(queue_size=9), config.CrawlConfig(fetch_workers=0), config.CrawlConfig(url_validation=config.UrlRules(max_depth=-1)), config.CrawlConfig(link_reinjection=config.FollowRules(max_depth=-1))):
        with pytest.raises(config.ConfigurationError):
            config.validate(bad)
    c = config.overridden(config.CrawlConfig(), 2, 9, ["a.com"], "me", 0.5)
    assert (c.url_validation.max_depth, c.link_reinjection.max_depth, c.link_reinjection.max_total_pages, c.robots.user_agent, c.fetch.user_agent) == (2, 2, 9, "me", "me")


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main([]) == 0
    assert cli.main(["config", "--create-default", "-o", "d.yaml"]) == 0 and cli.main(["config", "--validate", "d.yaml"]) == 0
    assert cli.main(["config", "--validate", "none.yaml"]) == 1 and cli.main(["config"]) == 1
    assert cli.main(["crawl", "http://a.com", "-c", "none.yaml"]) == 1


def test_crawl_command(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    spark.createDataFrame([("http://s.com/", 200, None, "text/html", "<title>x</title>")], "url string, status_code int, final_url string, content_type string, body string").write.parquet(str(tmp_path / "captures"))
    assert cli.main(["crawl", "http://s.com/", "--captures", str(tmp_path / "captures"), "--output", str(tmp_path / "out"), "-d", "0"]) == 0
    assert "pages_crawled: 1" in capsys.readouterr().out


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [{"url": "http://a.com/x/", "depth": 0}, {"url": "HTTP://A.com/X", "depth": 0}, {"url": "bad", "depth": 0}])
    run = lambda: streams.to_folder(streams.first_sightings(streams.url_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    monitor = streams.Monitor()
    spark.streams.addListener(monitor)
    run()
    spark.streams.removeListener(monitor)
    write(src, "2.json", [{"url": "http://a.com/x", "depth": 0}, {"url": "http://b.com/", "depth": 0}])
    run()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["http://a.com/x", "http://b.com/"]
    seen = tmp_path / "seen"
    write(seen, "1.json", [{"url": f"http://a.com/{i}", "ts": f"2024-01-01T00:{i:02}:00Z"} for i in (0, 1, 2, 30)])
    stream = streams.url_stream(spark, str(seen), "url string, ts timestamp")
    for made, n in ((streams.host_windows(stream, size="10 minutes"), 2), (streams.host_sessions(stream), 2)):
        q = made.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table("w").count() == n
    arrivals = tmp_path / "arr"
    write(arrivals, "1.json", [{"host": "h", "id": i, "arrival_us": 0} for i in range(3)])
    limited = streams.fixed_delay(streams.url_stream(spark, str(arrivals), "host string, id long, arrival_us long"), 5)
    q = limited.writeStream.format("memory").queryName("d").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.release_us for r in spark.table("d").collect()) == [0, 5, 10]


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_against_sql(spark, sf_dir, name):
    import duckdb

    got = Q.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    assert rows
    if name not in Q.ORACLE_SQL:
        return
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'; set enable_progress_bar = false")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: str(r)
    assert sorted((tuple(norm(r[n]) for n in sorted(names)) for r in rows), key=key) == sorted((tuple(norm(r[names.index(n)]) for n in sorted(names)) for r in want.fetchall()), key=key)
