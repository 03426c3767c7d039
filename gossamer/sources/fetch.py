"""Fetching: from a table of captures, or over HTTP (or a browser) where a network is there.

A fetch keeps status and final address of every row; rows without success are marked, and dropped by `fetched`.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FetchRules, RobotsRules
from ..functions import urls

ANSWER = "status_code int, final_url string, content_type string, raw_html string, fetch_method string, response_time double, headers map<string,string>, fetch_error string"


NAMES = [c.split()[0] for c in ANSWER.split(", ")]


# What a browser-like client sends.
def headers(rules: FetchRules) -> dict[str, str]:
    return {
        "User-Agent": rules.user_agent,
        "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
        "Accept-Language": rules.accept_language,
        "Accept-Encoding": rules.accept_encoding,
        "Connection": "keep-alive",
    }


def from_captures(df: DataFrame, captures: DataFrame, rules: FetchRules | None = None) -> DataFrame:
    """df (url, ...) joined to captures (url, status_code, final_url, content_type, body): what is not there has failed, as has
    any status outside 200 to 299 and any body beyond the size limit. Captures are judged before the join, which bodies of no use don't enter."""
    rules = rules or FetchRules()
    limit, body = rules.max_content_size_mb * 1024 * 1024, F.col("body").cast("string")
    failed = F.when(~F.col("status_code").between(200, 299), F.concat(F.lit("HTTP "), F.col("status_code"))).when(F.octet_length("body") > limit, "Content too large")
    c = captures.select(F.col("url").alias("_u"), "status_code", "final_url", "content_type", failed.alias("_e"), F.when(failed.isNull(), F.make_valid_utf8(body)).alias("_b"))
    large = F.octet_length("_b") > limit  # replaced bytes make a body longer, never shorter
    c = c.select("_u", "status_code", "final_url", "content_type", F.when(large, "Content too large").otherwise(F.col("_e")).alias("_e"), F.when(~large, F.col("_b")).alias("_b"))
    out = df.join(c, F.col("url") == F.col("_u"), "left").withColumn("fetch_error", F.when(F.col("_u").isNull(), "not captured").otherwise(F.col("_e")))
    out = out.withColumn("final_url", F.coalesce("final_url", "url")).withColumn("raw_html", F.when(F.col("fetch_error").isNull(), F.coalesce("_b", F.lit(""))))
    return out.withColumn("fetch_method", F.lit("capture")).drop("_u", "_e", "_b")


def fetched(df: DataFrame) -> DataFrame:
    return df.where("fetch_error is null")


def session(rules: FetchRules) -> Any:
    """A pooled session with retries and the usual headers."""
    import requests
    from requests.adapters import HTTPAdapter
    from urllib3.util.retry import Retry

    s = requests.Session()
    retry = Retry(total=rules.max_retries, backoff_factor=rules.retry_backoff_factor, status_forcelist=rules.retry_on_status, allowed_methods=["GET", "HEAD"], raise_on_status=False)
    adapter = HTTPAdapter(max_retries=retry, pool_connections=rules.pool_connections, pool_maxsize=rules.pool_maxsize)
    for scheme in ("http://", "https://"):
        s.mount(scheme, adapter)
    s.headers.update(headers(rules))
    return s


def get(s: Any, url: str, rules: FetchRules) -> dict[str, Any]:
    """One GET: redirects followed, the body read in parts and given up beyond the limit."""
    began, limit = time.monotonic(), rules.max_content_size_mb * 1024 * 1024
    out: dict[str, Any] = {"status_code": None, "final_url": url, "content_type": "", "raw_html": None, "fetch_method": "requests", "headers": {}, "fetch_error": None}
    try:
        with s.get(url, timeout=rules.timeout_seconds, verify=rules.verify_ssl, allow_redirects=True, stream=True) as r:
            out |= {"status_code": r.status_code, "final_url": r.url, "headers": dict(r.headers), "content_type": r.headers.get("Content-Type", "")}
            if not 200 <= r.status_code < 300:
                out["fetch_error"] = f"HTTP {r.status_code}"
            elif int(r.headers.get("Content-Length") or 0) > limit:
                out["fetch_error"] = "Content too large"
            else:
                body = bytearray()
                for part in r.iter_content(8192):
                    body += part
                    if len(body) > limit:
                        out["fetch_error"] = "Content too large"
                        break
                else:
                    out["raw_html"] = body.decode("utf-8", "replace")
    except Exception as e:
        out["fetch_error"] = f"{type(e).__name__}: {e}"
    return out | {"response_time": time.monotonic() - began}


def _browser_get(page: Any, url: str, rules: FetchRules) -> dict[str, Any]:
    began = time.monotonic()
    out: dict[str, Any] = {"status_code": None, "final_url": url, "content_type": "", "raw_html": None, "fetch_method": "browser", "headers": {}, "fetch_error": None}
    try:
        answer = page.goto(url, timeout=rules.timeout_seconds * 1000, wait_until="domcontentloaded")
        for wait in (lambda: page.wait_for_load_state("networkidle", timeout=5000), lambda: rules.wait_for_selector and page.wait_for_selector(rules.wait_for_selector, timeout=5000)):
            try:
                wait()
            except Exception:  # a page that never rests is read as it is
                continue
        time.sleep(rules.page_load_delay)
        out |= {"status_code": answer.status if answer else 200, "final_url": page.url, "raw_html": page.content(), "headers": dict(answer.headers) if answer else {}}
    except Exception as e:
        out["fetch_error"] = f"{type(e).__name__}: {e}"
    return out | {"response_time": time.monotonic() - began}


def browsed(frames: Iterator[pd.DataFrame], rules: FetchRules) -> Iterator[pd.DataFrame]:
    """The frames' addresses read by one browser, a page each, in order; it is closed at the end whatever happens."""
    from playwright.sync_api import sync_playwright

    with sync_playwright() as p:
        browser = getattr(p, rules.browser_type).launch(headless=True)
        try:
            for f in frames:
                rows = []
                for u in f["url"]:
                    page = browser.new_page(user_agent=rules.user_agent, viewport={"width": 1920, "height": 1080})
                    rows.append(_browser_get(page, u, rules))
                    page.close()
                yield pd.concat([f.reset_index(drop=True), pd.DataFrame(rows, columns=NAMES)], axis=1)
        finally:
            browser.close()


def requested(frames: Iterator[pd.DataFrame], rules: FetchRules, workers: int) -> Iterator[pd.DataFrame]:
    """The frames' addresses read by `workers` threads over one session, none before its release time where there is one."""
    s, began = session(rules), time.monotonic()

    def one(job: tuple[str, float]) -> dict[str, Any]:
        time.sleep(max(0.0, job[1] / 1_000_000 - (time.monotonic() - began)))
        return get(s, job[0], rules)

    try:
        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                f = f.sort_values("release_us", kind="stable") if "release_us" in f else f
                jobs = zip(f["url"], f["release_us"] if "release_us" in f else [0.0] * len(f))
                yield pd.concat([f.reset_index(drop=True), pd.DataFrame(list(pool.map(one, jobs)), columns=NAMES)], axis=1)
    finally:
        s.close()


def over_http(df: DataFrame, rules: FetchRules | None = None, workers: int = 10) -> DataFrame:
    """df (url, ...) fetched by `workers` threads a task over one session (or one browser page after the other), closed at its end.
    With `release_us` (microseconds from the start of the task) no request goes out before its time, in order of release."""
    rules = rules or FetchRules()
    if "release_us" in df.columns:  # a host's requests are one task's, so that its schedule holds
        df = df.repartition(urls.host(F.col("url")))
    run = (lambda frames: browsed(frames, rules)) if rules.use_headless_browser else (lambda frames: requested(frames, rules, workers))
    kept = [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema]
    return df.mapInPandas(run, ", ".join([*kept, ANSWER]))


def robots_asked(frames: Iterator[pd.DataFrame], rules: RobotsRules) -> Iterator[pd.DataFrame]:
    """Status and body of each domain's robots.txt; both null where no answer came, or none that is UTF-8."""
    import requests

    with requests.Session() as s:
        for f in frames:
            rows = []
            for d in f["domain"]:
                try:
                    r = s.get(f"https://{d}/robots.txt", timeout=rules.timeout_seconds, headers={"User-Agent": rules.user_agent})
                    rows.append((d, r.status_code, r.content.decode("utf-8")))
                except Exception:  # the default decides
                    rows.append((d, None, None))
            yield pd.DataFrame(rows, columns=["domain", "status", "body"])


def robots_over_http(hosts: DataFrame, rules: RobotsRules | None = None) -> DataFrame:
    """(domain, status, body, fetched_at) of https://<domain>/robots.txt; status is null where no answer came."""
    rules = rules or RobotsRules()
    return hosts.select("domain").distinct().mapInPandas(lambda frames: robots_asked(frames, rules), "domain string, status int, body string").withColumn("fetched_at", F.current_timestamp())


def fetch_stats(df: DataFrame) -> DataFrame:
    ok = F.col("fetch_error").isNull()
    return df.agg(F.count("*").alias("fetched"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(F.col("fetch_error").contains("Timeout")).alias("timeouts"), F.sum(F.octet_length("raw_html")).alias("bytes"), F.avg("response_time").alias("mean_response_time") if "response_time" in df.columns else F.lit(None).cast("double").alias("mean_response_time"))


def errors_by_status(df: DataFrame) -> DataFrame:
    return df.where("fetch_error is not null and status_code is not null").groupBy("status_code").count()
