"""Robots rules: a dimension table of answers by host. Each answer is parsed once, a row a host, into the rules that hold for
the configured agent; pages meet these by a join, and the first rule whose path begins theirs decides, in the JVM."""

from __future__ import annotations

from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RobotsRules
from ..functions import urls


def _parser(status: int | None, body: str | None, default: str) -> RobotFileParser | None:
    """Rules for an answer; None where nothing was read and all is refused. No answer at all follows the default."""
    p = RobotFileParser()
    if status is None:
        p.parse([] if default == "allow" else ["User-agent: *", "Disallow: /"])
    elif status in (401, 403):
        p.disallow_all = True
    elif 400 <= status < 500:
        p.allow_all = True
    elif status >= 500:
        return None
    else:
        p.parse((body or "").splitlines())
    return p


def host_rules(rules: RobotsRules, status: Column, body: Column) -> Column:
    """struct<paths, allows, crawl_delay>: the rules of an answer for the configured agent, in order, paths decoded."""

    @F.pandas_udf("paths array<string>, allows array<boolean>, crawl_delay double")
    def parse(statuses: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        out = []
        for s, b in zip(statuses, bodies):
            p = _parser(None if pd.isna(s) else int(s), b if isinstance(b, str) else None, rules.default_on_error)
            if p is None or p.disallow_all:
                out.append(([""], [False], None))
            elif p.allow_all:
                out.append(([], [], None))
            else:
                entry = next((e for e in [*p.entries, *([p.default_entry] if p.default_entry else [])] if e is p.default_entry or e.applies_to(rules.user_agent)), None)
                lines = entry.rulelines if entry else []
                delay = p.crawl_delay(rules.user_agent) if p.mtime() else None
                out.append(([unquote(x.path) for x in lines], [x.allowance for x in lines], float(delay) if delay else None))
        return pd.DataFrame(out, columns=["paths", "allows", "crawl_delay"])

    return parse(status, body)


def target(url: Column) -> Column:
    """What rules are held against: the decoded address behind its host, without empty parameters, query and fragment."""
    whole = urls.decoded(F.replace(F.coalesce(url, F.lit("")), F.lit("+"), F.lit("%2B")))
    rest = F.regexp_replace(F.translate(whole, "\t\r\n", ""), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"^([^?#]*/[^/;?#]*|[^/;?#]*);(?=[?#]|$)", "$1"), r"^([^?#]*)\?(?=#|$)|#$", "$1")
    return F.when(rest == "", "/").otherwise(rest)


def with_robots(df: DataFrame, robots: DataFrame, rules: RobotsRules | None = None, now: Column | None = None) -> DataFrame:
    """df (url, ...) with `allowed`, `crawl_delay` and `fetch_error`, from robots (domain, status, body, fetched_at).
    Answers older than the time to live count as none. Few hosts are broadcast by Spark itself; many meet by shuffle."""
    rules = rules or RobotsRules()
    if not rules.respect_robots_txt:
        return df.withColumns({"allowed": F.lit(True), "crawl_delay": F.lit(None).cast("double"), "fetch_error": F.lit(False)})
    fresh = robots if now is None else robots.where(F.col("fetched_at") >= now - F.expr(f"interval {int(rules.cache_ttl_hours)} hours"))
    table = fresh.select(F.col("domain").alias("_host"), F.col("status").isNotNull().alias("_read"), host_rules(rules, F.col("status"), F.col("body")).alias("_r"))
    found = df.withColumn("_host", urls.host(F.col("url"))).join(table, "_host", "left").withColumn("_t", target(F.col("url")))
    first = F.get(F.filter(F.arrays_zip("_r.paths", "_r.allows"), lambda x: F.col("_t").startswith(x["paths"])), F.lit(0))
    # without an answer the default decides
    other = F.lit(True) if rules.default_on_error == "allow" else ~F.col("_t").startswith("/")
    allowed = F.when(F.col("_r").isNull(), other).otherwise(F.coalesce(first["allows"], F.lit(True)))
    return found.select(*df.columns, allowed.alias("allowed"), F.col("_r.crawl_delay").alias("crawl_delay"), (~F.coalesce("_read", F.lit(False))).alias("fetch_error"))


def robots_stats(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("disallowed"), F.count_if("fetch_error").alias("fetch_errors"), F.count_distinct(urls.host(F.col("url"))).alias("domains"))


def stale_hosts(df: DataFrame, robots: DataFrame, rules: RobotsRules | None = None, now: Column | None = None) -> DataFrame:
    """(domain) of the hosts of df (url) without an answer that is still good: what a crawl has to ask."""
    rules = rules or RobotsRules()
    now = F.current_timestamp() if now is None else now
    fresh = robots.where(F.col("fetched_at") >= now - F.expr(f"interval {int(rules.cache_ttl_hours)} hours")).select("domain")
    return df.select(urls.host(F.col("url")).alias("domain")).distinct().join(fresh, "domain", "left_anti")
