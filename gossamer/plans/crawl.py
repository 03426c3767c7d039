"""The crawl: rounds of one plan each, by depth, until no new address is left or the page limit is reached.

A round takes the frontier through validation, duplicate detection against all addresses seen, robots, schedule,
fetch, parsing and storage; the links of its pages are the next frontier. Each round's tables are written, so
its plan never grows. Addresses are seen before they are fetched: a failed one is not tried again. The page limit is
exact: pages count in canonical order (depth, order of the parent, place of the link).
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlConfig, FollowRules
from ..functions import urls
from ..operators import dedup, extract, robots, schedule, sink, validate
from ..schema import CRAWL_STATS
from ..sources import fetch
from ..sources.seeds import seeds as seed_rows
from .tables import discard, materialized

log = logging.getLogger(__name__)


def next_frontier(pages: DataFrame, rules: FollowRules | None = None) -> DataFrame:
    """One row a link of pages (url, depth, page_order, links), but for images, other hosts where those are not followed, and
    children beyond the depth limit."""
    rules = rules or FollowRules()
    one = pages.select(F.col("url").alias("parent_url"), "depth", F.col("page_order").alias("parent_order"), F.explode("links").alias("l"))
    one = one.where(~urls.is_image(F.col("l.url"))).where(F.col("depth") + 1 <= rules.max_depth)
    if rules.same_domain_only:
        one = one.where(urls.same_host(F.col("l.url"), F.col("parent_url")))
    return one.select(F.col("l.url").alias("url"), (F.col("depth") + 1).alias("depth"), "parent_url", "parent_order", F.col("l.pos").alias("link_pos"))


def follow_stats(pages: DataFrame, rules: FollowRules | None = None) -> DataFrame:
    """pages (url, depth, links): links found, reinjected, skipped by depth and by host, and the rate in percent."""
    rules = rules or FollowRules()
    one = pages.select("url", "depth", F.explode("links").alias("l"))
    deep = F.col("depth") + 1 > rules.max_depth
    away = ~deep & ~urls.same_host(F.col("l.url"), F.col("url")) if rules.same_domain_only else F.lit(False)
    got = F.count_if(~deep & ~away)
    return one.agg(F.count("*").alias("found"), got.alias("reinjected"), F.count_if(deep).alias("skipped_depth"), F.count_if(away).alias("skipped_domain"), (100 * got / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def progress(pages: int, rules: FollowRules) -> dict[str, float]:
    return {"pages": pages, "max_pages": rules.max_total_pages, "percent": 100 * pages / rules.max_total_pages if rules.max_total_pages else 0.0}


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers in that order: a range sort, and the counts of the partitions before each."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialized(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    sizes = sorted((r["_part"], r["n"], r["first"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect())
    total, begins = start, []
    for part, n, first in sizes:
        begins.append((part, total - first))
        total += n
    if not begins:
        return ordered.withColumn(name, F.lit(0).cast("long")).drop("_part", "_at")
    shift = df.sparkSession.createDataFrame(begins, "_part int, _shift long")
    return ordered.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


@dataclass
class Crawl:
    spark: SparkSession
    config: CrawlConfig = field(default_factory=CrawlConfig)
    captures: DataFrame | None = None  # without it pages come over HTTP
    robots_table: DataFrame | None = None  # without it and with captures nothing is refused
    seen: dedup.SeenUrls | None = None
    folder: str | None = None  # where pages, links and images go
    at: Column | None = None
    pages_crawled: int = 0
    stopped: bool = False
    complete: bool = False
    rounds: list[tuple] = field(default_factory=list)
    all_pages: DataFrame | None = None
    rejected: DataFrame | None = None
    began: float = 0.0

    def stop(self) -> None:
        """No round begins after this one."""
        self.stopped = True

    def _robots(self, frontier: DataFrame) -> DataFrame:
        if not self.config.robots.respect_robots_txt or (self.robots_table is None and self.captures is not None):
            return frontier.withColumns({"allowed": F.lit(True), "crawl_delay": F.lit(None).cast("double")})
        now = self.at if self.at is not None else F.current_timestamp()
        dated = self.robots_table is None or "fetched_at" in self.robots_table.columns  # rules given without a date do not age
        if self.captures is None and dated:  # hosts without an answer that is still good are asked, once in the time to live
            hosts = frontier.select(urls.host(F.col("url")).alias("domain")) if self.robots_table is None else robots.stale_hosts(frontier, self.robots_table, self.config.robots, now)
            asked = materialized(fetch.robots_over_http(hosts, self.config.robots), "robots")
            if self.robots_table is not None:
                asked = materialized(self.robots_table.select(asked.columns).join(asked.select("domain"), "domain", "left_anti").unionByName(asked), "robots")
            self.robots_table = asked
        return robots.with_robots(frontier, self.robots_table, self.config.robots, now if dated else None).drop("fetch_error")

    def _round(self, frontier: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The addresses that are new, what was parsed of them, and what was lost on the way."""
        c = self.config
        checked = materialized(validate.validated(frontier, c.url_validation), "checked")
        fresh = materialized(dedup.new_urls(checked.where("drop_reason is null").drop("drop_reason"), seen, c.duplicate_detection), "fresh")
        judged = materialized(self._robots(fresh), "judged")
        allowed = judged.where("allowed").drop("allowed")
        timed = schedule.scheduled(allowed.withColumns({"host": urls.host(F.col("url")), "id": F.xxhash64("url"), "arrival_us": F.lit(0).cast("long")}), c.rate_limiting).drop("host", "id", "arrival_us", "wait_us")
        got = fetch.from_captures(timed, self.captures, c.fetch) if self.captures is not None else fetch.over_http(timed, c.fetch)
        got = materialized(got, "fetched")
        parsed = materialized(extract.parsed(fetch.fetched(got).drop("fetch_error"), c.parse, c.link_extraction, c.content_extraction), "parsed")
        lost = [
            checked.where("drop_reason is not null").select("url", "depth", F.lit("validate").alias("stage"), "drop_reason"),
            judged.where("not allowed").select("url", "depth", F.lit("robots").alias("stage"), F.lit("robots").alias("drop_reason")),
            got.where("fetch_error is not null").select("url", "depth", F.lit("fetch").alias("stage"), F.col("fetch_error").alias("drop_reason")),
            parsed.where("drop_reason is not null or error is not null").select("url", "depth", F.lit("parse").alias("stage"), F.coalesce("drop_reason", "error").alias("drop_reason")),
        ]
        rejected = materialized(lost[0].union(lost[1]).union(lost[2]).union(lost[3]), "rejected")
        known = materialized(fresh.select("url"), "known")
        discard(checked, fresh, judged, got)
        return known, parsed, rejected

    def run(self, seed_urls: list[str] | DataFrame, timeout: float | None = None) -> DataFrame:
        """All crawled pages: url, depth, parent_url, page_order, and what was fetched and extracted."""
        c, self.began = self.config, time.monotonic()
        if isinstance(seed_urls, list):
            place = {u: i for i, u in reversed(list(enumerate(seed_urls)))}  # of each seed's first mention
            at = self.spark.createDataFrame(list(place.items()), "url string, link_pos int")
            frontier = seed_rows(self.spark, list(place)).join(F.broadcast(at), "url")
        else:
            frontier = seed_urls.select("url", "depth", "parent_url", F.lit(0).alias("link_pos"))
        frontier = frontier.withColumn("parent_order", F.lit(-1).cast("long"))
        seen = materialized(self.seen.table().select("url"), "seen") if self.seen is not None else None
        while not self.stopped:
            if timeout is not None and time.monotonic() - self.began > timeout:
                break
            frontier = materialized(frontier, "frontier")
            known, parsed, rejected = self._round(frontier, seen)
            seen = known if seen is None else seen.union(known)  # a part a round, each written once
            pages = parsed.where("drop_reason is null and error is null").drop("drop_reason", "error")
            pages = numbered(pages, ["depth", "parent_order", "link_pos", "url"], "page_order", self.pages_crawled)
            limit = c.link_reinjection.max_total_pages if c.link_reinjection.stop_on_max_pages else None
            if limit is not None:
                pages = pages.where(F.col("page_order") < limit)
            pages = materialized(pages, "pages")
            discard(frontier, parsed)
            self.all_pages = pages if self.all_pages is None else self.all_pages.union(pages)
            self.rejected = rejected if self.rejected is None else self.rejected.union(rejected)
            n = pages.count()
            found = pages.agg(F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("n")).first()["n"]
            self.pages_crawled += n
            self.rounds.append((n, found, rejected.where("stage in ('fetch', 'parse')").count()))
            log.info("round %d: %d pages, %d links", len(self.rounds) - 1, n, found)
            if self.folder and n:
                sink.store(pages, self.folder, c.storage, self.at)
            if limit is not None and self.pages_crawled >= limit:
                self.complete = True
                break
            frontier = next_frontier(pages, c.link_reinjection)
            if frontier.isEmpty():
                self.complete = True
                break
        if self.seen is not None and seen is not None:
            self.seen.add(seen)
        return self.all_pages

    def stats(self) -> DataFrame:
        """One row a round: the crawl_stats table."""
        rows = self.spark.createDataFrame([(p, n, e) for p, n, e in self.rounds], "pages_crawled long, links_found long, errors_count long")
        names = [c.split()[0] for c in CRAWL_STATS.split(", ")]
        return rows.withColumn("timestamp", self.at if self.at is not None else F.current_timestamp()).select(*names)

    def status(self) -> dict[str, object]:
        return {"is_running": not (self.stopped or self.complete), "runtime_seconds": time.monotonic() - self.began if self.began else 0.0, "pages_crawled": self.pages_crawled, "rounds": len(self.rounds), "crawl_complete": self.complete, **progress(self.pages_crawled, self.config.link_reinjection)}

    def report(self) -> str:
        lines = [f"{k}: {v}" for k, v in self.status().items()]
        return "\n".join([*lines, *(f"round {i}: {p} pages, {n} links, {e} errors" for i, (p, n, e) in enumerate(self.rounds))])


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """(node, depth) by breadth from starts (node) over edges (src, dst): the recursion of a crawl without its pages."""
    known = level = materialized(starts.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    for d in range(1, max_depth + 1):
        step = edges.join(level.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level = materialized(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        known = known.union(level)  # a part a level, each written once
    if max_nodes is not None:
        known = known.orderBy("depth", "node").limit(max_nodes)
    return known
