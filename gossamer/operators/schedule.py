"""Politeness schedules: release times from arrivals, by running sums and maxima instead of sleeping.

Times are whole microseconds. Requests of a host are in order of (arrival, id). Rows are range-partitioned in that order,
so a host with very many requests, even all at one time, lies in several parts: running values are formed in each part and
joined to those of the parts before it, and no task holds a whole host. The limiter over all hosts works the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RateRules
from ..plans.tables import materialized


def running(df: DataFrame, keys: list[str], order: list[str], out: str, value: Column, kind: str, bucket: str) -> DataFrame:
    """df with the running sum or maximum of value within keys, the row included; order must not fall from bucket to bucket."""
    f = {"sum": F.sum, "max": F.max}[kind]
    near = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, bucket).agg(f(value).alias("_all"))
    before = totals.withColumn("_before", f("_all").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).drop("_all")
    joined = df.withColumn(out, f(value).over(near)).join(before, [*keys, bucket])
    both = F.col(out) + F.coalesce("_before", F.lit(0)) if kind == "sum" else F.greatest(out, "_before")
    return joined.withColumn(out, both).drop("_before")


def _bucketed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """df in parts of at most a partition: the parts of a key are in its rows' order. Written, so that parts stay as they are."""
    order = [*keys, "arrival_us", "id"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(df.repartitionByRange(parts, *order).withColumn("_bucket", F.spark_partition_id()), "parts"), "_bucket"


def fixed_delay(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys, id, arrival_us, delay_us) with release_us: each at least its delay after the release before; the first is free."""
    df, bucket = _bucketed(df, keys)
    order = ["arrival_us", "id"]
    df = running(df, keys, order, "_i", F.lit(1), "sum", bucket)
    df = running(df, keys, order, "_s", F.when(F.col("_i") == 1, 0).otherwise(F.col("delay_us")), "sum", bucket)
    df = running(df, keys, order, "_m", F.col("arrival_us") - F.col("_s"), "max", bucket)
    return df.withColumn("release_us", F.col("_s") + F.col("_m")).drop("_i", "_s", "_m", "_bucket")


def token_bucket(df: DataFrame, keys: list[str], burst: int) -> DataFrame:
    """A full bucket of `burst` tokens, one back each delay; a host's delay is that of its first request, and 0 never waits."""
    df, bucket = _bucketed(df, keys)
    order = ["arrival_us", "id"]
    first = df.groupBy(*keys).agg(F.min_by("delay_us", F.struct(*order)).alias("_d"))
    df = running(df.join(first, keys), keys, order, "_i", F.lit(1), "sum", bucket)
    df = running(df, keys, order, "_m", F.col("arrival_us") - F.col("_d") * (F.col("_i") - 1), "max", bucket)
    # the theoretical arrival after the one before; for the first there is none
    df = df.withColumn("_tat", F.col("_d") * F.col("_i") + F.col("_m"))
    earlier = F.col("_d") * (F.col("_i") - 1)
    at = F.greatest(F.col("arrival_us"), earlier + F.col("_past") - F.lit(burst - 1) * F.col("_d"))
    lagged = F.lag("_m").over(Window.partitionBy(*keys, bucket).orderBy(*order))
    last = df.groupBy(*keys, bucket).agg(F.max("_m").alias("_l"))
    last = last.withColumn("_l", F.lag("_l").over(Window.partitionBy(*keys).orderBy(bucket)))
    df = df.withColumn("_p", lagged).join(last, [*keys, bucket]).withColumn("_past", F.coalesce("_p", "_l")).drop("_p", "_l")
    return df.withColumn("release_us", F.when(F.col("_past").isNull() | (F.col("_d") == 0), F.col("arrival_us")).otherwise(at)).drop("_d", "_i", "_m", "_tat", "_past", "_bucket")


def sliding_window(df: DataFrame, keys: list[str], most: int, span: Column) -> DataFrame:
    """At most `most` releases in any span: each at least a span after the one `most` before it."""
    df, bucket = _bucketed(df, keys)
    order = ["arrival_us", "id"]
    df = df.withColumn("_w", span)
    df = running(df, keys, order, "_i", F.lit(1), "sum", bucket)
    df = df.withColumn("_c", F.col("_i") % most).withColumn("_k", F.floor((F.col("_i") - 1) / most).cast("long"))
    df = running(df, [*keys, "_c"], order, "_m", F.col("arrival_us") - F.col("_k") * F.col("_w"), "max", bucket)
    return df.withColumn("release_us", F.col("_k") * F.col("_w") + F.col("_m")).drop("_w", "_i", "_c", "_k", "_m", "_bucket")


def global_limit(df: DataFrame, per_second: int, span_us: int = 1_000_000) -> DataFrame:
    """At most so many releases a second (or other span) over all hosts."""
    keyed = df.withColumn("_every", F.lit(0))
    return sliding_window(keyed, ["_every"], per_second, F.lit(span_us)).drop("_every")


def scheduled(df: DataFrame, rules: RateRules | None = None) -> DataFrame:
    """df (host, id, arrival_us, crawl_delay) with release_us and wait_us: the limit over all hosts first, then the host's."""
    rules = rules or RateRules()
    default = F.lit(int(rules.default_delay_seconds * 1_000_000)).cast("long")
    own = F.coalesce((F.col("crawl_delay") * 1_000_000).cast("long"), default) if rules.respect_crawl_delay and "crawl_delay" in df.columns else default
    df = df.withColumn("delay_us", own).withColumn("_came", F.col("arrival_us"))
    if rules.global_rate_limit:
        df = global_limit(df, rules.global_rate_limit).withColumn("arrival_us", F.col("release_us")).drop("release_us")
    if rules.strategy == "fixed":
        df = fixed_delay(df, ["host"])
    elif rules.strategy == "token_bucket":
        df = token_bucket(df, ["host"], rules.burst_size)
    elif rules.strategy == "sliding_window":
        df = sliding_window(df, ["host"], rules.burst_size, default * rules.burst_size)
    else:
        raise ValueError(f"unknown strategy {rules.strategy!r}")
    return df.withColumn("arrival_us", F.col("_came")).withColumn("wait_us", F.col("release_us") - F.col("_came")).drop("_came", "delay_us")


def rate_stats(df: DataFrame) -> DataFrame:
    late = F.col("wait_us") > 10_000
    return df.agg(F.count("*").alias("requests"), F.count_if(late).alias("delayed"), F.sum("wait_us").alias("total_wait_us"), F.avg("wait_us").alias("mean_wait_us"), F.count_distinct("host").alias("hosts"))


def host_stats(df: DataFrame) -> DataFrame:
    """Each host's requests, waits, last release, and releases in the second before it (its current rate)."""
    late = F.col("wait_us") > 10_000
    last = df.groupBy("host").agg(F.count("*").alias("requests"), F.count_if(late).alias("delayed"), F.sum("wait_us").alias("total_wait_us"), F.max("release_us").alias("last_release_us"))
    recent = df.join(last.select("host", "last_release_us"), "host").where(F.col("release_us") > F.col("last_release_us") - 1_000_000)
    return last.join(recent.groupBy("host").agg(F.count("*").alias("current_rate")), "host")
