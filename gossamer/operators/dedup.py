"""Duplicate detection: the first sighting of a key stays, in a run and across runs.

"First" is by (depth, parent_order, link_pos) where those columns are there, then by url. Methods: `set` and
`database` are exact, `bloom` drops a new key with the configured probability, its filter is sized for the
configured capacity, or for the seen keys where they are more. A filter beyond `SENT_BYTES` is cut into shards that rows meet by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DedupRules

ORDER = ("depth", "parent_order", "link_pos")
SENT_BYTES = 32 << 20  # of a filter that every task gets; a larger one is cut into shards
SHARD_KEYS = 1_000_000


def key(url: Column, case_sensitive: bool = False) -> Column:
    return url if case_sensitive else F.lower(url)


def first_seen(df: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """df with `is_first`. A limit runs before the shuffle, so a key that all rows share costs a row a task."""
    order = [F.col(c) for c in ORDER if c in df.columns] + [F.col("url")]
    return df.withColumn("is_first", F.row_number().over(Window.partitionBy(key(F.col("url"), case_sensitive)).orderBy(*order)) == 1)


def new_urls(df: DataFrame, seen: DataFrame | None = None, rules: DedupRules | None = None) -> DataFrame:
    """The first row of each key that `seen` (url) has not."""
    rules = rules or DedupRules()
    order = [F.col(c) for c in ORDER if c in df.columns] + [F.col("url")]
    keyed = df.withColumn("_key", key(F.col("url"), rules.case_sensitive))
    kept = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_nth = 1").drop("_nth")
    if seen is None:
        return kept.drop("_key")
    if rules.method in ("set", "database"):
        known = seen.select(key(F.col("url"), rules.case_sensitive).alias("_key")).distinct()
        return kept.join(known, "_key", "left_anti").drop("_key")
    if rules.method == "bloom":
        keys = seen.select(key(F.col("url"), rules.case_sensitive).alias("key")).distinct()
        rules = replace(rules, bloom_capacity=max(rules.bloom_capacity, keys.count()))
        if bloom_shape(rules.bloom_capacity, rules.bloom_error_rate)[0] > 8 * SENT_BYTES:
            return kept.join(sharded_hits(kept.select("_key"), keys, rules), "_key", "left_anti").drop("_key")
        bits = bloom_filter(keys, rules.bloom_capacity, rules.bloom_error_rate)
        return kept.where(~might_contain(F.col("_key"), bits, rules)).drop("_key")
    raise ValueError(f"unknown method {rules.method!r}")


def bloom_shape(capacity: int, error_rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many keys at that rate of false positives."""
    bits = max(8, math.ceil(-capacity * math.log(error_rate) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / capacity * math.log(2)))


def _places(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64) for i in range(hashes)]


def bloom_filter(keys: DataFrame, capacity: int, error_rate: float) -> bytes:
    """A filter of all keys: each task sets its bits, which are or-ed. Its size follows from the capacity alone."""
    bits, hashes = bloom_shape(capacity, error_rate)
    size = (bits + 7) // 8

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = np.zeros(size, np.uint8)
        for f in frames:
            for at in _places(f["a"].to_numpy(np.int64), f["b"].to_numpy(np.int64), bits, hashes):
                np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for at in range(0, size, 1 << 20):  # pieces, so that no row is large
            yield pd.DataFrame({"at": [at], "field": [field[at : at + (1 << 20)].tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": group["at"].iloc[:1], "field": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["field"]]).tobytes()]})

    hashed = keys.select(F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b"))
    rows = hashed.mapInPandas(part, "at long, field binary").groupBy("at").applyInPandas(merge, "at long, field binary").orderBy("at").collect()
    return b"".join(bytes(r.field) for r in rows) or bytes(size)


def might_contain(column: Column, field: bytes, rules: DedupRules) -> Column:
    bits, hashes = bloom_shape(rules.bloom_capacity, rules.bloom_error_rate)

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        f = np.frombuffer(field, np.uint8)
        out = np.ones(len(h1), bool)
        for at in _places(h1.to_numpy(np.int64), h2.to_numpy(np.int64), bits, hashes):
            out &= (f[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    return test(F.xxhash64(column), F.xxhash64(column, F.lit(1)))


def sharded_hits(asked: DataFrame, keys: DataFrame, rules: DedupRules, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(_key) of those asked that a filter of all keys may contain. Keys are dealt to shards by a hash, each shard has a
    filter of its own at the configured rate, and what is asked meets its shard's: no task sees more than a shard."""
    shards = -(-rules.bloom_capacity // shard_keys)
    bits, hashes = bloom_shape(shard_keys + 10 * math.isqrt(shard_keys), rules.bloom_error_rate)  # shards are only about equal
    hashed = lambda c: [F.pmod(F.xxhash64(c, F.lit(2)), F.lit(shards)).alias("shard"), F.xxhash64(c).alias("a"), F.xxhash64(c, F.lit(1)).alias("b")]

    def held(there: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        field, out = np.zeros((bits + 7) // 8, np.uint8), np.ones(len(wanted), bool)
        for at in _places(there["a"].to_numpy(np.int64), there["b"].to_numpy(np.int64), bits, hashes):
            np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for at in _places(wanted["a"].to_numpy(np.int64), wanted["b"].to_numpy(np.int64), bits, hashes):
            out &= (field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return wanted.loc[out, ["_key"]]

    there, wanted = keys.select(*hashed("key")), asked.select("_key", *hashed("_key"))
    return there.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInPandas(held, "_key string")


class SeenUrls:
    """Seen keys kept as a Parquet table (url, first_seen) from run to run."""

    def __init__(self, spark, path: str, case_sensitive: bool = False) -> None:
        self.spark, self.path, self.case_sensitive = spark, path, case_sensitive

    def table(self) -> DataFrame:
        from ..schema import SEEN_URLS

        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return self.spark.createDataFrame([], SEEN_URLS)
        return self.spark.read.schema(SEEN_URLS).parquet(self.path)

    def contains(self, urls: DataFrame) -> DataFrame:
        """urls (url) with `seen`."""
        known = self.table().select(F.col("url").alias("_key")).distinct().withColumn("seen", F.lit(True))
        return urls.withColumn("_key", key(F.col("url"), self.case_sensitive)).join(known, "_key", "left").withColumn("seen", F.coalesce("seen", F.lit(False))).drop("_key")

    def add(self, urls: DataFrame, at: Column | None = None) -> None:
        rows = urls.select(key(F.col("url"), self.case_sensitive).alias("url")).distinct().join(self.table().select("url"), "url", "left_anti")
        rows.select("url", (at if at is not None else F.current_timestamp()).alias("first_seen")).write.mode("append").parquet(self.path)

    def count(self) -> int:
        return self.table().count()

    def clear(self) -> None:
        self.spark.createDataFrame([], "url string, first_seen timestamp").write.mode("overwrite").parquet(self.path)


def dedup_stats(df: DataFrame, rules: DedupRules | None = None) -> DataFrame:
    """unique, duplicate, total_checked, method of the rows of df (url)."""
    rules = rules or DedupRules()
    unique = F.count_distinct(key(F.col("url"), rules.case_sensitive))
    return df.agg(unique.alias("unique_urls"), (F.count("url") - unique).alias("duplicate_urls"), F.count("url").alias("total_checked")).withColumn("method", F.lit(rules.method))
