"""Operator 9: exact top-k search in Hamming space by incremental multi-index hashing.

Vectors become 64-bit codes (the signs of their components). Codes are cut into segments,
each with its own table. A query looks up all segment values within a radius that grows
one segment at a time; once segments 0..j are searched to radius r and the rest to r - 1,
every code within m * r + j is found (else each segment would differ by more), so the
search ends as soon as the kth verified distance is within that, and the result is exact.

Equal codes are one class with its k + 1 smallest ids, so a code that a third of all rows
share costs one entry. Classes lie in blocks of bounded size; each block searches for every
query code (equal ones once) and gives its best, which are merged. Queries are rows whose
id is divisible by `every`; a query's own row is no answer; ties go to smaller ids.

Vectors that are null, empty, of other than 64 components or with null or non-finite
components take no part. Repeated rows of an id and code are one; an id with several codes has
several, and each answers. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .classes import equal_classes
from .common import durable, read

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
BLOCK = 1 << 20  # classes of a block; queries of a block
EVERY, K = 100, 10


def sign_code(embedding: Column) -> Column:
    """The signs of 64 components as a long, the first component the highest bit; null for vectors that take no part."""
    fine = (F.size(embedding) == BITS) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    code = F.aggregate(embedding, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return F.when(fine, code)


@lru_cache(maxsize=None)
def masks(radius: int) -> np.ndarray:
    """All segment values with `radius` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], np.int64)


class MultiIndex:
    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.astype(np.uint64)
        self.order, self.begin = [], []
        for s in range(SEGMENTS):
            value = self.segment(self.codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.begin.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))]))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, query: int, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest codes, ties to smaller rank; exact."""
        q, k = np.uint64(query), min(k, len(self.codes))
        own = [int(self.segment(np.array([q]), s)[0]) for s in range(SEGMENTS)]
        found, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                value = masks(radius) ^ own[s]
                a, n = self.begin[s][value], self.begin[s][value + 1] - self.begin[s][value]
                some = n > 0
                a, n = a[some], n[some]
                if len(n):
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    new = self.order[s][at]
                    found, first = np.unique(np.concatenate([found, new]), return_index=True)
                    known = np.concatenate([distance, np.bitwise_count(self.codes[new] ^ q)])
                    distance = known[first]
                    if len(found) > 4 * k:  # what is beyond the kth best can't come back
                        keep = np.lexsort((rank[found], distance))[: k]
                        keep.sort()
                        found, distance = found[keep], distance[keep]
                if len(found) >= k and np.partition(distance, k - 1)[k - 1] <= SEGMENTS * radius + s:
                    best = np.lexsort((rank[found], distance))[:k]
                    return found[best], distance[best]
        best = np.lexsort((rank[found], distance))[:k]
        return found[best], distance[best]


def nearest(rows: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, distance of rows (vec_id, code)."""
    rows = durable(rows.where("code is not null").select("vec_id", "code").distinct(), "codes")
    classes = durable(equal_classes(rows, "code", "vec_id", k + 1), "classes")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    wanted = queries.select("code").distinct()
    n, m = max(1, -(-classes.count() // block)), max(1, -(-wanted.count() // block))
    n = max(n, min(8, classes.count() // 4096))  # smaller blocks where there are few, so that cores share the work
    part = lambda parts, seed: F.pmod(F.xxhash64("code", F.lit(seed)), F.lit(parts)).cast("int")
    every_block = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = classes.select("code", "first", part(n, 1).alias("b"), every_block(m).alias("q"))
    right = wanted.select("code", every_block(n).alias("b"), part(m, 2).alias("q"))

    def search(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        codes, rank, wanted = there["code"].to_numpy(np.int64), there["first"].to_numpy(np.int64), asked["code"].to_numpy(np.int64)
        index = MultiIndex(codes.view(np.uint64))
        got = [index.search(int(q), k + 1, rank) for q in wanted.view(np.uint64)] if len(codes) else []
        at, d = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"asked": np.repeat(wanted, [len(a) for a, _ in got] or 0), "code": codes[at], "first": rank[at], "distance": d.astype(np.int32)})

    # a count of its own, so that small pairs of blocks stay apart
    pairs = max(n * m, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(pairs, "b", "q"), right.repartition(pairs, "b", "q")
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, "asked long, code long, first long, distance int")
    best = Window.partitionBy("asked").orderBy("distance", "first")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).join(classes.select("code", "ids"), "code")
    member = Window.partitionBy("asked").orderBy("distance", "vec_id")
    members = found.select("asked", "distance", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(member)).where(F.col("nth") <= k + 1)
    answer = members.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("near"))
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("asked")).join(answer, "asked")
    others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.distance").alias("distance"))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows.select("vec_id", sign_code(F.col("embedding")).alias("code")))


ORACLE = """
with codes as (
    select distinct vec_id, cast(list_transform(embedding, lambda x: x > 0) as varchar) as code, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as bits
    from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), pairs as (
    select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2]))) as integer) as distance
    from codes q join codes c on q.vec_id <> c.vec_id
    where q.vec_id % 100 = 0
), ranked as (
    select *, cast(row_number() over (partition by query_id order by distance, vec_id) as integer) as rank from pairs
)
select query_id, rank, vec_id, distance from ranked where rank <= 10
"""
