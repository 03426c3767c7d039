"""Operator 3: approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected by several random rotations; each curve takes some of the
projected components, cut at quantiles of a bounded sample and shifted at random, and orders
all vectors by their Hilbert key. Spark range-partitions by (curve, key); a vector's rank
follows from counts of the partitions before it. A query reads the vectors within a window of
ranks on every curve, block by block, and what the curves find is merged and reranked
by the exact cosine of the original vectors in double precision. A block meets its queries in
groups of about `QUERIES`, however many there are.

The sample (`SAMPLE` rows by hash) only places the cuts; every row is indexed. The window
is a fraction of the rows: neighbours that are barely nearer than the rest, as in
vectors without structure, need wide ones (see the README for measured recall and work).

Equal vectors are one class with its k + 1 smallest ids, so copies cost one entry and
come back in order of id. Vectors null, zero, or with null or non-finite components take no
part. Vectors of different lengths have no cosine: each length is searched by itself. Repeated ids with
equal vectors are one row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .classes import equal_classes
from .common import durable, read

CURVES, COMPONENTS, LEVELS = 16, 8, 3  # a key has COMPONENTS * LEVELS bits
WINDOW = 0.058  # of all rows, around a query on each curve
LEAST = 256  # rows of a window at least
BLOCK = 4096  # rows that are compared at once
QUERIES = 4096  # queries that a block meets at once
SAMPLE = 4096
EVERY, K = 50, 5


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of cells (rows, components), values below 2**levels."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    bit = 1 << (levels - 1)
    while bit > 1:  # turn every sub-cube into the standard position
        low = bit - 1
        for axis in x:
            set_ = (axis & bit) > 0
            swap = np.where(set_, 0, (x[0] ^ axis) & low)
            turned = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if axis is not x[0]:
                axis ^= swap
            x[0] = turned
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (levels - 1)
    while bit > 1:
        flip = np.where(x[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> level) & 1)
    return key


class Curves:
    def __init__(self, sample: np.ndarray, seed: int = 3) -> None:
        rng, dims = np.random.default_rng(seed), sample.shape[1]
        take, cells = min(COMPONENTS, dims), 1 << LEVELS
        self.rotation, self.cuts = [], []
        for _ in range(CURVES):
            self.rotation.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :take])
            shift = rng.uniform(-0.5, 0.5, take) / cells  # the shift moves the cuts between cells
            at = np.clip(np.arange(1, cells)[:, None] / cells + shift, 0, 1)
            y = sample @ self.rotation[-1]
            self.cuts.append(np.stack([np.quantile(y[:, i], at[:, i]) for i in range(take)]))

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for rotation, cuts in zip(self.rotation, self.cuts):
            y = unit @ rotation
            out.append(hilbert_keys(np.stack([np.searchsorted(c, y[:, i]) for i, c in enumerate(cuts)], 1), LEVELS))
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each row's cosine by itself: equal rows get equal values."""
    return (vectors * query).sum(1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(1)))


ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, every: int = EVERY, k: int = K, window: float = WINDOW, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of rows (vec_id, embedding)."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are equal components; vectors keep their type
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    rows = durable(rows.where(fine).select("vec_id", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(kind)).alias("embedding")).distinct(), "rows")
    out = rows.sparkSession.createDataFrame([], ANSWER)
    for r in sorted(rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).collect()):
        out = out.union(nearest_of(rows.where(F.size("embedding") == r.dims), r.dims, r.n, every, k, window, block, queries))
    return out


def nearest_of(rows: DataFrame, dims: int, total: int, every: int, k: int, window: float, block: int, queries: int) -> DataFrame:
    """nearest() for distinct vectors of one length."""
    spark = rows.sparkSession
    real = np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(max(1, int((1 << 20) * min(1.0, SAMPLE / max(1, total))))))
    sample = [np.array(r.embedding, float) for r in sampled.select("embedding").limit(2 * SAMPLE).collect()] or [np.array(r.embedding, float) for r in rows.select("embedding").limit(1).collect()]
    curves = spark.sparkContext.broadcast(Curves(unit(np.stack(sample))))
    classes = durable(equal_classes(rows, "embedding", "vec_id", k + 1), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding")
    query_class = durable(asked.join(classes.select("embedding", "first"), "embedding").select(F.col("vec_id").alias("query_id"), "first"), "queries")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims)
                raw = pa.array([x.tobytes() for x in v.astype(real)], pa.binary())
                for c, keys in enumerate(curves.value.keys(unit(v))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), batch.column("first"), raw], names=["curve", "key", "first", "vector"])

    n = classes.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.select("first", "embedding").mapInArrow(keyed, "curve int, key long, first long, vector binary").repartitionByRange(parts, "curve", "key", "first").sortWithinPartitions("curve", "key", "first")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("first"), batch.column("vector"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=["curve", "first", "vector", "part", "place"])

    ordered = durable(ordered.mapInArrow(numbered, "curve int, first long, vector binary, part int, place long"), "ordered")
    # every curve has all n classes, so the rank over all curves gives curve * n + rank on the curve
    counts = {r.part: r.n for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(counts), (np.cumsum([counts[p] for p in sorted(counts)]) - [counts[p] for p in sorted(counts)]).tolist()))
    begins = spark.createDataFrame([(p, b) for p, b in before.items()], "part int, before long")
    ranked = ordered.join(F.broadcast(begins), "part").withColumn("rank", F.col("before") + F.col("place") - F.col("curve") * F.lit(n)).drop("part", "place", "before")
    reach = max(LEAST, int(np.ceil(window * n / 2)))
    there = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("int"))
    lo, hi = F.greatest(F.lit(0), F.col("rank") - reach), F.least(F.lit(n - 1), F.col("rank") + reach)
    wanted = ranked.join(query_class.select("first").distinct(), "first", "left_semi").withColumns({"lo": F.least(lo, F.greatest(F.lit(0), hi - 2 * reach)), "hi": F.greatest(hi, F.least(F.lit(n - 1), lo + 2 * reach))})
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block).cast("int"), F.floor(F.col("hi") / block).cast("int"))))
    groups = max(1, -(-int(query_class.select("first").distinct().count() * min(1.0, (2 * reach + block) / max(1, n))) // queries))
    there = there.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = wanted.withColumn("g", F.pmod(F.xxhash64("first", F.lit(3)), F.lit(groups)).cast("int"))
    wanted = wanted.select(*(F.col(c).alias(f"q_{c}") for c in ("curve", "block", "g", "first", "vector", "lo", "hi")))

    def compare(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(queries):
            data = data.sort_values("rank")
            queries = queries.sort_values("q_lo", kind="stable")  # neighbouring windows are compared together
            v = np.frombuffer(b"".join(data["vector"]), real).astype(np.float64).reshape(len(data), dims)
            rank, first = data["rank"].to_numpy(), data["first"].to_numpy()
            q = np.frombuffer(b"".join(queries["q_vector"]), real).astype(np.float64).reshape(len(queries), dims)
            u, slack = unit(v).T.copy(), k + 1 + 16
            a, b = np.searchsorted(rank, queries["q_lo"].to_numpy(), "left"), np.searchsorted(rank, queries["q_hi"].to_numpy(), "right")
            for at in range(0, len(q), 256):  # a matrix product picks, exact cosines decide
                left, right = a[at : at + 256].min(), b[at : at + 256].max()
                rough = unit(q[at : at + 256]) @ u[:, left:right]
                for i, row in enumerate(rough, at):
                    span = row[a[i] - left : max(a[i], b[i]) - left]
                    if not len(span):
                        continue
                    pick = np.argpartition(-span, slack - 1)[:slack] if len(span) > slack else np.arange(len(span))
                    pick += a[i]
                    score = cosines(q[i], v[pick])
                    best = np.lexsort((first[pick], -score))[: k + 1]
                    out.append(pd.DataFrame({"asked": queries["q_first"].iloc[i], "first": first[pick][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "first": [], "score": []}).astype({"asked": "int64", "first": "int64", "score": "float64"})

    found = there.groupBy("curve", "block", "g").cogroup(wanted.groupBy("q_curve", "q_block", "q_g")).applyInPandas(compare, "asked long, first long, score double")
    found = found.groupBy("asked", "first").agg(F.max("score").alias("score"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "first")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).join(classes.select("first", "ids"), "first")
    member = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    members = found.select("asked", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(member)).where(F.col("nth") <= k + 1)
    near = F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score")))
    answer = members.groupBy("asked").agg(near.alias("near"))
    own = query_class.withColumnRenamed("first", "asked").join(answer, "asked")
    others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
