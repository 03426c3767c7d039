"""Operator 10: mixing sources to target weights by entropy balancing.

The rates r of documents, at most `MOST`, minimise the relative entropy to one pass over the corpus, weighted by
tokens, under two sets of token constraints: each source gives its target exactly, and documents of each size
band give about the share that they have in the corpus, so that a mix of sources does not shift the lengths (a quadratic
penalty, as the caps can make both impossible). The convex dual has a multiplier a source and one a band,
r = min(MOST, exp(source + band)). Newton's iterations are distributed: each sums gradient and curvature over the
table of source and band masses, the bands' system (sources eliminated) is solved on the driver, sources move each
by their own step, and a line search on the dual bounds it. They end when the Newton decrement, twice
the dual gap to second order, is below `GAP` of all tokens.

Rates are rounded into whole copies: in each source, sizes from large to small take the floor of the
rate and as many further copies as keep the running total at its target, so what is left
over at the end is about half of a small document. Only the histogram (source, size)
takes part; documents find their copies by their hashed rank within (source, size, salt).

Null sources form a source of their own, last. Null texts have size 0, target 0 if a
source has no words. Repeated rows are mixed each. Texts of any length count whole; extra columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, merged, read

SALTS = 64
MOST = 3  # times its size that a source or document may give
BANDS = 8  # of sizes: 1 to 3 words, 4 to 15 and so on
LOOSE = 0.1  # weight of the bands' penalty; 0 would hold them exactly
GAP = 1e-12
STEPS = [0.5**i for i in range(8)]


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sources: DataFrame, share: float = 1.0, most: int = MOST) -> DataFrame:
    """sources (weight, source_size) with `target`: shares by weight, cut at `most` times the size, the excess reshared
    until none is above. Each round is two sums; at least one more source is cut in each, and rounds end with the last."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    held = F.lit(None).cast("double")
    level, left = None, share * total
    while True:
        open_ = sources if level is None else sources.where(cap > F.col("weight") * F.lit(level))
        shut = 0.0 if level is None else sources.where(cap <= F.col("weight") * F.lit(level)).agg(F.sum(cap)).first()[0] or 0.0
        weight = open_.agg(F.sum("weight")).first()[0]
        if not weight:
            break
        risen = (left - shut) / weight
        if level is not None and risen <= level * (1 + 1e-12):
            break
        level = risen
    held = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", held)


def band(size: Column) -> Column:
    return F.least(F.lit(BANDS - 1), F.floor(F.log2(F.greatest(size, F.lit(1))) / 2)).cast("int")


def _rate(x: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(x, F.lit(2.0))))


def rates(x: np.ndarray) -> np.ndarray:
    return np.minimum(MOST, np.exp(np.minimum(x, 2.0)))


def dual(x: np.ndarray, mu: np.ndarray, mass: np.ndarray, target: np.ndarray) -> float:
    """The sources' part of the dual: the rate's integral is exp up to the cap and straight beyond."""
    y, top = x[:, None] + mu, math.log(MOST)
    area = np.where(y <= top, np.exp(np.minimum(y, top)), MOST * (1 + y - top))
    return float(x @ target - (mass * area).sum())


def newton_terms(x: np.ndarray, mu: np.ndarray, mass: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each source gives by band, its share of the curvature by band, its gradient, and its own curvature."""
    given = mass * rates(x[:, None] + mu)
    bend = np.where(x[:, None] + mu < math.log(MOST), given, 0.0)
    return given, bend, target - given.sum(1), np.maximum(bend.sum(1), 1e-6 * given.sum(1))


def source_step(x: np.ndarray, mu: np.ndarray, mass: np.ndarray, target: np.ndarray, move: np.ndarray) -> np.ndarray:
    """A source's own Newton step, given that of the bands."""
    _, bend, g, h = newton_terms(x, mu, mass, target)
    return np.clip((g - bend @ move) / h, -2.0, 2.0)


MASSES = [f"m{k}" for k in range(BANDS)]


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    return number("x"), np.stack([number(c) for c in MASSES], 1), number("target")


def summed(table: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all sources of `of` (x, masses, target), which gives a vector for a batch; a row a part of the table comes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(*columns_of(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return np.sum([np.frombuffer(r.sums) for r in table.select("x", "target", *MASSES).mapInArrow(run, "sums binary").collect()], axis=0)


def balanced(sources: DataFrame, loose: float = LOOSE, gap: float = GAP, most_rounds: int = 100) -> tuple[DataFrame, np.ndarray]:
    """sources (source, target, source_size, m0, m1, ... by band) with the multiplier `x` (null: the target is 0; a source whose target
    is all it can give has an endless one), and the bands' multipliers, at the dual's optimum."""
    full = F.col("target") >= F.col("source_size") * F.lit(MOST * (1 - 1e-9))
    start = F.when(F.col("target") <= 0, F.lit(None)).when(full, F.lit(float("inf"))).otherwise(F.log(F.col("target") / F.col("source_size")))
    n = sources.count()
    every = durable(sources.withColumn("x", start.cast("double")), "dual", n)
    open_ = now = durable(every.where("x < double('inf')").select("source", "x", "target", *MASSES), "open", n)
    whole = every.agg(F.sum("target").alias("t"), *(F.sum(c).alias(c) for c in MASSES), *(F.sum(F.when(F.col("x") == float("inf"), F.col(c))).alias(f"shut_{c}") for c in MASSES)).first()
    held, total = np.array([float(whole[c] or 0) for c in MASSES]), whole.t or 0.0
    mu, live = np.zeros(BANDS), np.flatnonzero(held)
    if not total or open_.isEmpty():
        return every, mu
    aim = held / held.sum() * total
    fixed = MOST * np.array([float(whole[f"shut_{c}"] or 0) for c in MASSES])
    side = lambda u: float(u @ (aim - fixed) - loose / 2 * (aim * u * u).sum())
    for _ in range(most_rounds):

        def terms(x: np.ndarray, mass: np.ndarray, target: np.ndarray, mu: np.ndarray = mu) -> np.ndarray:
            given, bend, g, h = newton_terms(x, mu, mass, target)
            return np.concatenate([[g @ (g / h), dual(x, mu, mass, target)], given.sum(0), bend.sum(0), bend.T @ (g / h), (bend.T @ (bend / h[:, None])).ravel()])

        sums = summed(now, terms, 2 + 3 * BANDS + BANDS**2)
        given, bend, across = sums[2:].reshape(-1, BANDS)[:3]
        grad = aim - fixed - given - loose * aim * mu - across
        curve = np.diag(bend + loose * aim) - sums[2 + 3 * BANDS :].reshape(BANDS, BANDS)
        move = np.zeros(BANDS)
        move[live] = np.linalg.solve(curve[np.ix_(live, live)] + 1e-12 * total * np.eye(len(live)), grad[live])
        decrement = float(sums[0] + move @ grad)
        if decrement <= gap * total:
            break
        t = 1.0
        if decrement > 1e-8 * total:  # below, the dual's own rounding hides its rise

            def tried(x: np.ndarray, mass: np.ndarray, target: np.ndarray, mu: np.ndarray = mu, move: np.ndarray = move) -> np.ndarray:
                step = source_step(x, mu, mass, target, move)
                return np.array([dual(x + t * step, mu + t * move, mass, target) for t in STEPS])

            rise = summed(now, tried, len(STEPS)) + np.array([side(mu + t * move) for t in STEPS]) - sums[1] - side(mu)
            t = next((t for t, up in zip(STEPS, rise) if up >= 1e-4 * t * decrement), STEPS[-1])

        def moved(batches: Iterator[pa.RecordBatch], mu: np.ndarray = mu, move: np.ndarray = move, t: float = t) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, mass, target = columns_of(batch)
                yield batch.set_column(batch.schema.get_field_index("x"), "x", pa.array(x + t * source_step(x, mu, mass, target, move)))

        before, now = now, durable(now.mapInArrow(moved, now.schema), "open", n)
        discard(before)
        mu = mu + t * move
    found = every.drop("x").join(now.select("source", "x"), "source", "left")
    return found.withColumn("x", F.when(F.col("target") <= 0, F.lit(None)).when(full, F.lit(float("inf"))).otherwise(F.col("x"))), mu


def extra_copies(group: pd.DataFrame) -> pd.DataFrame:
    """For one source's histogram: how many documents of each size get one copy above the floor of their rate."""
    group = group.sort_values("size", ascending=False)
    wanted, taken, out = 0.0, 0, []
    for size, n, rate, least in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), group["least"].tolist()):
        wanted += size * n * rate
        taken += size * n * least
        more = max(0, min(n, round((wanted - taken) / size))) if size and least < MOST else 0
        taken += more * size
        out.append(more)
    return pd.DataFrame({"source": group["source"], "size": group["size"], "extra": out})


def mix(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """One row a row of docs (doc_id, text, source) with size, source_size, target, rate, copies, taken."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # sources that are null or empty stay apart
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    sized = durable(merged(docs).select("doc_id", n_words(F.col("text")).alias("size"), key.alias("source"), salt.alias("salt")), "sizes")
    strata = durable(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "strata")
    histogram = strata.groupBy("source", "size").agg(F.sum("n").alias("n"))
    words = F.col("size") * F.col("n")
    masses = histogram.groupBy("source").agg(F.sum(words).alias("source_size"), *(F.sum(F.when(band(F.col("size")) == k, words).otherwise(0)).alias(f"m{k}") for k in range(BANDS)))
    order = F.row_number().over(Window.orderBy(F.col("source") == "", "source"))
    weighted = durable(masses.withColumn("weight", ((order - 1) % 3 + 1).cast("double")), "sources")  # one part, as the numbering is
    rated, mu = balanced(targets(weighted, share))
    rated = rated.select("source", "source_size", "target", "x")
    tilt = F.element_at(F.array(*(F.lit(float(v)) for v in mu)), band(F.col("size")) + 1)
    rate = F.coalesce(_rate(F.col("x") + tilt), F.lit(0.0))
    # a rate within rounding error of a whole number is that number
    histogram = histogram.join(rated, "source").withColumn("rate", rate).withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))).withColumn("least", F.floor("rate"))
    histogram = durable(histogram.drop("x"), "rates")
    extra = histogram.select("source", "size", "n", "rate", "least").groupBy("source").applyInPandas(extra_copies, "source string, size long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share_out = (
        strata.withColumn("before", before).join(extra, ["source", "size"]).join(histogram.drop("n"), ["source", "size"])
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before")))).drop("n", "before")
    )
    nth = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id"))
    out = sized.withColumn("nth", nth).join(share_out, ["source", "size", "salt"])
    copies = (F.col("least") + (F.col("nth") <= F.col("extra")).cast("long")).alias("copies")
    return out.select("doc_id", "size", "source_size", "target", "rate", copies).withColumn("taken", F.col("size") * F.col("copies"))


def op10_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
