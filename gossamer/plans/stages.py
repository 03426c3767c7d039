"""Stages as functions on DataFrames, pipelines of them, and their figures as tables.

A stage takes rows and gives rows with `drop_reason`; the pipeline keeps rows without one for the next stage and counts
rows in, out and in error for each. Custom stages register by name.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

StageFn = Callable[[DataFrame], DataFrame]
STAGES: dict[str, StageFn] = {}
STATS = "name string, processed long, rows_out long, dropped long, errors long, runtime_seconds double, is_running boolean"


def register_stage(name: str, fn: StageFn) -> StageFn:
    STAGES[name] = fn
    return fn


def upper_case(df: DataFrame) -> DataFrame:
    """A sample stage: strings in upper case, other columns as they are."""
    return df.select(*(F.upper(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


register_stage("upper_case", upper_case)


def row_stage(fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str) -> StageFn:
    """A stage of a function on records: None drops a row ("dropped"), a record replaces it, and one that raises is dropped as an
    error with the message in `stage_error`; the job goes on. schema: columns of the records."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.astype(object).where(f.notna(), None).to_dict("records"):
                try:
                    got = fn(r)
                    rows.append((*((got or {}).get(n) for n in names), None if got is not None else "dropped", None))
                except Exception as e:  # the row's, not the job's
                    rows.append((*(None,) * len(names), "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*names, "drop_reason", "stage_error"], dtype=object)

    return lambda df: df.mapInPandas(run, f"{schema}, drop_reason string, stage_error string")


@dataclass
class Stage:
    name: str
    fn: StageFn
    processed: int = 0
    rows_out: int = 0
    errors: int = 0
    runtime: float = 0.0

    def reset_stats(self) -> None:
        self.processed, self.rows_out, self.errors, self.runtime = 0, 0, 0, 0.0

    def row(self, running: bool = False) -> tuple:
        return (self.name, self.processed, self.rows_out, self.processed - self.rows_out - self.errors, self.errors, self.runtime, running)


@dataclass
class Pipeline:
    """Stages in order. run() makes one plan of them all; run_counted() writes between them to give each its figures."""

    stages: list[Stage] = field(default_factory=list)
    stopped: bool = False
    paused: bool = False

    def add_stage(self, stage: Stage | str, fn: StageFn | None = None) -> Pipeline:
        self.stages.append(stage if isinstance(stage, Stage) else Stage(stage, fn or STAGES[stage]))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        step = lambda d, s: _kept(d.transform(s.fn))
        return functools.reduce(step, self.stages, df)

    def run_counted(self, df: DataFrame, folder: str | None = None) -> DataFrame:
        """The stages one by one. With a folder each writes there, and a run that was broken off takes up behind the last stage that
        had finished; stages that are taken from there count nothing."""
        from .tables import exists, materialized

        for k, s in enumerate(self.stages):
            while self.paused and not self.stopped:
                time.sleep(0.1)
            if self.stopped:
                break
            path = folder and f"{folder}/{k}-{s.name}"
            if path and exists(df.sparkSession, f"{path}/_SUCCESS"):
                df = _kept(df.sparkSession.read.parquet(path))
                continue
            began, seen = time.monotonic(), Observation()
            out = materialized(s.fn(df.observe(seen, F.count("*").alias("n"))), "stage", path)
            df = _kept(out)
            s.processed += seen.get["n"]
            s.rows_out += df.count()
            s.errors += out.where("drop_reason = 'error'").count() if "drop_reason" in out.columns else 0
            s.runtime += time.monotonic() - began
        return df

    def stop(self) -> None:
        self.stopped = True

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def stage_stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([s.row() for s in self.stages], STATS)

    def summary(self, spark: SparkSession) -> str:
        """One line a stage, and the whole."""
        rows = throughput(self.stage_stats(spark)).collect()
        total = overall(self.stage_stats(spark)).first()
        lines = [f"{r.name}: in {r.processed}, out {r.rows_out}, dropped {r.dropped}, errors {r.errors}, {r.throughput:.2f} rows/s" for r in rows]
        return "\n".join([*lines, f"all: {total.processed} processed, {total.errors} errors, success {100 * total.success_rate:.2f} %"])

    def __enter__(self) -> Pipeline:
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()


def _kept(df: DataFrame) -> DataFrame:
    return df.where("drop_reason is null").drop("drop_reason", "stage_error") if "drop_reason" in df.columns else df


def throughput(stats: DataFrame) -> DataFrame:
    """stats with rows a second and seconds a row, 0 where there is nothing."""
    rate = F.coalesce(F.col("processed") / F.nullif(F.col("runtime_seconds"), F.lit(0.0)), F.lit(0.0))
    mean = F.coalesce(F.col("runtime_seconds") / F.nullif(F.col("processed"), F.lit(0)), F.lit(0.0))
    return stats.withColumns({"throughput": rate, "mean_seconds": mean})


def overall(stats: DataFrame) -> DataFrame:
    done, bad = F.sum("processed"), F.sum("errors")
    return stats.agg(
        done.alias("processed"), bad.alias("errors"), F.sum("dropped").alias("dropped"),
        F.coalesce((done - bad) / F.nullif(done, F.lit(0)), F.lit(0.0)).alias("success_rate"),
        F.coalesce(done / F.nullif(F.max("runtime_seconds"), F.lit(0.0)), F.lit(0.0)).alias("throughput"),
    )


def bottlenecks(stats: DataFrame, most_errors: float = 0.1) -> DataFrame:
    """The slowest stage by seconds a row, and whether each stage errs too often."""
    timed = throughput(stats)
    slowest = timed.agg(F.max_by("name", "mean_seconds").alias("slowest"))
    high: Column = F.coalesce(F.col("errors") / F.nullif(F.col("processed"), F.lit(0)), F.lit(0.0)) > most_errors
    return timed.crossJoin(F.broadcast(slowest)).select("name", "mean_seconds", (F.col("name") == F.col("slowest")).alias("is_slowest"), high.alias("high_errors"))


def add_error(errors: Column, text: str, stage: str = "unknown") -> Column:
    return F.array_append(F.coalesce(errors, F.array().cast("array<string>")), F.lit(f"[{stage}] {text}"))


def add_timing(timings: Column, stage: str, seconds: Column) -> Column:
    rest = F.map_filter(F.coalesce(timings, F.create_map().cast("map<string,double>")), lambda k, _: k != stage)
    return F.map_concat(rest, F.create_map(F.lit(stage), seconds.cast("double")))


def total_time(timings: Column) -> Column:
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + x)


def has_errors(errors: Column) -> Column:
    return F.coalesce(F.size(errors) > 0, F.lit(False))


RECORD_KEYS = (
    "url", "depth", "parent_url", "title", "text_content", "meta_description", "meta_keywords", "links", "images", "status_code",
    "content_type", "content_length", "final_url", "timestamp", "stage_timings", "errors", "retry_count", "metadata",
)


def to_record(df: DataFrame) -> DataFrame:
    """df with `record`: the JSON of a page's 18 keys, those that df has not as nulls."""
    return df.withColumn("record", F.to_json(F.struct(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in RECORD_KEYS)), {"ignoreNullFields": "false"}))
