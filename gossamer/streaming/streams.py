"""Structured Streaming forms: validation and duplicate detection without end, windows by host, and a limiter with state."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DedupRules, UrlRules
from ..functions import urls
from ..operators import dedup, validate

log = logging.getLogger(__name__)


class Monitor(StreamingQueryListener):
    """Logs the figures of each batch, and keeps the last of each query; one that takes rows more slowly than they come is behind."""

    def __init__(self) -> None:
        self.last: dict[str, dict[str, Any]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        log.info("query %s started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        came, done = p.inputRowsPerSecond or 0.0, p.processedRowsPerSecond or 0.0
        self.last[str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": done, "behind": bool(came > done > 0)}
        log.info("query %s: batch %d, %d rows", p.id, p.batchId, p.numInputRows)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        log.info("query %s ended: %s", event.id, event.exception or "done")


def url_stream(spark: SparkSession, folder: str, schema: str = "url string, depth int, parent_url string", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def first_sightings(stream: DataFrame, rules: UrlRules | None = None, dedup_rules: DedupRules | None = None) -> DataFrame:
    """Valid addresses, each once in the stream's life: a crawl forgets none, so the state has no end."""
    keep = dedup_rules or DedupRules()
    kept = validate.validated(stream, rules).where("drop_reason is null").drop("drop_reason")
    return kept.withColumn("key", dedup.key(F.col("url"), keep.case_sensitive)).dropDuplicates(["key"])


def host_windows(stream: DataFrame, late: str = "10 minutes", size: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests of (url, ts) by host and window; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("requests"))


def host_sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("requests"))


def fixed_delay(stream: DataFrame, delay_us: int) -> DataFrame:
    """Release times of (host, id, arrival_us), the last release of each host kept as state from batch to batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["arrival_us", "id"])
        out = []
        for i, a in zip(rows["id"].tolist(), rows["arrival_us"].tolist()):
            last = a if last is None else max(a, last + delay_us)
            out.append((key[0], i, a, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["host", "id", "arrival_us", "release_us"])

    return stream.groupBy("host").applyInPandasWithState(run, "host string, id long, arrival_us long, release_us long", "last long", "append", GroupStateTimeout.NoTimeout)


def to_folder(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appended as Parquet; with `once` what is there is taken and the query ends, to be resumed from its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
