"""Shared pieces of the training-data operators: durable tables and word splitting.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only; Arrow's ASCII kernels
have exactly these rules, so whole batches are split without a Python loop.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 3 << 20
SMALL = 500_000
PART_BYTES = 16 << 20
FILE_ROWS = 100_000  # of a durable table of short rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where all is one machine, one of our own where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "gossamer-checkpoints"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def merged(df: DataFrame) -> DataFrame:
    """df, a table as read, in fewer parts where it has more than the work needs: one for each `PART_BYTES` of the planner's estimate,
    but no fewer than four a core. So small tables aren't hundreds of tiny tasks and files. Parts are never split, and as
    tasks are what the parts behind this point are, numbers that go by the task stay apart."""
    parts = max(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(parts) if parts < 1 << 20 else df


def durable(df: DataFrame, name: str, rows: int | None = None, parts: int | None = None, free: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut, lost executors lose nothing.
    rows: a known bound of short rows, by which the table gets fewer files than the shuffle has parts.
    parts: as many as the work of the last step needs; it gets no fewer than four a core, and no more than it has.
    free: the driver collects its garbage after the write, by which the shuffle files of what is done leave the disk."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    elif parts is not None:
        df = df.coalesce(max(parts, 4 * spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gossamer_path = path
    if free:
        spark._jvm.System.gc()
    return out


def sized(table: DataFrame) -> DataFrame:
    """A table of rows of at most 60 bytes, marked for broadcast while it has at most `SMALL` of them (30 MB)."""
    return F.broadcast(table) if table.count() <= SMALL else table


def discard(df: DataFrame) -> None:
    """Delete a durable() table that nothing will read again."""
    path = getattr(df, "_gossamer_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(remainder: int) -> F.Column:
    """True where crc32(doc_id as text) mod 5 is the remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder


def trim() -> None:
    """Give memory that this worker no longer uses back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a piece has about `limit` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        trim()
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin (n + 1 offsets)."""
    flat = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    lists = pc.ascii_split_whitespace(flat)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.equal(flat, "").to_numpy(zero_copy_only=False)] = 0
    got = pc.list_flatten(lists)
    if len(got) != counts.sum():
        got = got.filter(pc.not_equal(got, ""))
    return got, np.concatenate([[0], np.cumsum(counts)])


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """words() with each word as an index into the distinct ones: indices, distinct words, offsets."""
    got, offsets = words(texts)
    d = got.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary, offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between successive offsets, empty segments 0. Each is summed by itself, so equal texts get equal sums."""
    out = np.zeros(len(offsets) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out
