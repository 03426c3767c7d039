"""Operator 7: best-fit packing with Martello-Toth dominance reduction.

Texts become token ids and a closing id 0; only what exceeds the capacity is cut, into
full pieces after a shorter first one. The instance is the histogram of piece lengths (at
most `capacity` rows, whatever the corpus), so it is solved on the driver in run-length
form: sets that provably dominate every alternative are fixed for all copies at once, the
rest goes best-fit decreasing. Pieces then find their place by their rank among the pieces
of their length, which needs counts per task and length only; no text is shuffled.

Nulls and empty texts are one piece (the closing id alone). Rows that repeat are packed
each. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, merged, read, slices

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as the tokenizer file defines them, its special tokens included where a text spells them. The file's
    vocabulary (byte-level, ids in the order of the merges) is handed to tiktoken's core, which gives the same ids at several
    times the speed; tests hold it to `tokenizers`."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte[c] for c in word): i for word, i in t.get_vocab().items() if word not in special}
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def cut_pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "")
                whole = len(ids) + 1
                start, piece, length = 0, 0, (whole - 1) % capacity + 1
                raw = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                while start < whole:
                    rows.append((doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), task, int(seen[length])))
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix every set that dominates all others with the same item, for all its copies at once; count is lowered in place.

    For an item a with room c = capacity - a and b the largest item that fits there: {a} if there is none; {a, b} if b fills c,
    as whatever else shares a's sequence fits in b's place; likewise if no two items that fit together in c exceed b and no
    three fit at all (Martello and Toth). Fixing a set lowers counts only, so the rule holds until a or b has run out.
    """
    fixed: list[tuple[list[tuple[int, int]], int]] = []
    for a in range(capacity, 0, -1):
        while count[a]:
            c = capacity - a
            count[a] -= 1  # the item itself is no partner
            sizes = np.flatnonzero(count[: c + 1])
            b = int(sizes[-1]) if len(sizes) else 0
            dominates = not b or b == c or (not _three_fit(sizes, count, c) and _best_pair(sizes, count, c) <= b)
            count[a] += 1
            if not dominates:
                break
            items, m = ([(a, 1)], int(count[a])) if not b else ([(a, 2)], int(count[a]) // 2) if a == b else ([(a, 1), (b, 1)], int(min(count[a], count[b])))
            fixed.append((items, m))
            for size, k in items:
                count[size] -= k * m
    return fixed


def _three_fit(sizes: np.ndarray, count: np.ndarray, room: int) -> bool:
    """Whether the three smallest items fit in the room together."""
    least = np.repeat(sizes[:3], np.minimum(count[sizes[:3]], 3))[:3]
    return len(least) == 3 and int(least.sum()) <= room


def _best_pair(sizes: np.ndarray, count: np.ndarray, room: int) -> int:
    """The largest sum of two items that fit in the room, 0 if there are none."""
    i, j, best = 0, len(sizes) - 1, 0
    while i <= j:
        s = int(sizes[i] + sizes[j])
        if s > room:
            j -= 1
        else:
            if i < j or count[sizes[i]] > 1:
                best = max(best, s)
            i += 1
    return best


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over the histogram: bins of equal contents are one group."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # room -> (items, bins)
    rooms: list[int] = []

    def put(room: int, items: tuple, bins: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((items, bins))

    for a in range(capacity, 0, -1):
        n = int(count[a])
        while n:
            at = bisect_left(rooms, a)
            if at < len(rooms):
                room = rooms[at]
                items, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, items, bins = capacity, (), n
            each = room // a
            full = min(bins, n // each)
            if full:
                put(room - each * a, (*items, (a, each)), full)
                n -= full * each
            elif n:
                put(room - n * a, (*items, (a, n)), 1)
                full, n = 1, 0
            if items and bins > full:
                put(room, items, bins - full)
    return [(list(items), bins) for made in groups.values() for items, bins in made]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length: where ranks begin, the sequence of the first rank there, and the offset; and the number of sequences."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    groups = reduce_by_dominance(count, capacity) + best_fit(count, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for items, bins in groups:
        offset = 0
        for a, k in items:
            for _ in range(k):
                slots.setdefault(a, []).append((bins, base, offset))
                offset += a
        base += bins
    out = {}
    for a, found in slots.items():
        n, first, offset = (np.array(x, np.int64) for x in zip(*found))
        out[a] = (np.cumsum(n) - n, first, offset)
    return out, base


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) with their sequence_id and offset."""
    spark = docs.sparkSession
    pieces = durable(merged(docs.select("doc_id", "text")).mapInArrow(cut_pieces(path or tokenizer_path(), capacity), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    placed = spark.sparkContext.broadcast(plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length).tolist():
                mine = length == a
                begin, first, at = placed.value[a]
                k = np.searchsorted(begin, rank[mine], "right") - 1
                sequence[mine], offset[mine] = first[k] + rank[mine] - begin[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(earlier, ["length", "task"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
