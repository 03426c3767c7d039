"""Operator 5: exact n-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct 5-word shingles; sets link when
100 * |intersection| >= 80 * |union|. Equal sets are one class. Any two sets that link share
one of the first n - ceil(0.8 n) + 1 elements of each in a common order by count: shingles of
one class alone come first, frequent ones last. The counts come from maps of the shingles that occur
2, 3, 4, 6 and 10 times (a bit a cell, sized by the corpus) and a table of the most frequent ones.

1. Lists: the repeated elements of these prefixes are packed by hash bucket and meet in reduce
   tasks (what one class alone has ties nothing and is not listed); each list ties its classes to its first (apart where sizes leave a gap that no link can span).
   Connected components of the ties are clusters: no link leaves one.
2. Join within a cluster, by relations between sets. A leader searches an index whose lists
   are cut into blocks by position; a block is skipped whole where size and position
   leave too little overlap. It searches at 2t - 1: as 1 - Jaccard is a metric, whatever
   links to a set within t of the leader is among these answers. Such a follower takes
   the leader's overlaps and corrects them by the shingles in which the two differ. Only
   components are wanted: sets that are joined already are never compared again.
3. Clusters of more than `ROWS` sets or `BLOCK` elements are cut into blocks, all with the cluster's
   first class. Classes outside the largest component so far then meet all other classes, in blocks;
   pairs within that component are joined already. So all components are exact at any size of cluster.
   The blocks meet in rounds, each of at most 4 bytes a shingle of the corpus, so that their copies don't add up on disk.

Sets go to their tasks as texts, which compress, and are shingled there, unless their hashes are shorter.
Sets are compared by 64-bit hashes of shingles, and equal sets found by a 64-bit hash of the set.
Null and empty texts have n_shingles 0 and their own doc_id as component; rows that repeat a
doc_id are returned each. Rows without a doc_id are kept and link like others; a component of such rows only has no id. Texts of any length are used whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, encoded, merged, read, sized, slices, trim
from .components import connected_components

WORDS = 5
PERCENT = 80
BLOCK = 1_000_000  # elements of the sets that one task joins
ROWS = 256  # sets of a first block; later ones have up to 16 times as many
FREQUENT = 1 << 20  # frequent shingles at most that are sent to every task with their counts
MAP_BITS = 28  # the largest map of repeated shingles that is sent to every task has 2^28 bits
TIMES = ((2, 0), (3, 2), (4, 3), (6, 4), (10, 5))  # maps of the shingles that occur so often, each by so many powers of two smaller
GATHER = 1_000_000  # elements that a task packs at once
BUCKET = 500_000  # postings of a bucket
SPLIT = 200_000  # a list of more classes is dealt to several tasks
Frequent = tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]
ROUND = 1 << 28  # bytes of sets that blocks of large clusters deal at once; more where the corpus is larger
HOME = ("cluster", "pivot", "block", "blocks")


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Least intersection of sets of sizes a and b that link: 100 i >= p (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def least_size(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    return -(-percent * n // 100)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    indices, distinct, offsets = encoded(texts)
    if not len(indices):
        return [np.zeros(0, np.uint64)] * len(texts)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[indices]
    g = np.zeros(len(h), np.uint64)
    for j in range(k):  # the last k - 1 places of a text reach beyond it and are not used
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        g[: max(0, len(h) - j)] += h[j:]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:  # the whole sequence; its length sets it apart from longer shingles
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(g[:0])
    return out


def class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


class SkipIndex:
    """Prefixes of sets (rising in size) by element; each list is cut into blocks of `WIDTH` positions."""

    WIDTH = 16

    def __init__(self, ranked: list[np.ndarray], sizes: np.ndarray, percent: int) -> None:
        self.sizes, self.percent = sizes, percent
        prefix = sizes - least_size(sizes, percent) + 1
        row = np.repeat(np.arange(len(sizes)), prefix)
        place = np.concatenate([np.arange(p) for p in prefix]) if len(prefix) else np.zeros(0, int)
        element = np.concatenate([s[:p] for s, p in zip(ranked, prefix)]) if len(prefix) else np.zeros(0, int)
        order = np.lexsort((row, place // self.WIDTH, element))
        self.row, self.place, self.element = row[order], place[order], element[order]
        key = self.element * (int(prefix.max(initial=1)) // self.WIDTH + 2) + self.place // self.WIDTH
        self.begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        self.end = np.append(self.begin[1:], len(key))
        self.block_element = self.element[self.begin]
        self.block_place = self.place[self.begin] // self.WIDTH * self.WIDTH

    def candidates(self, elements: np.ndarray, n: int) -> np.ndarray:
        """Rows that may link to the set of size n with these elements in order."""
        prefix = n - least_size(n, self.percent) + 1
        probe = elements[:prefix]
        lo, hi = np.searchsorted(self.block_element, probe, "left"), np.searchsorted(self.block_element, probe, "right")
        count = hi - lo
        if not count.sum():
            return np.zeros(0, int)
        blocks = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at = np.repeat(np.arange(prefix), count)
        # the smallest set that fits there needs the least: what is left on both sides must reach it
        smallest = np.maximum(least_size(n, self.percent), self.sizes[self.row[self.begin[blocks]]])
        largest = np.minimum(100 * n // self.percent, self.sizes[self.row[self.end[blocks] - 1]])
        left = np.minimum(n - at, largest - self.block_place[blocks])
        blocks = blocks[(smallest <= largest) & (left >= needed(n, smallest, self.percent))]
        if not len(blocks):
            return np.zeros(0, int)
        length = self.end[blocks] - self.begin[blocks]
        entry = np.repeat(self.begin[blocks] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        rows = np.unique(self.row[entry])
        size = self.sizes[rows]
        return rows[(size >= least_size(n, self.percent)) & (100 * n >= self.percent * size)]


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def link_sets(sets: list[np.ndarray], percent: int = PERCENT, start: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """A component label of each of the non-empty sets, by all links between them. Sets of equal labels in `start` are joined
    already; with `asked` (a boolean a set) only links of these sets are looked for. No pair of one component is compared."""
    n = len(sets)
    order = np.array(sorted(range(n), key=lambda i: len(sets[i])), np.int64)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    flat = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    element = rank[element]
    by_set = np.lexsort((element, owner))
    ranked = np.split(element[by_set], np.cumsum(sizes)[:-1]) if n else []
    by_element = np.lexsort((owner, element))
    lists, begin = owner[by_element], np.searchsorted(element[by_element], np.arange(len(count) + 1))
    label = np.arange(n) if start is None else np.unique(start, return_inverse=True)[1][order]
    open_ = np.ones(n, bool) if asked is None else asked[order].copy()

    def overlap(elements: np.ndarray) -> np.ndarray:
        """How many of the elements each set has."""
        k = begin[elements + 1] - begin[elements]
        at = np.repeat(begin[elements] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum()) if len(k) else np.zeros(0, int)
        return np.bincount(lists[at], minlength=n)

    wide = max(1, 2 * percent - 100)
    index = SkipIndex(ranked, sizes, wide)

    def answer(x: int, rows: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Joins x to all it links to among the rows."""
        ok = rows[common >= needed(int(sizes[x]), sizes[rows], percent)]
        open_[x] = False
        if len(ok):
            label[np.isin(label, label[ok])] = label[x]
        return ok

    for y in range(n):
        if not open_[y]:
            continue
        rows = index.candidates(ranked[y], int(sizes[y]))
        rows = rows[label[rows] != label[y]]
        if not len(rows):
            open_[y] = False
            continue
        common = overlap(ranked[y])[rows]
        near = common >= needed(int(sizes[y]), sizes[rows], wide)
        rows, common = rows[near], common[near]
        followers = answer(y, rows, common)
        for x in followers[open_[followers]].tolist():
            apart = label[rows] != label[x]
            rows, common = rows[apart], common[apart]
            if not len(rows):
                open_[followers] = False  # whatever they link to is in their component
                break
            more, less = np.setdiff1d(ranked[x], ranked[y], assume_unique=True), np.setdiff1d(ranked[y], ranked[x], assume_unique=True)
            answer(x, rows, common + overlap(more)[rows] - overlap(less)[rows])
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def order_key(elements: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of an element by which it is counted; two elements that share them only share a place in the order."""
    return elements >> np.uint64(32 - bits)


def scan(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document its class and size; and the order keys of all sets (copies in a task once), packed by their first `bits` bits."""
    names = ["doc_id", "cls", "n", "bucket", "keys"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        held = 0

        def packed() -> pa.RecordBatch:
            keys = np.sort(order_key(np.concatenate(list(own.values())), bits))
            edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            low, full = keys.astype(np.uint32), np.flatnonzero(np.diff(edges))
            blobs = pa.array([low[edges[i] : edges[i + 1]].tobytes() for i in full.tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(full), t) for t in types[:3]), pa.array(full), blobs], names=names)

        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            classes = [class_of(x) for x in sets]
            rows = [batch.column("doc_id").cast(pa.int64()), pa.array(classes, types[1]), pa.array([len(x) for x in sets], types[2])]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(sets), t) for t in types[3:])], names=names)
            for c, x in zip(classes, sets):
                if c not in own:
                    own[c] = x
                    held += len(x)
            if held > GATHER:
                yield packed()
                own.clear()
                held = 0
        if held:
            yield packed()

    return run


def map_bits(elements: int, bits: int) -> list[int]:
    """For each of `TIMES` how many leading bits of an element choose its cell in the map of the keys that occur so often."""
    first = min(MAP_BITS, (elements // 8).bit_length())
    return [max(bits + 3, first - less) for _, less in TIMES]


def count_keys(bits: int, maps: list[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Order keys of one bucket that occur three times or more, a row for each eighth of a power of two of the count (`level`);
    and, of level -1, -2 and so on, the bucket's part of the maps."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        trim()
        bucket = int(group["bucket"].iloc[0])
        low = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in group["keys"]]))
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        times = np.diff(np.append(first, len(low)))
        low, times = low[first[times > 1]], times[times > 1]
        rows = []
        for i, ((least, _), wide) in enumerate(zip(TIMES, maps)):
            cells = np.zeros(1 << (wide - bits), bool)
            cells[low[times >= least] >> np.uint32(32 - wide + bits)] = True
            rows.append((bucket, -1 - i, 0, np.packbits(cells, bitorder="little").tobytes(), b""))
        low, times = low[times > 2].astype(np.int64) + (bucket << 32), times[times > 2].astype(np.int64)
        level = np.floor(np.log2(times) * 8).astype(np.int64)
        for x in np.unique(level).tolist():
            rows.append((bucket, x, int((level == x).sum()), low[level == x].tobytes(), times[level == x].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "level", "n", "keys", "times"])

    return run


def frequent_keys(scanned: DataFrame, most: int, elements: int, bits: int) -> Frequent:
    """Order keys (rising) with their counts, from the highest counts down while they are at most `most`; and for each of
    `TIMES` a map of the keys that occur so often, a bit a cell: of keys that share a cell the most frequent one tells."""
    wide = map_bits(elements, bits)
    counts = durable(
        scanned.where("bucket is not null").select("bucket", "keys").groupBy("bucket").applyInPandas(count_keys(bits, wide), "bucket long, level int, n long, keys binary, times binary"),
        "frequent", parts=elements // (10 * GATHER), free=True,
    )
    least, total = None, 0
    for r in counts.where("level >= 0").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        total += r.n
        if total > most:
            break
        least = r.level
    maps = []
    for i, w in enumerate(wide):
        cells = np.zeros(1 << (w - 3), np.uint8)
        part = counts.where(F.col("level") == -1 - i).select("bucket", "keys").toArrow()
        for bucket, blob in zip(part.column("bucket").to_pylist(), part.column("keys")):
            cells[bucket << (w - 3 - bits) : (bucket + 1) << (w - 3 - bits)] = np.frombuffer(blob.as_buffer(), np.uint8)
        maps.append((w, cells))
        del part
    keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if least is not None:
        got = counts.where(F.col("level") >= least).select("keys", "times").toArrow()
        keys, times = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in got.column(c)]) for c, kind in (("keys", np.uint64), ("times", np.int64)))
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        del got, order
    discard(counts)
    trim()
    return keys, times, maps


def prefix_of(s: np.ndarray, often: np.ndarray, times: np.ndarray, maps: list[tuple[int, np.ndarray]], bits: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first elements of a set in the common order (rising by count, as far as maps and table tell it) those that may
    occur in another class, and their counts where frequent. What no class shares comes first and ties nothing."""

    def marked(elements: np.ndarray, i: int) -> np.ndarray:
        cell = (elements >> np.uint64(64 - maps[i][0])).astype(np.int64)
        return (maps[i][1][cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

    shared = s[marked(s, 0)]
    size = len(s) - least_size(len(s), percent) + 1 - (len(s) - len(shared))
    if size <= 0:
        return shared[:0], np.zeros(0, np.int64)
    level = np.ones(len(shared), np.int64)
    for i in range(1, len(maps)):
        at = np.flatnonzero(level == i)
        level[at[marked(shared[at], i)]] = i + 1
    count = np.zeros(len(shared), np.int64)
    if len(often):
        keys = order_key(shared, bits)
        at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        count = np.where(often[at] == keys, times[at], 0)
    first = np.lexsort((shared, level, count))[:size]
    return shared[first], count[first]


def clusters(docs: DataFrame, frequent: Frequent, elements: int, bits: int, percent: int, split: int, bucket: int) -> DataFrame:
    """(cls, cluster) of the classes that share an element of their prefixes with another class."""
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(frequent)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(shuffles, elements * (100 - percent) // 100 // bucket + 1))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings packed by bucket. A list that is known to be long is dealt over several buckets."""
        e: list[np.ndarray] = []
        c: list[np.ndarray] = []
        n: list[np.ndarray] = []
        t: list[np.ndarray] = []
        held: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            element, cls, sizes, parts = map(np.concatenate, (e, c, n, t))
            where = ((element >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            long = parts > 1
            where[long] = (where[long] + cls[long].astype(np.uint64).view(np.int64) % parts[long]) % buckets
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            cut = lambda a: pa.array([a[order[edges[i] : edges[i + 1]]].tobytes() for i in full.tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full), cut(element), cut(cls), cut(sizes.astype(np.int32)), cut(parts > 1)], names=["bucket", "element", "cls", "n", "dealt"])

        for batch in slices(batches):
            for s in shingle_sets(batch.column("text")):
                if len(s) and (k := class_of(s)) not in held:
                    held.add(k)
                    prefix, count = prefix_of(s, *often.value, bits, percent)
                    e.append(prefix)
                    c.append(np.full(len(prefix), k, np.int64))
                    n.append(np.full(len(prefix), len(s), np.int64))
                    t.append(1 + count // split)
                    size += len(prefix)
            if size > bucket:
                yield flush()
                for x in (e, c, n, t, held):
                    x.clear()
                size = 0
        if size:
            yield flush()

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        """Ties of each list: its classes to the first, anew where sizes leave a gap; dealt lists also name their element."""
        trim()
        element, cls = np.frombuffer(b"".join(group["element"]), np.uint64), np.frombuffer(b"".join(group["cls"]), np.int64)
        n, dealt = np.frombuffer(b"".join(group["n"]), np.int32).astype(np.int64), np.frombuffer(b"".join(group["dealt"]), bool)
        order = np.lexsort((cls, n, element))
        element, cls, n, dealt = element[order], cls[order], n[order], dealt[order]
        if not len(element):
            return pd.DataFrame({"element": [], "a": [], "b": []})
        new = np.concatenate([[True], (element[1:] != element[:-1]) | ((n[:-1] < least_size(n[1:], percent)) & ~dealt[1:])])
        first = cls[np.flatnonzero(new)[np.cumsum(new) - 1]]
        keep = (first != cls) | dealt
        got = pd.DataFrame({"element": np.where(dealt, element.view(np.int64), 0)[keep], "dealt": dealt[keep], "a": first[keep], "b": cls[keep]}).drop_duplicates()
        plain = got[~got["dealt"]]
        if not len(plain):
            return got
        nodes, ends = np.unique(plain[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        tree = Union(len(nodes))  # the ties of a bucket as one tie a class
        for x, y in ends.reshape(-1, 2).tolist():
            tree.join(x, y)
        root = nodes[[tree.find(i) for i in range(len(nodes))]]
        tied = pd.DataFrame({"element": np.int64(0), "dealt": False, "a": root, "b": nodes})
        return pd.concat([tied[root != nodes], got[got["dealt"]]])

    packed = docs.select("text").mapInArrow(post, "bucket long, element binary, cls binary, n binary, dealt binary")
    ties = durable(packed.groupBy("bucket").applyInPandas(lists, "element long, dealt boolean, a long, b long"), "ties", parts=buckets if buckets > shuffles else 0, free=True)
    firsts = ties.where("dealt").groupBy("element", "a").agg(F.count("*").alias("k")).drop("k")
    heads = firsts.groupBy("element").agg(F.min("a").alias("b"))
    edges = ties.select("a", "b").union(firsts.join(heads, "element").select("a", "b"))
    return connected_components(edges, n=ties.count()).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))


def _pack(texts: pa.Array, sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Each set as its text, or as its hashes where these are shorter (true)."""
    blobs = texts.cast(pa.binary())
    hashed = pc.fill_null(pc.greater(pc.binary_length(blobs), pa.array([8 * len(s) for s in sets], pa.int64())), True)
    return hashed, pc.if_else(hashed, pa.array([s.tobytes() if h else None for s, h in zip(sets, hashed.to_pylist())], pa.binary()), blobs)


def _unpack(frame: pd.DataFrame) -> list[np.ndarray]:
    sets = [np.frombuffer(x, np.uint64) if h else None for x, h in zip(frame["elements"], frame["hashed"])]
    plain = [i for i, s in enumerate(sets) if s is None]
    texts = pa.array(frame["elements"].iloc[plain], pa.binary()).cast(pa.string())
    got = (s for batch in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])) for s in shingle_sets(batch.column("text")))
    for i, s in zip(plain, got):
        sets[i] = s
    return sets


def join(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, split: int = SPLIT, bucket: int = BUCKET, rows_a_block: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text)."""
    docs = merged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    bits = min(20, max(6, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    scanned = durable(docs.mapInArrow(scan(bits), "doc_id long, cls long, n long, bucket long, keys binary"), "classes")
    rows = scanned.where("cls is not null").select("doc_id", "cls", "n")
    elements, n_rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = durable(rows, "rows", n_rows)
    often = frequent_keys(scanned, FREQUENT, elements, bits)
    discard(scanned)
    found = durable(clusters(docs, often, elements, bits, percent, split, bucket), "clusters", n_rows, free=True)
    del often
    trim()
    first = rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    members = found.join(first, "cls")
    weight = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.min("cls").alias("pivot"))
    least = F.greatest(F.ceil(F.col("total") / block), F.ceil(F.col("k") / (16 * rows_a_block))).cast("int")  # blocks that bound memory
    weight = sized(durable(weight, "weights", n_rows)).select("cluster", "pivot", "k", least.alias("least"), F.greatest(least, F.ceil(F.col("k") / rows_a_block)).cast("int").alias("blocks"))
    members = durable(members.join(weight, "cluster").select("doc_id", "cls", "n", "cluster", "pivot", "k", "least", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")), "members", n_rows)
    joined = docs.join(sized(members.where("doc_id is not null").select("doc_id", F.col("cls").alias("want"), *HOME)), "doc_id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            good = [class_of(s) == w for s, w in zip(sets, batch.column("want").to_pylist())]  # a repeated doc_id may have other texts
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in HOME), batch.column("want"), *_pack(batch.column("text"), sets)], names=[*HOME, "cls", "hashed", "elements"])
            yield out.filter(pa.array(good))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), *_pack(batch.column("text"), sets)], names=["cls", "hashed", "elements"])

    made = "cluster long, pivot long, block int, blocks int, cls long, hashed boolean, elements binary"
    sets = joined.mapInArrow(sets_of, made)
    nameless = members.where("doc_id is null")
    if not nameless.isEmpty():  # classes whose documents all lack an id are met by the class
        sets = sets.union(docs.where("doc_id is null").select("text").mapInArrow(classed, "cls long, hashed boolean, elements binary").join(nameless, "cls").dropDuplicates(["cls"]).select(*HOME, "cls", "hashed", "elements"))
    sets = durable(sets, "sets", parts=elements // (10 * GATHER), free=True)
    pivots = sets.where("blocks > 1 and cls = pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def tied(cls: np.ndarray, label: np.ndarray) -> pd.DataFrame:
        """A tie of each class to the first one of its label."""
        _, at, which = np.unique(label, return_index=True, return_inverse=True)
        return pd.DataFrame({"a": cls, "b": cls[at[which]]}).astype("int64")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        trim()
        group = group.drop_duplicates("cls")
        return tied(group["cls"].to_numpy(), link_sets(_unpack(group), percent))

    linked = durable(sets.union(pivots.select(sets.columns)).groupBy("cluster", "block").applyInPandas(within, "a long, b long"), "links", parts=elements // (10 * GATHER), free=True)
    links, large = [linked], sets.where("blocks > 1")
    if not large.isEmpty():
        # short rows tell who asks, so that sets move only where a cluster has classes that do
        kin = members.where("blocks > 1").join(connected_components(linked, n=linked.count()).withColumnRenamed("node", "cls"), "cls", "left")
        kin = durable(kin.select("cls", "n", "cluster", "k", "least", "blocks", F.coalesce("root", "cls").alias("root")), "kin", n_rows)
        main = kin.groupBy("cluster", "root").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
        asking = durable(kin.join(sized(main), "cluster").withColumn("asks", F.col("root") != F.col("main")), "asking", n_rows)
        # few that ask meet all the small blocks; many meet as few blocks as memory allows
        bulk = asking.where("asks").groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("asking"), F.first("k").alias("all"), F.first("least").alias("least"), F.first("blocks").alias("most"))
        bulk = bulk.select(
            "cluster", F.greatest(F.ceil(F.col("total") / block), F.ceil(F.col("asking") / (16 * rows_a_block))).cast("int").alias("groups"),
            F.greatest("least", F.least("most", F.ceil(F.col("all") / F.col("asking")))).cast("int").alias("parts"),
        )
        plan = asking.join(sized(bulk), "cluster").select("cls", "root", "asks", "groups", "parts")
        part = durable(large.join(sized(durable(plan, "plan", n_rows)), "cls").select("cluster", "groups", "parts", "cls", "hashed", "elements", "root", "asks"), "parts", parts=elements // (10 * GATHER), free=True)
        discard(sets)
        copied = part.agg(F.coalesce(F.sum(F.length("elements") * (F.col("groups") + F.when(F.col("asks"), F.col("parts")).otherwise(0))), F.lit(0))).first()[0]
        rounds = -(-int(copied) // max(ROUND, 4 * elements))
        dealt = lambda seed, parts: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(parts)).cast("int")
        every = lambda parts, now: F.explode(F.filter(F.sequence(F.lit(0), F.col(parts) - 1), now))

        def between(group: pd.DataFrame) -> pd.DataFrame:
            trim()
            group = group.sort_values("asks", ascending=False).drop_duplicates("cls")
            return tied(group["cls"].to_numpy(), link_sets(_unpack(group), percent, group["root"].to_numpy(), group["asks"].to_numpy()))

        columns = ["cluster", "block", "g", "cls", "hashed", "elements", "root", "asks"]
        for r in range(rounds):
            now = lambda g, b: F.pmod(F.pmod(F.xxhash64("cluster"), F.lit(rounds)) + g.cast("long") * F.col("parts") + b, F.lit(rounds)) == r  # noqa: B023, E731
            asked = part.where("asks").withColumn("g", dealt(1, "groups")).withColumn("block", every("parts", lambda b: now(F.col("g"), b)))  # noqa: B023
            there = part.withColumn("block", dealt(2, "parts")).withColumn("g", every("groups", lambda g: now(g, F.col("block")))).withColumn("asks", F.lit(False))  # noqa: B023
            met = asked.select(columns).union(there.select(columns)).groupBy("cluster", "block", "g").applyInPandas(between, "a long, b long")
            links.append(durable(met, "links", parts=elements // (10 * GATHER), free=True))
            linked = linked.union(links[-1])
        discard(part)
    roots = durable(connected_components(linked, n=linked.count()), "roots", n_rows)
    whole = roots.withColumnRenamed("node", "cls").join(first.select("cls", "doc_id"), "cls").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.withColumnRenamed("node", "cls").join(whole, "root").select("cls", F.col("component_id").alias("shared"))
    # written, so that Spark can split the part of a class that very many documents share
    alone = durable(first.join(named, "cls", "left").select("cls", F.coalesce("shared", "doc_id").alias("component_id")), "components", n_rows)
    for table_ in (found, members, sets, *links, roots):
        discard(table_)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(alone, "cls").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive ws as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as (
    select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from ws
), sizes as (
    select doc_id, count(*) as n from sh group by doc_id
), common as (
    select s from sh group by s having count(*) > 1
), pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as i
    from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id join common c on a.s = c.s group by all
), links as (
    select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * i >= 80 * (a.n + b.n - i)
), both_ways as (
    select x, y from links union all select y, x from links
), reach as (
    select doc_id as node, doc_id as seen from documents
    union
    select r.node, b.y from reach r join both_ways b on b.x = r.seen
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id
from documents d left join sizes s on s.doc_id = d.doc_id
join (select node, min(seen) as component_id from reach group by node) r on r.node = d.doc_id
"""
