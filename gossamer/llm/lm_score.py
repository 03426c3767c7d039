"""Operator 4: language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Every word has a class, and with it a vector as context and as target. The end of a text and the
most frequent words are classes of their own; the others share classes, bands of equal frequency
for those of the head and hash classes for the rest, within which a smoothed unigram decides.
The number of classes grows with the corpus. About the root of as many neighbouring classes are a group.
The model predicts from the two classes before, (a, b): with h = c1 * r_b + c2 * r_a, first the group by
h . u_g + a_g, then the class within it by h . q_w + bias_w. Both levels are normalised exactly, by matrix
products over the groups and over the classes of a group, so time and memory grow with the root of the classes.

It is trained in numpy by noise-contrastive estimation on all class trigrams of the training fold: the class
sequences are dealt to shards of some `SHARD` tokens. From a start that one task learns on as many tokens, each
task passes over its shard, and the shards' weights are averaged, each row by how often the shard met its
class. The sums are formed in Spark; the driver gets one model.

Word counts cover all training texts. The most frequent words (at most `HEAD`, found by a
histogram of counts) are sent to the tasks; the rest meet their counts in a join, by
(text, word), so nothing that grows with the corpus but the classes (3 x the cube root of
its tokens, about 200 bytes each) is sent or gathered on the driver.

Nulls are empty texts: one end token. Repeated rows are scored (and learnt) each. With no
training text all counts are 0. Extra columns are ignored, texts of any length scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, encoded, fold, merged, read, segment_sums, slices

HEAD = 1 << 17  # words at most whose counts are sent to every task
CLASSES = 384  # at least
END = 0
RATE = 0.1
BATCH = 4096
SHARD = 4_000_000  # tokens that a task trains on before weights are averaged,
SHARDS = 4096  # more only beyond so many shards
CHUNK = 1 << 20  # tokens that are shuffled at once
ROW = 1 << 16  # tokens of a stored row
DIMS = 24
PIECE = 1 << 15  # tokens that are scored at once
ROWS = 256  # weight rows that are averaged at once


def class_count(tokens: int) -> int:
    """Classes for a corpus: they grow with the cube root of its tokens."""
    return max(CLASSES, round(3 * tokens ** (1 / 3)))


class Head:
    """The most frequent words: counts, and the classes of all words. Of `size` classes END is the first, then come the most frequent
    words, one each, bands of the other words here by frequency, and last `hashed` classes of the words beyond, by a hash."""

    def __init__(self, words: list[str], counts: np.ndarray, classes: int = CLASSES) -> None:
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words = pa.array([words[i] for i in order], pa.large_string())
        self.counts = np.array([counts[i] for i in order], np.float64)
        self.hashed = max(1, classes // 8)
        bands = classes // 8
        self.singles = min(len(words), max(0, classes - 1 - bands - self.hashed))
        others = self.counts[self.singles :]
        band = np.floor((np.cumsum(others) - others) / max(1.0, others.sum()) * bands).astype(np.int64)
        band = np.unique(band, return_inverse=True)[1]
        self.kinds = np.concatenate([np.arange(self.singles), self.singles + band]).astype(np.int64) + 1
        self.beyond = int(self.kinds.max(initial=0)) + 1  # the first hashed class
        self.size = self.beyond + self.hashed

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Place of each word in the head, or -1."""
        if not len(self.words):
            return np.full(len(distinct), -1, np.int64)
        return pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def classes(self, places: np.ndarray, distinct: pa.Array) -> np.ndarray:
        out = self.kinds[places] if len(self.kinds) else np.zeros(len(places), np.int64)
        tail = np.flatnonzero(places < 0)
        out[tail] = [self.beyond + zlib.crc32(w) % self.hashed for w in distinct.take(pa.array(tail)).cast(pa.large_binary()).to_pylist()]
        return out

    def totals(self, ends: int, beyond: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each class, and the log10 of what the smoothed counts of its words add up to (0 for a word of its own).
        beyond: tokens and words of the hashed classes; each has one more word for all unknown ones."""
        tokens, inner = np.zeros(self.size), np.zeros(self.size)
        tokens[END] = ends
        tokens[: self.beyond] += np.bincount(self.kinds, self.counts, self.beyond)
        words = np.bincount(self.kinds, minlength=self.beyond)
        banded = slice(self.singles + 1, self.beyond)
        inner[banded] = np.log10(tokens[banded] + 0.5 * words[banded])
        for i in range(self.hashed):
            n, v = beyond.get(i, (0, 0))
            tokens[self.beyond + i], inner[self.beyond + i] = n, np.log10(n + 0.5 * (v + 1))
        return tokens, inner


def with_ends(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' classes with END after each, and their new offsets."""
    n = len(offsets) - 1
    out = np.full(len(classes) + n, END, np.int64)
    at = np.ones(len(out), bool)
    at[offsets[1:] + np.arange(n)] = False
    out[at] = classes
    return out, offsets + np.arange(n + 1)


def trigrams(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes two and one before each token but the first two, and the token's; END stands before a text."""
    two, one, target = sequence[:-2].copy(), sequence[1:-1], sequence[2:]
    two[one == END] = END
    return two, one, target


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        indices, distinct, _ = encoded(batch.column("text"))
        yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(indices, minlength=len(distinct)))], names=["word", "n"])


def class_rows(head: Callable[[], Head]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The class sequences of the texts, each with the two classes before it, and a number that deals them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, salt = head(), TaskContext.get().partitionId() << 32
        kind = np.uint16 if h.size <= 1 << 16 else np.uint32
        for batch in slices(batches):
            indices, distinct, offsets = encoded(batch.column("text"))
            classes, _ = with_ends(h.classes(h.places(distinct), distinct)[indices], offsets)
            sequence = np.concatenate([[END, END], classes]).astype(kind)
            rows = [sequence[at : at + ROW + 2].tobytes() for at in range(0, len(classes), ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(salt, salt + len(rows))), pa.array(rows, pa.binary())], names=["salt", "classes"])
            salt += len(rows)

    return run


class LogBilinear:
    """Weights, a row for each class (vector r as context, q as target, bias b), each group (vector u, bias a) and one for the positions (c1, c2)."""

    def __init__(self, noise: np.ndarray, dims: int = DIMS, seed: int = 7) -> None:
        """noise: how often each class occurs, all above 0."""
        rng = np.random.default_rng(seed)
        self.size, self.dims = len(noise), dims
        self.width = max(1, round(self.size**0.5))  # classes of a group
        self.groups = -(-self.size // self.width)
        self.noise = noise / noise.sum()
        self.group_noise = np.add.reduceat(self.noise, np.arange(0, self.size, self.width))
        normal = lambda n: rng.normal(0, 0.1, (n, dims))
        inner = self.noise / self.group_noise[np.arange(self.size) // self.width]
        w = {"r": normal(self.size), "q": normal(self.size), "u": normal(self.groups), "c1": np.ones(dims), "c2": np.full(dims, 0.5), "b": np.log(inner), "a": np.log(self.group_noise)}
        self.w = {x: v.astype(np.float32) for x, v in w.items()}
        self.met = np.zeros(self.size + self.groups + 1)

    def matrix(self) -> np.ndarray:
        """All weights: rows of classes, of groups and of the positions."""
        w, d = self.w, self.dims
        out = np.zeros((self.size + self.groups + 1, 2 * d + 1), np.float32)
        out[: self.size] = np.column_stack([w["r"], w["q"], w["b"]])
        out[self.size : -1, :d], out[self.size : -1, -1] = w["u"], w["a"]
        out[-1, :d], out[-1, d:-1] = w["c1"], w["c2"]
        return out

    def set(self, rows: np.ndarray) -> LogBilinear:
        n, d = self.size, self.dims
        w = {"r": rows[:n, :d], "q": rows[:n, d:-1], "b": rows[:n, -1], "u": rows[n:-1, :d], "a": rows[n:-1, -1], "c1": rows[-1, :d], "c2": rows[-1, d:-1]}
        self.w = {x: v.astype(np.float32) for x, v in w.items()}
        return self

    def train(self, sequences: Iterator[np.ndarray], rate: float = RATE, batch: int = BATCH, k: int = 32, seed: int = 8) -> LogBilinear:
        """One pass of noise-contrastive estimation over the trigrams of class sequences: tell each group from k groups of the noise
        distribution, and each class from k classes of its group, by Adagrad. The noise's part of the gradient is taken as its
        expectation over all groups, or all classes of a group, so each step is a few matrix products."""
        rng, w, start = np.random.default_rng(seed), self.w, self.matrix()
        square = {x: np.full(v.shape if v.ndim == 1 else (len(v), 1), 1e-2, np.float32) for x, v in w.items()}
        group_noise = (k * self.group_noise).astype(np.float32)
        class_noise = (k * self.noise / self.group_noise[np.arange(self.size) // self.width]).astype(np.float32)

        def move(x: str, at: slice, grad: np.ndarray) -> None:
            square[x][at] += grad * grad if grad.ndim == 1 else np.einsum("ij,ij->i", grad, grad)[:, None] / np.float32(grad.shape[1])
            w[x][at] += np.float32(rate) * grad / np.sqrt(square[x][at])

        group_log, class_log = np.log(group_noise), np.log(class_noise)

        def told(h: np.ndarray, target: np.ndarray, vectors: str, biases: str, at: slice, noise: np.ndarray, log_noise: np.ndarray) -> np.ndarray:
            """Moves the rows `at` of the groups or of one group's classes, of which target are places; the gradient of h."""
            v, rows = w[vectors][at], np.arange(len(target))
            e = h @ v.T
            e += w[biases][at] - log_noise
            np.negative(e, out=e)
            np.exp(e, out=e)
            e += 1
            np.divide(-noise, e, out=e)  # the noise's share: -k P(noise) P(it is taken for data)
            e[rows, target] += 1 + e[rows, target] / noise[target]  # and 1 - P(the true one is taken for data)
            dh = e @ v
            move(vectors, at, e.T @ h)
            move(biases, at, e.sum(0))
            return dh

        def step(two: np.ndarray, one: np.ndarray, target: np.ndarray, group: np.ndarray) -> None:
            """A batch in the order of its groups."""
            ra, rb = w["r"][two], w["r"][one]
            h = rb * w["c1"] + ra * w["c2"]
            dh = told(h, group, "u", "a", slice(0, self.groups), group_noise, group_log)
            edge = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1, append=-1)).tolist()
            for a, b in zip(edge[:-1], edge[1:]):
                first = int(group[a]) * self.width
                own = slice(first, min(self.size, first + self.width))
                dh[a:b] += told(h[a:b], target[a:b] - target.dtype.type(first), "q", "b", own, class_noise[own], class_log[own])
            both = np.concatenate([one, two])
            order = np.argsort(both, kind="stable")
            begin = np.flatnonzero(np.diff(both[order].astype(np.int64), prepend=-1))
            move("r", both[order[begin]], np.add.reduceat(np.concatenate([dh * w["c1"], dh * w["c2"]])[order], begin, axis=0))
            for x, grad in (("c1", np.einsum("ij,ij->j", dh, rb)), ("c2", np.einsum("ij,ij->j", dh, ra))):
                square[x] += grad * grad
                w[x] += np.float32(0.2 * rate) * grad / np.sqrt(square[x])

        held: list[np.ndarray] = []

        def learn() -> None:
            kind = np.uint16 if self.size <= 1 << 16 else np.uint32  # numpy sorts short numbers by radix
            two, one, target = (np.concatenate(x).astype(kind) for x in zip(*held))
            held.clear()
            group = (target // kind(self.width)).astype(np.uint16)
            self.met += np.concatenate([n := np.bincount(target, minlength=self.size), np.add.reduceat(n, np.arange(0, self.size, self.width)), [len(target)]])
            order = rng.permutation(len(target))
            for at in np.array_split(order, max(1, round(len(order) / batch))):
                at = at[np.argsort(group[at], kind="stable")]
                step(two[at], one[at], target[at], group[at])

        for sequence in sequences:
            if len(sequence) > 2:
                held.append(trigrams(sequence))
            if sum(len(t) for t, _, _ in held) >= CHUNK:
                learn()
        if held:
            learn()
        never = self.met == 0  # classes that no text has keep their share
        if self.met[-1] and never.any():
            self.set(np.where(never[:, None], start, self.matrix()))
        return self

    def log10(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log10 probability of each target after its two classes, normalised over the groups and over the group's classes."""
        w, out = self.w, np.empty(len(target))
        near, far, group = w["r"] * w["c1"], w["r"] * w["c2"], (target // self.width).astype(np.uint16)

        def log_sums(scores: np.ndarray) -> np.ndarray:
            """Of each row; the scores are used up."""
            top = scores.max(1)
            scores -= top[:, None]
            np.exp(scores, out=scores)
            return top + np.log(scores.sum(1))

        for at in range(0, len(target), PIECE):
            by = at + np.argsort(group[at : at + PIECE], kind="stable")
            h, g, t = near[one[by]] + far[two[by]], group[by], target[by]
            s = h @ w["u"].T
            s += w["a"]
            p = s[np.arange(len(by)), g]
            p -= log_sums(s)
            edge = np.flatnonzero(np.diff(g.astype(np.int64), prepend=-1, append=-1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                first = int(g[a]) * self.width
                s = h[a:b] @ w["q"][first : first + self.width].T
                s += w["b"][first : first + self.width]
                p[a:b] += s[np.arange(b - a), t[a:b] - first]
                p[a:b] -= log_sums(s)
            out[by] = p
        return out / np.log(10)


def word_counts(train: DataFrame) -> DataFrame:
    return durable(train.select("text").mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def trained(rows: DataFrame, tokens: int, noise: np.ndarray, shard: int = SHARD) -> LogBilinear:
    """The model after one task's pass over some `shard` tokens, from which all shards start, and one pass of them over all rows (salt, classes)."""
    context, model = rows.sparkSession.sparkContext, LogBilinear(noise)
    kind = np.uint16 if model.size <= 1 << 16 else np.uint32
    parts = max(1, -(-tokens // shard))
    shards = min(SHARDS, parts)

    def passed(table: DataFrame, seed: int) -> DataFrame:
        sent = context.broadcast((model.matrix(), noise))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, (start, noise) = TaskContext.get().partitionId(), sent.value
            mine = LogBilinear(noise).set(start)
            mine.train((np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column("classes")), seed=1000 * part + seed)
            met = mine.met + 1e-9  # what no shard met stays as it was
            table = np.column_stack([met, met[:, None] * mine.matrix()])
            pieces = [table[at : at + ROWS].tobytes() for at in range(0, len(table), ROWS)]
            if mine.met[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), part % 64, np.int32)), pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array(pieces, pa.binary())], names=["some", "piece", "rows"])

        return table.select("classes").mapInArrow(run, "some int, piece int, rows binary")

    def partial(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "rows": [np.sum([np.frombuffer(x, np.float64) for x in group["rows"]], axis=0).tobytes()]})

    def settle(got: DataFrame) -> None:
        found = sorted((r.piece, r.rows) for r in got.collect())
        if found:
            table = np.concatenate([np.frombuffer(x, np.float64) for _, x in found]).reshape(-1, 2 * model.dims + 2)
            model.set(table[:, 1:] / table[:, :1])

    if parts > 1:
        settle(passed(rows.where(F.pmod(F.xxhash64("salt", F.lit(1)), F.lit(parts)) == 0).repartition(1), 500).drop("some"))
    got = passed(rows.repartition(shards, F.xxhash64("salt")), 1)
    settle(got.groupBy("piece", "some").applyInPandas(partial, "piece int, rows binary").groupBy("piece").applyInPandas(partial, "piece int, rows binary"))
    return model


def head_of(counts: DataFrame, most: int = HEAD, classes: int = CLASSES) -> tuple[Head, dict[int, tuple[int, int]]]:
    """Words from the highest level of count downwards, while there are at most `most` of them; tokens and words of each hashed class of the others."""
    level = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        total += r.words
        if total > most:
            break
        least = r.level
    if least is None:
        head = Head([], np.zeros(0), classes)
    else:
        got = counts.where(level >= least).toArrow()
        head = Head(got.column("word").to_pylist(), got.column("n").to_numpy(), classes)
    others = counts if least is None else counts.where(level < least)
    place = (F.crc32(F.col("word").cast("binary")) % head.hashed).cast("int")
    beyond = others.groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    return head, {r.place: (r.n, r.v) for r in beyond}


def score(docs: DataFrame, train: Column, most: int = HEAD, classes: int | None = None, modelled: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text), learning where `train` holds.
    Without `modelled` no model is learnt, and score is null; all else is the same."""
    spark = docs.sparkSession
    docs = merged(docs.select("doc_id", "text"))
    learnt = docs.where(train)
    counts = word_counts(learnt)
    ends = learnt.count()
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = whole.n + ends, whole.v + (ends > 0)
    head, beyond = head_of(counts, most, classes or class_count(tokens))
    sent = spark.sparkContext.broadcast(head)

    noise, inner = head.totals(ends, beyond)
    model = None
    if modelled:
        rows = durable(learnt.mapInArrow(class_rows(lambda: sent.value), "salt long, classes binary"), "classes")
        model = trained(rows, tokens, np.maximum(noise, 0.5))
        discard(rows)
    tables = spark.sparkContext.broadcast((model, inner))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, (model, inner) = sent.value, tables.value
        log = np.append(np.log10(h.counts + 0.5), 0.0)  # the last is for words beyond the head
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            indices, words_, offsets = encoded(batch.column("text"))
            places = h.places(words_)
            kind, n = h.classes(places, words_), batch.num_rows
            lengths = np.diff(offsets)
            class_log = np.full(n, np.nan)
            if model is not None:
                cls, begin = with_ends(kind[indices], offsets)
                two, one, target = trigrams(np.concatenate([[END, END], cls]))
                class_log = segment_sums(model.log10(two, one, target) - inner[target], begin)
            doc = np.repeat(np.arange(n), lengths)
            rest = (kind > h.singles)[indices]
            head_log = segment_sums(log[places[indices]], offsets)
            rest_log = segment_sums(np.where(rest, log[places[indices]], 0.0), offsets)
            beyond = (places < 0)[indices]
            tail, times = np.unique(doc[beyond] * len(words_) + indices[beyond], return_counts=True)
            ids = row + np.arange(n)
            row += n
            columns = {
                "row": np.concatenate([ids, ids[tail // max(1, len(words_))]]),
                "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(len(tail), pa.int64())]),
                "word": pa.concat_arrays([pa.nulls(n, pa.string()), words_.take(pa.array(tail % max(1, len(words_)))).cast(pa.string())]),
                "n": np.concatenate([lengths + 1, times]),
                "in_head": np.concatenate([lengths - segment_sums(beyond.astype(np.int64), offsets), np.zeros(len(tail), np.int64)]),
                "head_log": np.concatenate([head_log, np.zeros(len(tail))]),
                "rest_log": np.concatenate([rest_log, np.zeros(len(tail))]),
                "class_log": np.concatenate([class_log, np.zeros(len(tail))]),
            }
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    rows = durable(docs.mapInArrow(scored, "row long, doc_id long, word string, n long, in_head long, head_log double, rest_log double, class_log double"), "scores")
    tails = rows.where("word is not null").select("row", "word", "n").join(counts.withColumnRenamed("n", "c"), "word", "left")
    tails = tails.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    out = rows.where("word is null").join(tails, "row", "left").na.fill(0, ["tail_log", "tail_known"])
    end_log = float(np.log10(ends + 0.5))
    all_log = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return out.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("in_head") + F.col("tail_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") + F.lit(end_log) - F.col("n") * F.lit(all_log)).alias("base_score"),
        (F.col("class_log") + F.col("rest_log") + F.col("tail_log") if modelled else F.lit(None).cast("double")).alias("score"),
    )


def token_counts(docs: DataFrame, train: Column) -> DataFrame:
    """The counts of score(), by the same steps but those of the model."""
    return score(docs, train, modelled=False).select("doc_id", "n_tokens", "n_known", "train_tokens")


def op4_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, ~fold(1))
    return out.select("doc_id", fold(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
