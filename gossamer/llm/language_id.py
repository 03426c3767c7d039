"""Operator 2: language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3 with frozen counts. A byte that a
context has seen is coded with c / (C + q), an unseen one with the escape q / (C + q)
times the next shorter context's probability of it among the bytes unseen here (method C
with exclusion), down to 1/256 each. A text's code length in a language is the sum over
all its bytes, and the shortest wins, ties to the smaller name.

The trees are fitted on a bounded sample: whole labelled texts in the order of a hash of
doc_id until `sample_bytes` a language, and each language's most frequent contexts up to `max_cells`
table cells of its own. With frozen counts a byte's code length depends on its context alone, so all
of them are tabled once and numpy scores whole batches. Every byte of every text counts.

Null texts, and texts without a letter, are `und` with score 0; so is everything if there
is nothing to learn from. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, merged, read, slices, trim

ORDER = 3
SAMPLE_BYTES = 2 << 20
MAX_CELLS = 1 << 21  # of each language
MOST_BITS, FREE_BITS = 7.0, 64  # a byte, and besides: keep_known() rejects a text whose code is longer
CHUNK = 1 << 20  # bytes of text that are scored at once


@dataclass
class ContextTrees:
    languages: list[str]
    lut: np.ndarray  # byte -> symbol; bytes never seen share the last one
    rows: list[np.ndarray]  # for each order: context -> its longest suffix that any language knows
    stores: list[np.ndarray]  # for each language: such a suffix -> the row of the longest one that this language knows
    bits: list[np.ndarray]  # for each language: (row, symbol) -> code length
    base: int  # symbols


def grams(data: np.ndarray, offsets: np.ndarray, k: int, base: int) -> np.ndarray:
    """Keys of the k symbols that end at each place of the texts where k symbols of the text are there."""
    key = np.zeros(len(data), np.int64)
    for j in range(k):
        key[j:] += data[: len(data) - j].astype(np.int64) * base**j
    ok = np.ones(len(data), bool)
    for j in range(k - 1):
        first = offsets[:-1] + j
        ok[first[first < offsets[1:]]] = False
    return key[ok]


def fit(samples: dict[str, list[bytes]], order: int = ORDER, max_cells: int = MAX_CELLS) -> ContextTrees:
    languages = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        seen[np.frombuffer(b"".join(texts), np.uint8)] = True
    base = int(seen.sum()) + 1
    lut = np.full(256, base - 1, np.int32)
    lut[seen] = np.arange(base - 1)
    counted = []  # for each language and length: keys and counts
    for name in languages:
        texts = samples[name]
        data = lut[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        counted.append([np.unique(grams(data, offsets, k + 1, base), return_counts=True) for k in range(order + 1)])
    uniform = np.full(base, 1 / 256)
    uniform[-1] = max(1, 257 - base) / 256
    uniform /= uniform.sum()
    # which contexts each language keeps: all it has seen while there is room, by its own counts
    room, kept = max(1, max_cells // base), [[] for _ in languages]
    for own, c in zip(kept, counted):
        for k, (keys, n) in enumerate(c):
            found, at = np.unique(keys // base, return_inverse=True)
            total = np.bincount(at, n, len(found))
            most = max(0, room - sum(map(len, own)))
            own.append(np.sort(found[np.argsort(-total, kind="stable")[:most]]) if k else np.zeros(1, np.int64))
    rows, suffixes, begin = [], [], 0
    for k in range(order + 1):
        contexts = np.unique(np.concatenate([own[k] for own in kept]))
        suffixes.append((contexts, rows[-1][contexts % base ** (k - 1)] if k > 1 else np.zeros(len(contexts), np.int32)))
        table = np.zeros(base**k, np.int32) if k < 2 else np.tile(rows[-1], base)  # by default the row of the shorter suffix
        table[contexts] = begin + np.arange(len(contexts))
        rows.append(table)
        begin += len(contexts)
    stores, bits = [], []
    for own, c in zip(kept, counted):
        store, levels = np.zeros(0, np.int32), uniform.astype(np.float32)[None]
        for k, (contexts, (keys, n)) in enumerate(zip(own, c)):
            every, suffix = suffixes[k]
            shorter = levels[store[suffix[np.searchsorted(every, contexts)]]] if k else levels
            count = np.zeros((len(contexts), base), np.float32)
            at = np.searchsorted(contexts, keys // base)
            ok = (at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == keys // base) if len(contexts) else np.zeros(len(keys), bool)
            count[at[ok], keys[ok] % base] = n[ok]
            whole, novel = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            rest = np.where(count > 0, 0, shorter).sum(1, keepdims=True, dtype=np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                q = np.where(count > 0, count / (whole + np.where(rest > 0, novel, 0)), novel / (whole + novel) * (shorter / rest))
            place = store[suffix] if k else np.zeros(1, np.int32)  # a context that this language lacks has its suffix's row
            if k:
                place[np.searchsorted(every, contexts)] = len(levels) + np.arange(len(contexts))
            q = np.where(whole > 0, q, shorter).astype(np.float32)
            levels = np.concatenate([levels, q]) if k else q
            store = np.concatenate([store, place])
        np.log2(levels, out=levels)
        np.negative(levels, out=levels)
        levels[:, -1] += np.log2(max(1, 257 - base))
        stores.append(store)
        bits.append(levels.reshape(-1))
    return ContextTrees(languages, lut, rows, stores, bits, base)


def code_lengths(model: ContextTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text (data between successive offsets) in each language."""
    base, order = model.base, len(model.rows) - 1
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    doc = 0
    for a in range(0, len(data), CHUNK):
        b, back = min(len(data), a + CHUNK), min(order, a)
        s = model.lut[data[a - back : b]].astype(np.int64)
        n, key = b - a, np.zeros(b - a, np.int64)
        for j in range(1, order + 1):
            lag = s[back - j : back - j + n] if back >= j else np.concatenate([np.zeros(j - back, np.int64), s[: n - (j - back)]])[:n]
            key += lag * base ** (j - 1)
        row = model.rows[order][key]
        lo, hi = np.searchsorted(offsets, a - order, "left"), np.searchsorted(offsets, b, "left")
        starts = offsets[lo:hi]
        for k in range(order):  # the first bytes of a text have shorter contexts
            at = starts + k
            at = at[(at >= a) & (at < np.minimum(b, offsets[np.searchsorted(offsets, at - k, "right")]))] - a if len(starts) else at
            row[at] = model.rows[k][key[at] % base**k] if k else 0
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        edges = np.unique(np.concatenate([[0], inner]))
        doc = np.searchsorted(offsets, a + edges, "right") - 1
        for i, (store, bits) in enumerate(zip(model.stores, model.bits)):
            out[doc, i] += np.add.reduceat(bits[store[row].astype(np.int64) * base + s[back:]], edges, dtype=np.float64)
    return out


def learn(docs: DataFrame, train: F.Column, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> ContextTrees | None:
    """Trees from whole texts of docs (doc_id, text, lang) where `train` holds: per language, in the order of a hash, until sample_bytes."""
    labelled = docs.where(train & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    size = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not size:
        return None
    place = (F.xxhash64("doc_id", F.lit(2)) / F.lit(2.0**64)) + 0.5
    samples: dict[str, list[bytes]] = {}
    wanted = {k: 1.5 * sample_bytes / n for k, n in size.items()}  # the share of the hash's range that is read
    while wanted:
        rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(w)) for k, w in sorted(wanted.items())])
        rows = labelled.where((place < rate) | (rate > 1)).withColumn("place", place).toPandas().sort_values(["place", "doc_id", "text"])
        read_bytes, used = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
        samples |= {k: [] for k in wanted}
        for lang, text in zip(rows["lang"], rows["text"]):
            raw = text.encode()
            read_bytes[lang] += len(raw)
            if used[lang] < sample_bytes and (used[lang] + len(raw) <= 2 * sample_bytes or not samples[lang]):
                samples[lang].append(raw)
                used[lang] += len(raw)
        # few long texts: more of the range, until the bytes are there or all texts were read
        wanted = {k: 4 * w for k, w in wanted.items() if read_bytes[k] < sample_bytes and w <= 1}
        del rows
    trees = fit(samples, order)
    samples.clear()
    trim()
    return trees


def judge(trees: ContextTrees | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the place of its language (-1: und), the language's share of the probability, and its bits a byte."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    n = len(texts)
    if trees is None or not letter.any():
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bits = code_lengths(trees, data, offsets - offsets[0])
    least = bits.min(1)
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    return np.where(letter, bits.argmin(1), -1), np.where(letter, share, 0.0), np.where(letter, least / np.maximum(1, np.diff(offsets)), 0.0)


def predict(docs: DataFrame, model: ContextTrees | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of all docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(sent.value.languages if sent.value is not None else []), "und"]
        for batch in slices(batches):
            best, score, rate = judge(sent.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return merged(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, model: ContextTrees | None, most_bits: float = MOST_BITS) -> DataFrame:
    """docs without the texts that no language explains: those that are `und`, and those that even their best language
    codes with more than `most_bits` a byte (and FREE_BITS, so that short texts stay). Missing lang values are filled in; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, _, rate = judge(sent.value, batch.column("text"))
            at, lang = batch.schema.get_field_index("lang"), batch.column("lang")
            if lang.null_count and sent.value is not None:
                told = pa.array([sent.value.languages[i] if i >= 0 else None for i in best.tolist()], lang.type)
                batch = batch.set_column(at, batch.schema.field(at), pc.coalesce(lang, told))
            size = np.maximum(1, pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array((best >= 0) & (rate * size <= most_bits * size + FREE_BITS)))

    return merged(docs).mapInArrow(run, docs.schema)


def op2_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, learn(docs, ~fold(0)))
    return out.select("doc_id", fold(0).alias("held_out"), "lang_pred", "score", "bits_per_byte")
