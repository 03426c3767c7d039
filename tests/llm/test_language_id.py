import math
from functools import lru_cache

import numpy as np

from gossamer.llm import language_id as L

SAMPLES = {"aa": [b"abracadabra", b"abra", b"a"], "bb": [b"bobbing bob", "é ü".encode()]}


def probability(texts, context, byte, base_seen, order):
    """The definition, by recursion on the longest context that any language has."""
    everything = [t for ts in SAMPLES.values() for t in ts]
    while context and not any(context in t[:-1] for t in everything):
        context = context[1:]

    @lru_cache(maxsize=None)
    def p(ctx, b):
        shorter = (lambda c: p(ctx[1:], c)) if ctx else (lambda c: 1 / 256)
        count = {}
        for t in texts:
            for i in range(len(ctx), len(t)):
                if t[i - len(ctx) : i] == ctx:
                    count[t[i]] = count.get(t[i], 0) + 1
        if not count:
            return shorter(b)
        total, q = sum(count.values()), len(count)
        if b in count:
            return count[b] / (total + q)
        return q / (total + q) * shorter(b) / sum(shorter(c) for c in range(256) if c not in count)

    return p(context, byte)


def test_code_lengths_follow_the_definition():
    model = L.fit(SAMPLES)
    for text in (b"abrab", b"zz\x00bob", "aé b".encode(), b"a", b"ing"):
        got = L.code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        for i, name in enumerate(model.languages):
            want = sum(-math.log2(probability(SAMPLES[name], text[max(0, j - 3) : j], text[j], None, 3)) for j in range(len(text)))
            assert abs(got[i] - want) < 1e-4


def test_chunks_and_neighbours_do_not_matter(monkeypatch):
    model = L.fit(SAMPLES)
    texts = [b"abra", b"", b"b", b"bobbing abra", b"ab", b"", b"cadabra bob" * 9]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = np.concatenate([L.code_lengths(model, np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    for size in (1, 2, 3, 5, 7, 1000):
        monkeypatch.setattr(L, "CHUNK", size)
        assert np.allclose(L.code_lengths(model, data, offsets), alone, rtol=1e-6)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = L.op2_ppm_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 !", "en", "x"), (4, "hello there", None, "x"), (5, "hello you all", "en", "x"), (6, "guten tag", "de", "x"), (6, "guten tag", "de", "x"), (7, "y" * 3_000_000, "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.learn(docs, L.F.lit(True))
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    assert [got[i] for i in range(1, 8)] == ["und", "und", "und", "en", "en", "de", "de"]
    assert L.learn(docs.limit(0), L.F.lit(True)) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0


def test_short_texts_stay_and_noise_goes(spark):
    import random

    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300))
    rows = [(1, "hello there you all", "en"), (2, "A.", "en"), (3, noise, None), (4, "7a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs.where("doc_id < 3"), L.F.lit(True))
    assert sorted(r.doc_id for r in L.keep_known(docs, model).collect()) == [1, 2, 4]


def test_languages_of_few_long_texts_are_learnt(spark):
    """Whatever the places of their hashes: twenty languages of one text each, longer than what is read first."""
    rows = [(i, chr(97 + i) * 3000, f"l{i}") for i in range(20)] + [(100 + i, "xyz " * 10, "short") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs, L.F.lit(True), 1000)
    assert model.languages == sorted({r[2] for r in rows})


def test_more_languages_take_no_contexts_from_another():
    rng = np.random.default_rng(1)
    samples = {f"l{i:02}": [rng.integers(97, 123, 400, dtype=np.uint8).tobytes()] for i in range(40)}
    cells = 27 * 450  # room for all contexts of one language
    few, many = (L.fit({k: samples[k] for k in list(samples)[:n]}, 2, cells) for n in (2, 40))
    data = np.frombuffer(samples["l00"][0], np.uint8)
    lengths = [L.code_lengths(m, data, np.array([0, len(data)]))[0, 0] for m in (few, many)]
    assert abs(lengths[0] - lengths[1]) < 1e-3
