import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gossamer.llm import lm_score as L


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def base(docs, train):
    count = Counter(w for (d, t) in docs if train(d) for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    return count, n, v


@pytest.mark.parametrize("most", [L.HEAD, 50])
def test_base_against_brute_force(spark, most):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    count, n, v = base(docs, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    got = {r.doc_id: r for r in L.score(frame, ~L.fold(1), most, 40).collect()}
    uniform = 0.0
    for d, text in docs:
        ws = [*tokens(text), None]
        want = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0
        uniform += want
    assert sum(r.score for r in got.values()) > uniform  # context helps


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    size = 7
    follow = rng.dirichlet([0.3] * size, size)
    follow[:, 0] = 0
    follow /= follow.sum(1, keepdims=True)
    seq = [1]
    for _ in range(30_000):
        seq.append(int(rng.choice(size, p=follow[seq[-1]])))
    s = np.array([0, 0, *seq])
    model = L.LogBilinear(np.bincount(s, minlength=size) + 0.5, 12)
    assert 1 < model.groups < size
    for _ in range(12):
        model.train([s], batch=512)
    every = np.indices((size, size, size)).reshape(3, -1)
    assert np.allclose((10 ** model.log10(*every)).reshape(size, size, size).sum(2), 1)
    noise = np.bincount(s, minlength=size) / len(s)
    truth = -np.mean(np.log(follow[seq[:-1], seq[1:]]))
    got = -np.mean(model.log10(*L.trigrams(s))[1:]) * math.log(10)
    unigram = -np.mean(np.log(noise[seq[1:]]))
    assert got - truth < 0.15 * (unigram - truth)


def test_contexts_stop_at_the_end_of_a_text():
    cls, _ = L.with_ends(np.array([5, 6, 7, 8, 9]), np.array([0, 3, 3, 5]))
    assert cls.tolist() == [5, 6, 7, 0, 0, 8, 9, 0]
    two, one, target = L.trigrams(np.concatenate([[0, 0], cls]))
    assert target.tolist() == cls.tolist() and one.tolist() == [0, 5, 6, 7, 0, 0, 8, 9] and two.tolist() == [0, 0, 5, 6, 0, 0, 0, 8]


def test_scores_sum_to_one_over_all_tokens(spark):
    """One-word texts: P(word) * P(end | word) over the known words and all unknown ones."""
    docs = spark.createDataFrame([(1, "a b a c", 0), (2, "b a", 0), (3, "d", 0), (4, None, 0)], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(5, w, 1) for w in ("a", "b", "c", "d", "zz", "")], "doc_id long, text string, score int")
    got = L.score(docs.union(asked), L.F.col("doc_id") < 5, 100, 4).collect()
    assert all(r.score < 0 and r.train_tokens == 11 for r in got)
    alone = [r for r in got if r.doc_id == 4]
    assert alone[0].n_tokens == alone[0].n_known == 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, "", 0), (3, None, 0), (4, "w " * 400_000, 0), (5, "q%d " % 1 * 3, 0)], "doc_id long, text string, n int")
    assert L.score(docs.limit(0), L.F.lit(True)).count() == 0
    none = L.score(docs, L.F.lit(False)).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}
    assert len(L.score(docs, L.F.lit(True)).collect()) == 6


def test_counts_are_those_of_the_scores_without_a_model(spark, monkeypatch):
    rows = [(1, "a b a"), (2, "b c"), (3, None), (4, "a d d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    want = sorted(tuple(r) for r in L.score(docs, L.F.col("doc_id") < 4).select(names).collect())
    monkeypatch.setattr(L, "trained", None)  # calling it would raise
    assert sorted(tuple(r) for r in L.token_counts(docs, L.F.col("doc_id") < 4).select(names).collect()) == want
    assert want[3] == (4, 4, 2, 8)


def test_every_token_is_trained_on_whatever_the_shards(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    counts = L.word_counts(docs)
    ends = docs.count()
    tokens = counts.agg({"n": "sum"}).first()[0] + ends
    head, beyond = L.head_of(counts, L.HEAD, L.class_count(tokens))
    monkeypatch.setattr(L, "ROW", 100)
    rows = docs.mapInArrow(L.class_rows(lambda: head), "salt long, classes binary")
    kept = [np.frombuffer(r.classes, np.uint16) for r in rows.collect()]
    assert sum(len(x) - 2 for x in kept) == tokens and max(map(len, kept)) == 102
    noise = np.maximum(head.totals(ends, beyond)[0], 0.5)
    assert np.bincount(np.concatenate([x[2:] for x in kept]), minlength=head.size).sum() == round(head.totals(ends, beyond)[0].sum())

    def held_out(model):
        return np.mean(np.concatenate([model.log10(*L.trigrams(x)) for x in kept]))

    start = held_out(L.LogBilinear(noise))
    one, many = (held_out(L.trained(rows, tokens, noise, shard=shard)) for shard in (10**9, tokens // 7))
    assert one > start + 0.05 and many > start + 0.02


def test_long_texts_keep_their_contexts(monkeypatch):
    """Rows of a text that is cut repeat the two classes before the cut."""
    head = L.Head([f"w{i}" for i in range(50)], np.arange(50, 0, -1), 40)
    monkeypatch.setattr(L, "ROW", 7)
    monkeypatch.setattr(L, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 3)})())}))
    text = " ".join(f"w{i % 50}" for i in range(30))
    out = list(L.class_rows(lambda: head)(iter([L.pa.RecordBatch.from_arrays([L.pa.array([text, None, "w1"])], names=["text"])])))
    rows = [np.frombuffer(x, np.uint16) for b in out for x in b.column("classes").to_pylist()]
    whole = np.concatenate([rows[0][:2], *(r[2:] for r in rows)])
    assert len(whole) == 2 + 30 + 1 + 1 + 1 + 1
    for i, r in enumerate(rows):
        assert r[:2].tolist() == whole[7 * i : 7 * i + 2].tolist()
    assert len({x for b in out for x in b.column("salt").to_pylist()}) == len(rows)


def test_classes_grow_and_every_word_has_one():
    assert L.class_count(1000) == L.CLASSES < L.class_count(50_000_000) < L.class_count(4_000_000_000)
    words, counts = [f"w{i}" for i in range(500)], np.arange(500, 0, -1)
    head = L.Head(words, counts, 64)
    asked = L.pa.array([*words, "unseen", "other", "ü"], L.pa.large_string())
    kinds = head.classes(head.places(asked), asked)
    assert (kinds > L.END).all() and (kinds < head.size).all() and len(set(kinds[:500].tolist())) == head.beyond - 1 > head.singles
    assert len(set(kinds[500:].tolist())) > 1 and (kinds[500:] >= head.beyond).all()


def test_all_words_and_an_unknown_one_of_each_class_sum_to_one(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[: 60 - i])) for i in range(55)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    counts = L.word_counts(frame)
    head, beyond = L.head_of(counts, 40, 24)
    tokens, inner = head.totals(55, beyond)
    n = {r.word: r.n for r in counts.collect()}
    assert tokens.sum() == sum(n.values()) + 55 and 0 < len(head.words) <= 40
    share = np.zeros(head.size)
    share[L.END] = 1
    array = L.pa.array(list(n), L.pa.large_string())
    for w, c in zip(n, head.classes(head.places(array), array)):
        share[c] += 1 if 0 < c <= head.singles else (n[w] + 0.5) / 10 ** inner[c]
    share[head.beyond :] += 0.5 / 10 ** inner[head.beyond :]
    assert np.allclose(share, 1)


@pytest.mark.parametrize("most", [L.HEAD, 8])
def test_scores_against_brute_force(spark, monkeypatch, most):
    """Each token by its group's, its class's and its word's share, one by one; some words are beyond the head, some unknown."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 25), p=np.arange(30, 0, -1) / 465))) for i in range(40)] + [(100, "w1 new w2 other"), (101, None), (102, "w29")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {}

    def given(rows, tokens, noise):
        kept["model"] = model = L.LogBilinear(noise, 5)
        return model.set(rng.normal(0, 1, model.matrix().shape).astype(np.float32))

    monkeypatch.setattr(L, "trained", given)
    train = L.F.col("doc_id") < 100
    got = {r.doc_id: r.score for r in L.score(frame, train, most, 16).collect()}
    counts = L.word_counts(frame.where(train))
    head, beyond = L.head_of(counts, most, 16)
    inner, n, m = head.totals(40, beyond)[1], {r.word: r.n for r in counts.collect()}, kept["model"]
    w = {x: v.astype(float) for x, v in m.w.items()}
    for d, text in docs:
        ws, two, one, want = tokens(text), 0, 0, 0.0
        for word in [*ws, None]:
            array = L.pa.array([word or ""], L.pa.large_string())
            c = L.END if word is None else int(head.classes(head.places(array), array)[0])
            h = w["r"][one] * w["c1"] + w["r"][two] * w["c2"]
            group, own = c // m.width, slice(c // m.width * m.width, min(m.size, (c // m.width + 1) * m.width))
            level = np.exp(w["u"] @ h + w["a"])
            inside = np.exp(w["q"][own] @ h + w["b"][own])
            want += math.log10(level[group] / level.sum() * inside[c - own.start] / inside.sum())
            if c > head.singles:
                want += math.log10(n.get(word, 0) + 0.5) - inner[c]
            two, one = (0, 0) if c == L.END else (one if one != L.END else L.END, c)
        assert math.isclose(got[d], want, rel_tol=1e-4), d
