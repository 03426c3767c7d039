import re
from collections import defaultdict

import numpy as np

from gossamer.llm import mixing


def fill(size, most=3):
    """Targets by hand: weights 1, 2, 3 in order of source, null last."""
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight, total, shut = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values()), {}
    while True:
        rest = [s for s in names if s not in shut]
        if not rest:
            return shut
        left, w = total - sum(shut.values()), sum(weight[s] for s in rest)
        above = [s for s in rest if left * weight[s] / w > most * size[s] + 1e-9]
        if not above:
            return shut | {s: left * weight[s] / w for s in rest}
        shut |= {s: most * size[s] for s in above}


def check(docs, got):
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, source_of = fill(size), defaultdict(int), {d: s for d, _, s in docs}
    for r in got:
        s = source_of[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == size[s]
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in want:
        largest = max([len((t or "").split()) for _, t, x in docs if x == s])
        assert abs(taken[s] - want[s]) <= max(1, largest)
    assert len(got) == len(docs)


def test_fixture(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = mixing.op10_entropy_balanced_mix(spark, sf_dir).collect()
    check(docs, got)
    assert sorted(got) == sorted(mixing.op10_entropy_balanced_mix(spark, sf_dir).collect())


def test_edges(spark):
    docs = [(1, "a b c", "x"), (2, None, None), (3, "", ""), (4, "one word two", None), (5, "q " * 3000, "hot"), (6, "q " * 3000, "hot"), (7, "a", "zz"), (8, "a", "zz"), (8, "a", "zz")]
    frame = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, source string, size int, salt int")
    check(docs, mixing.mix(frame).collect())
    assert mixing.mix(frame.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(frame.where("text is null")).collect()} == {0}


def test_rates_meet_the_conditions_of_the_optimum(spark):
    """Sources exact, bands balanced against their penalty, rates exponential up to the cap: the one optimum of the convex dual."""
    rng = np.random.default_rng(4)
    for n in (1, 3, 40):
        mass = rng.integers(0, 10**6, (n, mixing.BANDS)) * (rng.random((n, mixing.BANDS)) < 0.6)
        mass[0, 2] += 5
        size = mass.sum(1)
        target = size * rng.choice([0.0, 0.01, 0.4, 1.0, 2.5, 2.95, 3.0], n)
        target[0] = size[0] * 0.7
        rows = [(f"s{i}", float(target[i]), int(size[i]), *map(int, mass[i])) for i in range(n)]
        frame = spark.createDataFrame(rows, "source string, target double, source_size long, " + ", ".join(f"m{k} long" for k in range(mixing.BANDS)))
        got, mu = mixing.balanced(frame)
        x = {r.source: r.x for r in got.collect()}
        x = np.array([-np.inf if x[f"s{i}"] is None else x[f"s{i}"] for i in range(n)])
        rate = np.minimum(mixing.MOST, np.exp(np.minimum(x[:, None] + mu, 50)))
        assert np.allclose((mass * rate).sum(1), target, rtol=1e-6, atol=1e-3)
        aim = mass.sum(0) / size.sum() * target.sum()
        assert np.allclose((mass * rate).sum(0) + mixing.LOOSE * aim * mu, aim, rtol=1e-5, atol=1e-5 * size.sum())


def test_lengths_stay_near_the_corpus(spark):
    """A source of short texts that gains leaves the share of long words higher than rates by source alone would."""
    docs = [(i, "w " * 5, "a") for i in range(900)] + [(1000 + i, "w " * 400, "a") for i in range(30)] + [(2000 + i, "w " * 5, "b") for i in range(100)] + [(3000 + i, "w " * 400, "b") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    check(docs, mixing.mix(frame).collect())
    rates = {(r.doc_id // 1000, r.size): r.rate for r in mixing.mix(frame).collect()}
    assert len(set(rates.values())) == 4
    a = rates[0, 5] / rates[1, 400]
    assert np.isclose(a, rates[2, 5] / rates[3, 400], rtol=1e-6)
