import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import jaccard_join as J
from gossamer.llm.components import connected_components


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 25), st.integers(1, 30))
def test_block_join_against_all_pairs(seed, m, width):
    rng = random.Random(seed)
    base, sets = [set(rng.sample(range(200), width)) for _ in range(3)], []
    for _ in range(m):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(6)):
            s ^= {rng.randrange(200)}
        if s:
            sets.append(np.array(sorted(s), np.uint64))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def parts(pairs):
        tree = J.Union(len(sets))
        for i, j in pairs:
            tree.join(i, j)
        return [tree.find(i) for i in range(len(sets))]

    def same(labels, want):
        first = {}
        return [first.setdefault(x, i) for i, x in enumerate(labels)] == want

    assert same(J.link_sets(sets).tolist(), parts(links))
    asked = np.array([rng.random() < 0.4 for _ in sets], bool)
    start = [(i, j) for i, j in links if rng.random() < 0.3]
    got = J.link_sets(sets, start=np.array(parts(start), np.int64), asked=asked).tolist()
    assert same(got, parts(start + [(i, j) for i, j in links if asked[i] or asked[j]]))


def brute(docs):
    sets = {}
    for k, (_, text) in enumerate(docs):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[k] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {}
    for k, s in sets.items():
        for e in s:
            seen.setdefault(e, []).append(k)
    near = {k: {x for e in s for x in seen[e] if x < k} for k, s in sets.items()}
    for k, others in near.items():
        for x in others:
            if 100 * len(sets[k] & sets[x]) >= 80 * len(sets[k] | sets[x]):
                a, b = find(k), find(x)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)), key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_fixture_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert rows_of(J.op5_ngram_jaccard_join(spark, "/root/testdata/sf0.01")) == brute(docs)


def family(n, words=60, edits=4, seed=2):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randrange(edits)):
            ws[rng.randrange(words)] = f"x{rng.randrange(40)}"
        out.append((1000 - i, " ".join(ws)))
    return out


@pytest.mark.parametrize("block,split,bucket,rows", [(J.BLOCK, J.SPLIT, J.BUCKET, J.ROWS), (200, 9, 500, J.ROWS), (700, 9, 100, 1), (J.BLOCK, J.SPLIT, J.BUCKET, 7)])
def test_large_groups_in_blocks(spark, block, split, bucket, rows):
    rng = random.Random(9)
    docs = family(120) + family(40, 30, 6, 3) + [(2000 + i, " ".join(f"u{rng.randrange(999)}" for _ in range(20)) + " the passage that all of these documents share is here") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(J.join(frame, block=block, split=split, bucket=bucket, rows_a_block=rows)) == brute(docs)


def test_blocks_of_large_clusters_meet_in_rounds(spark, monkeypatch):
    """Copies of sets that blocks deal are bounded at a time; texts longer than the hashes of their shingles go as hashes."""
    rng = random.Random(9)
    docs = family(120) + [(2000 + i, " ".join(f"u{rng.randrange(999)}" for _ in range(20)) + " the passage that all of these documents share is here") for i in range(60)]
    docs += [(3000 + i if i % 3 else None, "one two three four five six seven " * 60 + f"end{i % 7}") for i in range(30)]
    written, durable = [], J.durable

    def noted(df, name, *args, **kwargs):
        written.append(name)
        out = durable(df, name, *args, **kwargs)
        if name == "sets":
            assert {r.hashed for r in out.select("hashed").distinct().collect()} == {True, False}
        return out

    monkeypatch.setattr(J, "durable", noted)
    monkeypatch.setattr(J, "ROUND", 1)
    assert rows_of(J.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block=200, rows_a_block=1)) == brute(docs)
    assert written.count("links") > 3


def test_passages_shared_by_chance_tie_no_clusters(spark, monkeypatch):
    """Documents that each share a few shingles with the next, beyond the table of frequent ones, are no cluster: a large corpus
    would be one, and all its blocks would meet. Real links stay."""
    rng = random.Random(4)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(7)) for _ in range(150)]
    docs = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) + f" {passages[i]} {passages[(i + 1) % 150]}") for i in range(150)]
    docs += [(200 + i, docs[i][1] + " tail") for i in range(0, 150, 10)]
    sizes, durable = {}, J.durable

    def counted(df, name, *args, **kwargs):
        out = durable(df, name, *args, **kwargs)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(J, "durable", counted)
    monkeypatch.setattr(J, "FREQUENT", 0)
    assert rows_of(J.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs)
    assert sizes["clusters"] <= 30 and sizes["weights"] <= 15


def test_maps_tell_the_counts_of_keys():
    import pandas as pd

    bits, elements = 6, 1 << 20
    rng = np.random.default_rng(5)
    counts = {int(x): int(c) for x, c in zip(rng.integers(0, 1 << 62, 400).astype(np.uint64) * np.uint64(4), rng.integers(1, 15, 400))}
    wide = J.map_bits(elements, bits)
    parts = {}
    for e, c in counts.items():
        key = int(J.order_key(np.uint64(e), bits))
        parts.setdefault(key >> 32, []).extend([key & 0xFFFFFFFF] * c)
    made = [J.count_keys(bits, wide)(pd.DataFrame({"bucket": [b], "keys": [np.array(x, np.uint32).tobytes()]})) for b, x in parts.items()]
    for i, (least, _) in enumerate(J.TIMES):
        cells = np.zeros(1 << (wide[i] - 3), np.uint8)
        for r in (r for m in made for r in m[m["level"] == -1 - i].itertuples()):
            cells[r.bucket << (wide[i] - 3 - bits) : (r.bucket + 1) << (wide[i] - 3 - bits)] = np.frombuffer(r.keys, np.uint8)
        want = {e >> (64 - wide[i]) for e, c in counts.items() if c >= least}
        assert set(np.flatnonzero(np.unpackbits(cells, bitorder="little")).tolist()) == want
    got = {int(k): int(t) for m in made for r in m[m["level"] >= 0].itertuples() for k, t in zip(np.frombuffer(r.keys, np.int64), np.frombuffer(r.times, np.int64))}
    assert got == {int(J.order_key(np.uint64(e), bits)): c for e, c in counts.items() if c > 2}


def test_edges(spark):
    docs = [(5, None), (4, ""), (9, "a b"), (8, "A  B"), (7, "a b c"), (3, " \t "), (2, "x " * 300_000), (1, "x " * 7), (6, "one two three four five six"), (6, "one two three four five six")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, cls int")
    assert rows_of(J.join(frame)) == brute(docs)
    assert J.join(frame.limit(0)).count() == 0


def test_rows_without_an_id_join_others(spark):
    def text(a):
        return " ".join(f"w{i}" for i in range(a, a + 50))

    docs = [(1, text(0)), (None, text(4)), (3, text(8)), (None, text(100)), (None, text(103)), (None, None), (7, text(4) + " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(J.join(frame.where("doc_id is null or doc_id < 7"))) == brute(docs[:-1])
    assert rows_of(J.join(frame)) == brute(docs)
    assert [r for r in rows_of(J.join(frame.where("doc_id is null or doc_id < 7"))) if r[0] == 3][0][2] == 1


def test_many_near_copies_take_no_pairs():
    import time

    rng = np.random.default_rng(0)
    sets = [np.unique(np.concatenate([np.arange(8), rng.integers(1000, 10**9, 1)])).astype(np.uint64) for _ in range(8000)]
    begin = time.time()
    assert len(set(J.link_sets(sets).tolist())) == 1
    assert time.time() - begin < 20


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, x) for x in range(501, 560)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)


def test_sql_against_brute_force():
    import duckdb

    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    docs = c.execute("select doc_id, text from documents").fetchall()
    assert sorted(c.execute(J.ORACLE).fetchall(), key=str) == brute(docs)
