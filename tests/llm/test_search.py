import numpy as np
import pytest

from gossamer.llm import ann, hash_search
from gossamer.llm.queries import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<float>, code int, rank string"


def rows(spark, sf):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}


def edge_rows():
    rng = np.random.default_rng(4)
    v = [rng.normal(size=64).astype("float32").tolist() for _ in range(30)]
    out = [(i, v[i % 30], 1, "x") for i in range(60)] + [(i, v[0], 1, "x") for i in range(100, 400)]
    return out + [(500, None, 1, ""), (550, [0.0] * 64, 1, ""), (600, [float("nan")] + [1.0] * 63, 1, ""), (650, [None] + [1.0] * 63, 1, ""), (700, [float("inf")] * 64, 1, ""), (750, [], 1, ""), (800, [1.0] * 3, 1, "")]


def test_hilbert_keys_are_a_walk_through_all_cells():
    for m, levels in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << levels)] * m, indexing="ij"), -1).reshape(-1, m)
        order = np.argsort(ann.hilbert_keys(cells, levels))
        assert sorted(ann.hilbert_keys(cells, levels).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    v = rows(spark, sf)
    ids, x = np.array(list(v)), np.stack(list(v.values()))
    got = {}
    for r in ann.op3_hilbert_neighbours(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append(r)
        assert abs(r.score - ann.cosines(v[r.query_id], v[r.vec_id][None])[0]) < 1e-12
    hits = []
    for q in ids[ids % 50 == 0]:
        s = ann.cosines(v[q], x)
        best = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:5]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits.append(len({r.vec_id for r in mine} & set(best)) / 5)
    assert np.mean(hits) >= 0.9


def test_neighbours_with_copies_and_bad_vectors(spark):
    data = edge_rows()
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {d[0]: np.array(d[1], "float32").astype(float) for d in data if d[0] < 500}
    ids, x = np.array(list(good)), np.stack(list(good.values()))
    assert sorted(got) == [i for i in good if i % 50 == 0]
    for q, near in got.items():
        s = ann.cosines(good[q], x)
        want = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:5]
        assert [v for _, v, _ in sorted(near)] == want
    assert ann.nearest(spark.createDataFrame(data, SCHEMA).limit(0)).count() == 0
    assert ann.nearest(spark.createDataFrame(data[:1] + data[-1:], SCHEMA)).count() == 0


def test_multi_index_is_exact():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 64), (7, 64), (300, 64), (2000, 9)):
        codes = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64((1 << spread) - 1 if spread < 64 else 2**64 - 1))
        rank = rng.permutation(len(codes))
        index = hash_search.MultiIndex(codes)
        for q in [*codes[:5].tolist(), 0, 2**64 - 1, 12345678901234567]:
            at, d = index.search(q, 6, rank)
            every = np.bitwise_count(codes ^ np.uint64(q)).astype(int)
            want = np.lexsort((rank, every))[:6]
            assert at.tolist() == want.tolist() and d.tolist() == every[want].tolist()


def test_hash_search_with_copies_and_bad_vectors(spark):
    data = edge_rows()
    frame = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in hash_search.nearest(frame.select("vec_id", hash_search.sign_code(frame.embedding).alias("code")), every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.distance))
    good = {d[0]: np.array(d[1]) > 0 for d in data if d[0] < 500 or d[0] == 550}
    assert sorted(got) == [i for i in good if i % 50 == 0]
    for q, near in got.items():
        want = sorted((int((good[q] != b).sum()), i) for i, b in good.items() if i != q)[:10]
        assert [(d, v) for _, v, d in sorted(near)] == want
    assert hash_search.nearest(frame.limit(0).select("vec_id", hash_search.sign_code(frame.embedding).alias("code"))).count() == 0


def test_hash_search_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = c.execute(ORACLE_SQL["op9_multi_index_hashing"]).fetchall()
    assert sorted(want) == sorted(map(tuple, hash_search.op9_multi_index_hashing(spark, "/root/testdata/sf0.01").collect()))


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(6)
    v = [rng.normal(size=64).astype("float32").tolist() for _ in range(40)]
    once = [(i, v[i], 1, "x") for i in range(40)]
    asked = lambda data: sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(data, SCHEMA), every=10).collect())
    want = asked(once)
    assert len(want) == 4 * 5
    near = want[0][2]
    assert asked(once + once[:1] * 6 + once[10:11] + once[near : near + 1] * 7) == want


def test_other_lengths_are_searched_by_themselves(spark):
    rng = np.random.default_rng(8)
    v = {i: rng.normal(size=(64, 3, 5)[i % 3]).astype("float32") for i in range(90)}
    frame = spark.createDataFrame([(i, x.tolist(), 1, "x") for i, x in v.items()], SCHEMA)
    got = {}
    for r in ann.nearest(frame, every=10, queries=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 90, 10):
        ids = np.array([i for i in v if i % 3 == q % 3 and i != q])
        s = ann.cosines(v[q].astype(float), np.stack([v[i] for i in ids]).astype(float))
        assert [i for _, i in sorted(got[q])] == ids[np.lexsort((ids, -s))][:5].tolist()
