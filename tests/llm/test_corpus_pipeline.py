from collections import Counter

import corpus_pipeline as P
from gossamer.llm import language_id, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def test_stages_on_the_fixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sf_dir = sf_dir
    known = P.durable(P.identify_language(spark, docs, sf_dir), "t")
    assert known.columns == COLUMNS
    rejected = {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()}
    assert all(not any(c.isalpha() for c in r.text or "") for r in docs.collect() if r.doc_id in rejected)
    from tests.llm.test_jaccard_join import brute

    unique = P.durable(P.drop_near_duplicates(spark, known, sf_dir), "t")
    want = {d for d, n, c in brute([(r.doc_id, r.text) for r in known.collect()]) if d == c}
    assert {r.doc_id for r in unique.collect()} == want and unique.count() == len(want)
    clean = P.durable(P.redact_personal_data(spark, unique, sf_dir), "t")
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert all(r.text == pii.redacted(texts[r.doc_id], pii.train()) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = P.durable(P.mix_sources(spark, clean, sf_dir), "t")
    copies = {r.doc_id: r.copies for r in P.mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == copies
    packed = P.pack_sequences(spark, mixed, sf_dir)
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == copies


def test_run_agrees_with_itself(spark, sf_dir):
    a, b = (sorted(r.doc_id for r in P.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


def test_edges(spark, sf_dir):
    data = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "some words to keep here now", None, "a", 27), (3, "some words to keep here now", None, "a", 27), (None, "other words a@b.co", "en", "a", 18), (5, "some words to keep here now", "en", "b", 27), (6, "123 456", "en", "a", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.withColumns({"id": P.F.lit(1), "copies": P.F.lit(2), "task": P.F.lit(3), "cls": P.F.lit(4)})
    for frame in (docs, clashing, docs.limit(0)):
        now = frame
        for _, stage in P.STAGES:
            now = P.durable(stage(spark, now, sf_dir), "t")
        assert (now.count() > 0) == (not frame.isEmpty())
    kept = P.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "6", "None"]
    assert [r.text for r in P.redact_personal_data(spark, docs, sf_dir).collect() if r.doc_id is None] == ["other words [EMAIL]"]
    model = language_id.learn(docs, language_id.F.lit(True))
    assert {r.lang for r in language_id.keep_known(docs, model).collect()} == {"en"}


def test_chance_makes_no_cluster_of_near_duplicates(spark, sf_dir, monkeypatch):
    """Rows that each share a few shingles with the next, beyond the table of frequent ones, don't meet in blocks; copies still go."""
    from gossamer.llm import jaccard_join

    words = lambda k, a, n: " ".join(f"{k}{a}x{i}" for i in range(n))
    rows = [(i, f"{words('u', i, 60)} {words('p', i, 7)} {words('p', (i + 1) % 80, 7)}", "en", "s", 0) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(0, 80, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes, durable = {}, jaccard_join.durable

    def counted(df, name, *args, **kwargs):
        out = durable(df, name, *args, **kwargs)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "durable", counted)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf_dir).collect()) == list(range(80))
    assert sizes["clusters"] == 16


def test_near_copies_take_no_more_disk_than_their_texts(spark, sf_dir, monkeypatch):
    """Where all rows are near copies of others, the table of sets is no longer than the texts, not 8 bytes a shingle."""
    from gossamer.llm import jaccard_join

    rows = [(i * 4 + k, " ".join(f"w{i}x{j}" for j in range(60)) + f" tail{k}", "en", "s", 0) for i in range(50) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held, durable = {}, jaccard_join.durable

    def weighed(df, name, *args, **kwargs):
        out = durable(df, name, *args, **kwargs)
        if name == "sets":
            held[name] = out.agg(P.F.sum(P.F.length("elements"))).first()[0]
        return out

    monkeypatch.setattr(jaccard_join, "durable", weighed)
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf_dir).collect()) == list(range(0, 200, 4))
    assert held["sets"] <= sum(len(r[1]) for r in rows)
