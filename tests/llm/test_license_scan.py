import random
import re

import pyarrow as pa

from gossamer.llm import license_scan as L


def test_statistics_against_brute_force():
    rng = random.Random(3)
    templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(6)]
    automaton = L.SuffixAutomaton()
    for t in templates:
        state = 0
        for w in t:
            state = automaton.append(state, w)
    for _ in range(50):
        text = [rng.randrange(5) for _ in range(20)]
        for i, (_, n) in enumerate(automaton.statistics(text)):
            ok = [k for k in range(i + 2) if any(text[i + 1 - k : i + 1] == t[j : j + k] for t in templates for j in range(len(t) + 1))]
            assert n == max(ok)


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = L.op8_suffix_automaton_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_and_clean_texts():
    cases = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the X), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute and sell", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that you ask", "bsd"),
        ("The mit. License of the state is to be as it is in the law of the land and the sea", "mit"),
        ("the people of this state and the people of that one", ""),
        ("MIT\x00License Apache-license CC BY cc  by é", "apache,cc-by,mit"),
        (None, ""), ("", ""), ("word " * 200_000 + "apache license", "apache"),
    ]
    cases += [(file, label) for label, texts in L.templates().items() for file in texts]
    for (text, labels), got in zip(cases, L.Scanner().scan(pa.array([c[0] for c in cases]))):
        assert got[:5] == brute(text) and (got[5] == labels or text in L.templates().get(labels, ()) and labels in got[5].split(","))


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", 9, "a"), (1, "mit license", 9, "a")], "doc_id long, text string, n_words int, labels string")
    assert [r.labels for r in L.scan(docs).collect()] == ["mit", "mit"]
    assert L.scan(docs.limit(0)).count() == 0


def test_chains_against_all_chains():
    rng = random.Random(5)
    for _ in range(400):
        found = []
        for _ in range(rng.randrange(1, 8)):
            n = rng.randrange(5, 12)
            found.append((0, n + rng.randrange(25), n + rng.randrange(40), n))
        best = 0

        def go(there, end, covered, found=found):
            nonlocal best
            best = max(best, covered)
            for _, t, e, n in found:
                new = n if covered == 0 else min(n, t - there, e - end)
                if new > 0 and (covered == 0 or e - new - end <= L.MAX_GAP):
                    go(t, e, covered + new)

        go(0, 0, 0)
        got = L.best_chains(found, 1)
        assert got[0][0] == best
        for words, pieces in got:
            assert words == sum(b - a for a, b in pieces) and all(a[1] <= b[0] <= a[1] + L.MAX_GAP for a, b in zip(pieces, pieces[1:]))
        spans = sorted((p[0][0], p[-1][1]) for _, p in got)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_match_between_costs_no_template():
    template = [f"t{i}" for i in range(67)]
    s = L.Scanner({"x": [" ".join(template)]}, {})
    text = [*template[:22], "z", *template[61:67], "z", *template[22:45]]
    (row,) = s.scan(pa.array([" ".join(text)]))
    assert row[5] == "x" and abs(row[6] - 45 / len(text)) < 1e-9
    (row,) = s.scan(pa.array([" ".join([*template[:30], "foreign", *template[31:], "foreign"])]))
    assert row[5] == "x" and abs(row[6] - 66 / 68) < 1e-9


def test_many_copies_of_a_licence():
    text = L.templates()["mit"][0]
    (row,) = L.Scanner().scan(pa.array([" ".join([text] * 500)]))
    assert row[5] == "mit" and len(row[7]) == 500 and row[6] == 1
