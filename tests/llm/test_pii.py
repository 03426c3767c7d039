import hashlib
import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import pii

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub(r"[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
}


def brute(text):
    return sorted(((m.start(), k, m.end()) for k, (p, ok) in RULES.items() for m in re.finditer(p, text) if ok(m[0])), key=lambda s: (s[0], list(RULES).index(s[1])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-0123459+( )é٣", max_size=40))
def test_rules_on_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = pii.op1_semi_markov_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in RULES]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))


def test_model_adds_what_rules_miss_and_leaves_the_rest():
    w = pii.train()
    for text, want in [
        ("pay 4465758382889437 4465758382889437 now", {"card:4:20", "card:21:37"}),
        ("call (663) 555-6869 today", {"phone:5:19"}),
        ("tel: 663-555-6869.", {"phone:5:17"}),
        ("write to jo.doe (at) mail (dot) com please", {"email:9:35"}),
        ("ssn 123-45-6789 here", {"ssn:4:15"}),
        ("version 2.0 of 2024-10-12, pages 112-119, total 12345 and 3.14159", set()),
        ('token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', {"secret:9:49"}),
        ('TOKEN = "F33E61083DB5DBDF4BD2369D2F80176E57F7FDA2"!!', {"secret:9:49"}),
        ("password: hunter!2x, then more", {"secret:10:19"}),
        ("see commit f33e61083db5dbdf4bd2369d2f80176e57f7fda2", set()),
        ("a-long-title-of-a-page-about-things-2024 and some_name_of_a_file_2024_v2", set()),
        ("mail " + "a" * 80 + " (at) x.com", {"email:5:96"}),
        ("mail ab (at) " + "x" * 70 + ".com, or", {"email:5:87"}),
        ("mail a (at) " + ".".join("bcdefghij") + " or", {"email:5:29"}),
    ]:
        assert set(filter(None, pii.joined(pii.find(text, w)[1]).split(","))) == want, text


def test_decoding_is_the_best_of_all_segmentations():
    w = pii.train()
    for text, lo, hi, _ in pii.examples(40, 7):
        tokens = pii.tokens_of(text, lo, hi)
        found = [(i, j, k, sum(w.get(x, 0.0) for x in f)) for i, j, k, f in pii.segments(text, tokens, lo, hi)][:12]
        if len(found) >= 12:
            continue
        best = max(sum(s for *_, s in c) for n in range(4) for c in itertools.combinations(found, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2)))
        got = pii.decode(text, lo, hi, w)
        score = {(tokens[i][0], k, tokens[j - 1][1]): s for i, j, k, s in found}
        assert abs(sum(score[g] for g in got) - best) < 1e-9


def test_held_out_examples():
    w = pii.train()
    right = wrong = missed = 0
    for text, lo, hi, gold in pii.examples(400, 99):
        got, want = set(pii.decode(text, lo, hi, w)), {(a, k, b) for a, b, k in gold}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a@b.co " * 3, 3), (3, "a@b.co " * 3, 3), (4, "9" * 300_000 + " x" * 1000, 4), (5, "a1" * 200_000 + "@" * 20_000 + " (at)" * 9_000 + "-" * 300_000, 5)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert got[1].base_sha256 == got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert got[3].n_email == 3 and got[4].n_card == 0
    assert pii.detect(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] is None and clean[3] == "[EMAIL] " * 3
