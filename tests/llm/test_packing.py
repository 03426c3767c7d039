import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gossamer.llm import packing

TEXTS = ["", None, "the", "a  b", " a", "a ", "a \n b", "a\n\n b c", "it's <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|> <|endoftext|", "déjà vu\x85 x", "word " * 5000, "x" * 9000, "same text", "same text", "　 z", "a\x1c b \x1cc"]


T = Tokenizer.from_file(packing.tokenizer_path())


def direct(text):
    return T.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    encode = packing.encoder(packing.tokenizer_path())
    for text in filter(None, TEXTS):
        assert encode(text).tolist() == direct(text), text


def test_ids_of_the_fixture(spark, sf_dir):
    t, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert encode(r.text).tolist() == t.encode(r.text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab '\n\t  .1é\x0b\x1f\x00\u2028😀", "<|endoftext|>", "<|"]), max_size=14))
def test_ids_of_any_text(parts):
    text = "".join(parts)
    assert packing.encoder(packing.tokenizer_path())(text).tolist() == T.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=12))
def test_plan_places_every_item_once_without_gaps(histogram):
    slots, bins = packing.plan(histogram, 20)
    used = {}
    for a, n in histogram.items():
        begin, first, offset = slots[a]
        for rank in range(n):
            k = np.searchsorted(begin, rank, "right") - 1
            used.setdefault(int(first[k] + rank - begin[k]), []).append((int(offset[k]), a))
    for places in used.values():
        at = 0
        for offset, a in sorted(places):
            assert offset == at
            at += a
        assert at <= 20
    assert len(used) == bins >= -(-sum(a * n for a, n in histogram.items()) // 20)


def optimum(items, room):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, r in enumerate(rooms):
            if r >= items[i] and r not in rooms[:k]:
                go(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, room - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.integers(8, 30), st.data())
def test_dominance_never_costs_a_sequence(room, data):
    items = data.draw(st.lists(st.integers(1, data.draw(st.integers(2, room))), min_size=1, max_size=12))
    count = np.bincount(items, minlength=room + 1)
    fixed = packing.reduce_by_dominance(count, room)
    left = [a for a in range(room, 0, -1) for _ in range(count[a])]
    assert sum(n for _, n in fixed) + optimum(left, room) == optimum(sorted(items, reverse=True), room)


def test_three_small_items_beside_a_large_one():
    assert packing.plan({20: 1, 11: 2, 8: 1, 3: 3}, 30)[1] == 2


def test_a_large_corpus_is_planned_by_its_histogram():
    slots, bins = packing.plan({a: 10**9 + a for a in range(1, packing.CAPACITY + 1)})
    assert bins * packing.CAPACITY < 1.001 * sum(a * (10**9 + a) for a in range(1, packing.CAPACITY + 1))
    assert sum(len(begin) for begin, _, _ in slots.values()) < 200_000
    slots, bins = packing.plan({a: 10**9 + a for a in range(500, packing.CAPACITY + 1)})
    assert sum(len(begin) for begin, _, _ in slots.values()) < 200_000


def test_query_against_the_tokenizer(spark):
    rows = [(i, t, "extra", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, task int").repartition(3)
    got = packing.pack(docs).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        ids, at = [*direct(text), 0], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
    for places in ({s: [r for r in got if r.sequence_id == s] for s in {r.sequence_id for r in got}}).values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0
