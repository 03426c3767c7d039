"""Operator 8: licence scans by a generalised suffix automaton of licence wording.

The templates are whole public licence texts (the files of `licences`, named label.name.txt) and
the usual notices. Their words make one automaton. Streaming a text through it gives matching
statistics: at each word the longest run ending there that some template has. A word
that no template has resets the automaton, so only runs of template words of at least
`MIN_MATCH` are streamed; all shorter matches are dropped anyway. Long maximal matches
are chained for each template (both places rising, gaps of at most `MAX_GAP` words) so that a
chain covers as many words as any can; a chain that covers enough of a template makes its label
and a span. The score is the share of a text's words that matches and base phrases cover, gaps left out.

Base phrases are counted wherever their words stand consecutively, and their labels stay.
Nulls are empty texts: no words, no label, score 0. Repeated rows are scanned alike, extra
columns ignored, texts of any length scanned whole.
"""

from __future__ import annotations

import importlib.resources
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import merged, read, slices, words

# The base phrases with their labels, and licence wording.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit",
    ],
    "cc-by-sa": [
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ],
}
MIN_MATCH = 5  # words of a match that may be chained
MAX_GAP = 12  # words between two matches of a chain
COVER = 0.5  # part of a template that a chain must cover
LEAST = 8  # words that a chain must cover

#: Word characters are ASCII letters and digits, and all beyond ASCII.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def templates() -> dict[str, list[str]]:
    """All templates by label: the files of `licences`, and the notices."""
    out = {label: list(ts) for label, ts in NOTICES.items()}
    for file in sorted(importlib.resources.files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            text = file.read_bytes().translate(_PLAIN).decode()
            out.setdefault(file.name.split(".")[0], []).append(" ".join(text.split()))
    return out


Match = tuple[int, int, int, int]  # template, end there, end in the text, words


def best_chains(found: list[Match], cover: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For one template's matches: (words covered, pieces of the text) of the chains that cover at least `cover` words,
    the best first and none over another. A chain goes on with the part of a match that lies beyond its end in both."""
    found = sorted(found, key=lambda m: (m[2], m[1], m[3]))
    best: list[tuple[int, int, int, int]] = []  # words, the match before or -1, words of the own piece, start
    for j, (_, there, end, n) in enumerate(found):
        top = (n, -1, n, end - n)
        for i in range(j - 1, -1, -1):
            _, there_i, end_i, _ = found[i]
            if end_i < end - n - MAX_GAP:
                break
            new = min(n, there - there_i, end - end_i)
            if new > 0 and end - new - end_i <= MAX_GAP and best[i][0] + new > top[0]:
                top = (best[i][0] + new, i, new, best[i][3])
        best.append(top)
    out, taken = [], []
    for j in sorted(range(len(found)), key=lambda j: (-best[j][0], found[j][2])):
        if best[j][0] < cover:
            break
        a, b = best[j][3], found[j][2]
        k = bisect_left(taken, (a, b))
        if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
            continue
        insort(taken, (a, b))
        pieces, i = [], j
        while i >= 0:
            pieces.append((found[i][2] - best[i][2], found[i][2]))
            i = best[i][1]
        out.append((best[j][0], pieces[::-1]))
    return out


@dataclass
class SuffixAutomaton:
    """Of several word sequences; ends[state]: (template, end) places where the state's strings end, found on demand."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def append(self, last: int, word: int) -> int:
        """The state of last's string and the word behind it."""
        if (q := self.step[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def statistics(self, text: list[int]) -> list[tuple[int, int]]:
        """For each word: the state and the length of the longest known string that ends there."""
        out, state, n = [], 0, 0
        for word in text:
            while state and word not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.step[state]:
                state, n = self.step[state][word], n + 1
            out.append((state, n))
        return out


class Scanner:
    def __init__(self, texts: dict[str, list[str]] | None = None, phrases: dict[str, str] = PHRASES) -> None:
        self.templates = [(label, t.split()) for label, ts in sorted((templates() if texts is None else texts).items()) for t in ts]
        vocabulary = sorted({w for _, t in self.templates for w in t} | {w for p in phrases for w in p.split()})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.words = pa.array(vocabulary, pa.large_string())
        self.phrases = [([self.ids[w] for w in p.split()], label) for p, label in phrases.items()]
        self.automaton, states = SuffixAutomaton(), []
        for k, (_, t) in enumerate(self.templates):
            state = 0
            for end, w in enumerate(t, 1):
                state = self.automaton.append(state, self.ids[w])
        for k, (_, t) in enumerate(self.templates):  # states may have been split since
            state = 0
            for end, w in enumerate(t, 1):
                state = self.automaton.step[state][self.ids[w]]
                states.append((state, k, end))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.automaton.step]
        for state, k, end in states:
            while state > 0:
                self.ends[state].append((k, end))
                state = self.automaton.link[state]

    def matches(self, ids: list[int]) -> list[Match]:
        """(template, end there, end in ids, words) of the maximal matches of MIN_MATCH words or more."""
        got, out = self.automaton.statistics(ids), []
        for i, (state, n) in enumerate(got):
            if n >= MIN_MATCH and (i + 1 == len(got) or got[i + 1][1] <= n):
                out += [(k, end, i + 1, n) for k, end in self.ends[state]]
        return out

    def spans(self, found: list[Match]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
        """(label, start, end, pieces) of the chains that cover their template; found: matches with places in the whole text."""
        by_template: dict[int, list[Match]] = {}
        for m in found:
            by_template.setdefault(m[0], []).append(m)
        out = []
        for k, own in sorted(by_template.items()):
            label, template = self.templates[k]
            cover = max(LEAST, -int(-COVER * len(template) // 1))
            if sum(m[3] for m in own) >= cover:
                out += [(label, pieces[0][0], pieces[-1][1], pieces) for _, pieces in best_chains(own, cover)]
        return out

    def scan(self, texts: pa.Array) -> list[tuple]:
        """For each text: words, base places, first and last, base labels, labels, score, spans."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        plain = bytes(texts.buffers()[2][offsets[0] : offsets[-1]]).translate(_PLAIN) if texts.buffers()[2] else b""
        clean = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)])
        got, begin = words(clean)
        d = got.dictionary_encode()
        known = pc.fill_null(pc.index_in(d.dictionary, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = known[d.indices.to_numpy(zero_copy_only=False)] if len(got) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), np.diff(begin))
        base: dict[int, list[tuple[int, int, str]]] = {}
        for phrase, label in self.phrases:
            k = len(phrase)
            if len(ids) >= k:
                hit = np.logical_and.reduce([ids[j : len(ids) - k + 1 + j] == w for j, w in enumerate(phrase)]) & (doc[: len(ids) - k + 1] == doc[k - 1 :])
                for at in np.flatnonzero(hit).tolist():
                    base.setdefault(int(doc[at]), []).append((at - int(begin[doc[at]]), k, label))
        found: dict[int, list[Match]] = {}
        inside = ids >= 0
        edge = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1]), [True]])) if len(ids) else np.zeros(1, int)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= MIN_MATCH and inside[a]:
                k, shift = int(doc[a]), a - int(begin[doc[a]])
                found.setdefault(k, []).extend((t, end, i + shift, m) for t, end, i, m in self.matches(ids[a:b].tolist()))
        out = []
        for i, count in enumerate(np.diff(begin).tolist()):
            places, spans = base.get(i, []), self.spans(found[i]) if i in found else []
            labels = {p[2] for p in places}
            starts = [p[0] for p in places]
            covered = sorted([(a, a + k) for a, k, _ in places] + [p for s in spans for p in s[3]])
            total, reach = 0, 0
            for a, b in covered:
                total, reach = total + max(0, b - max(a, reach)), max(reach, b)
            out.append((count, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), total / count if count else 0.0, spans))
        return out


@lru_cache(maxsize=1)
def scanner(texts: tuple[tuple[str, tuple[str, ...]], ...]) -> Scanner:
    """One for all tasks of a Python worker."""
    return Scanner({label: list(ts) for label, ts in texts})


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the counts, labels and the covered spans (label, first word, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple((label, tuple(ts)) for label, ts in sorted(templates().items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = scanner(sent.value)
        for batch in slices(batches):
            columns = [list(c) for c in zip(*scans.scan(batch.column("text")))]
            spans = ["; ".join(f"{label} {a}-{b}" for label, a, b, _ in s) for s in columns.pop()]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array(spans)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return merged(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op8_suffix_automaton_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
