"""Operator 1: personal data by a semi-Markov conditional random field.

Rules find the base spans (e-mail, IP, card, phone). The model adds what rules miss:
numbers that run together, national phone formats, veiled addresses, keys and passwords. It labels
segments, not words: every candidate segment of at most `MAX_TOKENS` tokens (the method's bound on
an entity) has features of its whole span (digits, groups, separators, check digit, the word before), and a
dynamic program over tokens chooses boundaries and types together. Candidates hold a digit, an at
sign or a veiled one; elsewhere each token can only be outside, so stretches around
those are decoded by themselves with the same result as whole texts. A key of 16 characters or more
that mixes letters and digits, or a value behind a word such as password, is one token. Stretches have any length.

Weights are fitted here, by gradient ascent on the exact conditional likelihood
(forward and backward sums over segmentations), from sentences that `examples` makes.

A base span always stays; a model span that overlaps one is not added. Spans are in code
points, end exclusive. Null texts are empty texts: no spans, the hash of nothing. Repeated
rows are scanned alike, texts of any length whole, extra columns ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import merged, read, slices

KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
MAX_TOKENS = 24

# The base patterns. Those of ip and email are written so that a long run costs one pass.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_STRETCH = re.compile(r"[+(]{0,2}[0-9](?:[0-9 ().+/-]*[0-9])?")
_VEILED_AT = re.compile(r"[\[(]at[\])]", re.I)
_SIGN = re.compile(r"@|[\[(]at[\])]", re.I)
_NUMBERS = frozenset("0123456789 ().+/-")
_VEILED_DOMAIN = re.compile(r" ?([A-Za-z0-9-]+(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]+)+)", re.I)
_KEY = re.compile(r"[A-Za-z0-9_/+=-]{16,}")
_NAMED = re.compile(r"(?:passwor[dt]|passwd|pwd|secret|token|key|auth|credentials?)[\"']?[ ]?[:=]{1,2}[ ]?[\"']?([^\s\"']{6,})", re.I)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_CUES = {"phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "cell", "dial"}, "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"}, "ssn": {"ssn", "social"}, "email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "server", "address"}, "secret": {"token", "key", "secret", "password", "passwort", "passwd", "pwd", "auth", "credential", "credentials", "bearer"}, "other": {"order", "invoice", "version", "section", "no", "nr", "id", "ticket", "total", "page", "year", "since", "part", "commit", "sha", "md5", "hash", "uuid", "file", "path"}}


_SECRET_CUES = frozenset(_CUES["secret"])


def veiled_spans(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose at sign is spelled in brackets, each whole."""
    done = 0
    for m in _VEILED_AT.finditer(text):
        a = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        b = a
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < b and (domain := _VEILED_DOMAIN.match(text, m.end())):
            done = domain.end()
            yield a, done


def veiled(s: str) -> bool:
    return next(veiled_spans(s), None) == (0, len(s))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules, kinds in their order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, "email", m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


def word_before(text: str, at: int) -> str:
    """The word before a place, at most three separating signs between them."""
    b = at
    while b > 0 and at - b < 3 and (text[b - 1].isspace() or text[b - 1] in ":.#(=\"'"):
        b -= 1
    a = b
    while a > 0 and text[a - 1].isalpha():
        a -= 1
    return text[a:b].lower()


def secret_features(s: str) -> list[str]:
    kinds = [sum(c in "0123456789" for c in s), sum("a" <= c <= "z" for c in s), sum("A" <= c <= "Z" for c in s)]
    words = max((len(w) for w in re.findall(r"[a-z]+|[A-Z]+", s)), default=0)
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    digits = kinds[0] / len(s)
    out = [f"long-{min(6, len(s) // 8)}", "digits-" + ("none" if not digits else "few" if digits < 0.12 else "some" if digits < 0.8 else "most"), f"cases-{sum(k > 0 for k in kinds)}", f"run-{min(5, words // 3)}", f"flips-{min(5, 16 * flips // len(s))}"]
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        out.append("hex")
    if re.match(r"(AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[a-z]-|eyJ|glpat-|AIza)", s):
        out.append("known-start")
    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
        out.append("uuid")
    return out + [f"sign-{n}" for n, ok in (("slash", s.count("/") > 1), ("dash", s.count("-") > 1), ("low", s.count("_") > 1)) if ok]


Segment = tuple[int, int, str, list[str]]  # first token, end token, kind, features


def segments(text: str, tokens: list[tuple[int, int]], lo: int, hi: int) -> list[Segment]:
    """Candidate segments of the tokens of text[lo:hi], with the features of their whole spans."""
    out: list[Segment] = []
    before = word_before(text, lo)
    cues = [k for k, ws in _CUES.items() if before in ws]
    if len(tokens) == 1 and lo == tokens[0][0] and (_KEY.fullmatch(text, lo, hi) or _SECRET_CUES & {before}):
        f = ["bias", *("cue" if c == "secret" else f"cue-{c}" if c == "other" else "cue-wrong" for c in cues), *secret_features(text[lo:hi])]
        f += [n for n, ok in (("given", text[max(0, lo - 3) : lo].rstrip(" \"'")[-1:] in ("=", ":")), ("quoted", lo > 0 and text[lo - 1] in "\"'"), ("slashes", text[max(0, lo - 1) : lo] in ("/", ".") or text[hi : hi + 1] in ("/", "."))) if ok]
        return [(0, 1, "secret", [f"secret:{x}" for x in f])]
    signs = [m.start() for m in _SIGN.finditer(text, lo, hi)]
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        k = bisect_left(signs, a)
        signed = k < len(signs) and signs[k] < tokens[min(len(tokens), i + MAX_TOKENS) - 1][1]
        numbers = True
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            c, b = tokens[j - 1]
            numbers = numbers and (text[c] in _NUMBERS)
            if not (numbers or signed):
                break  # no kind has letters but no at sign
            if not text[b - 1].isalnum():
                continue
            s = text[a:b]
            d = _digits(s)
            if len(d) > 19 and not signed:
                break  # nor as many digits
            plain = set(s) <= _NUMBERS
            kinds = []
            if plain and 7 <= len(d) <= 15 and "+" not in s[1:]:
                kinds.append("phone")
            if 12 <= len(d) <= 19 and set(s) <= set("0123456789 -"):
                kinds.append("card")
            if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s):
                kinds.append("ip")
            if re.fullmatch(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}", s):
                kinds.append("ssn")
            if "@" in s or veiled(s):
                kinds.append("email")
            if not kinds:
                continue
            shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), s.replace(" ", "_")) if plain else ""
            edges = [f for f, ok in (("touch-left", a > lo and not text[a - 1].isspace() and text[a - 1] not in "("), ("touch-right", b < len(text) and (text[b : b + 1].isalnum() or text[b : b + 1] in "-/")), ("goes-on", text[b : b + 1] == "." and text[b + 1 : b + 2].isalnum()), ("near-left", a > lo and text[a - 1].isspace()), ("near-right", b < hi and text[b].isspace())) if ok]
            for kind in kinds:
                f = ["bias", *edges, *("cue" if c == kind else f"cue-{c}" if c == "other" else "cue-wrong" for c in cues)]
                if kind == "phone":
                    f += [f"digits-{len(d)}", f"groups-{len(re.findall('[0-9]+', s))}"]
                    f += [n for n, ok in (("plus", s[0] == "+"), ("brackets", re.search(r"\([0-9]{2,5}\)", s)), ("odd-brackets", s.count("(") != s.count(")")), ("north", re.fullmatch(r"(1[_.-])?\(?3\)?[_.-]{0,2}3[_.-]4", shape)), ("solid", s.isdigit()), ("date", re.search(r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)", s)), ("mixed", "/" in s), ("dots", s.count(".") > 1)) if ok]
                elif kind == "card":
                    f += ["luhn" if luhn(d) else "no-luhn", f"digits-{len(d)}", "fours" if re.fullmatch(r"4([_-]4)+|4[_-]6[_-]5", shape) else "solid" if s.isdigit() else "ragged"]
                elif kind == "ip":
                    f += ["range" if all(int(x) <= 255 for x in s.split(".")) else "no-range"]
                elif kind == "ssn":
                    f += ["dashes" if s.count("-") == 2 else "spaces"]
                else:
                    f += ["dot" if re.search(r"@[\w-]+(\.[\w-]+)+$", s) else "veiled" if "@" not in s else "no-dot", "ends" if text[a].isalnum() else "odd-start"]
                out.append((i, j, kind, [f"{kind}:{x}" for x in f]))
    return out


def key_like(s: str) -> bool:
    return not s.isalpha() and any(c in "0123456789" for c in s) and any(c.isalpha() for c in s)


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Tokens of a stretch: a key is one, and so is a value behind the name of a secret; else runs of digits, of letters, and signs."""
    if (_KEY.fullmatch(text, lo, hi) and key_like(text[lo:hi])) or (word_before(text, lo) in _SECRET_CUES and " " not in text[lo:hi]):
        return [(lo, hi)]
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


def examples(n: int = 1200, seed: int = 1) -> list[tuple[str, int, int, list[tuple[int, int, str]]]]:
    """Made sentences: text, the stretch in it, and its true spans."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if rng.random() < 0.5 else rng.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c, sep = digits(3), digits(3), digits(4), rng.choice("-. ")
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{rng.choice((33, 34, 49))} {digits(2)}{sep}{digits(4)}{sep}{digits(4)}", f"0{digits(3)} {digits(3)} {c}"))

    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    base62 = lambda k: "".join(rng.choice("0123456789" + letters + letters.upper()) for _ in range(k))
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def secret() -> str:
        return rng.choice((lambda: hexed(rng.choice((32, 40, 64))), lambda: hexed(40).upper(), lambda: base62(rng.randint(20, 48)) + digits(1), lambda: "AKIA" + base62(15).upper() + "7", lambda: "ghp_" + base62(35) + "4", lambda: "sk-" + base62(40) + "1", lambda: word() + digits(3) + rng.choice("!#%") + word()))()

    def slug() -> str:
        return rng.choice((lambda: "-".join(word() for _ in range(6)) + "-" + digits(4), lambda: "/".join(word() for _ in range(5)) + "/" + word() + digits(2), lambda: "_".join([word(), digits(4), word(), word(), word(), digits(2)]), lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: word() + word() + word() + word() + digits(2), lambda: "=" * 20 + digits(2) + word()))()

    make = {
        "card": card, "phone": phone, "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "email": lambda: rng.choice((f"{word()}.{word()}@{word()}.com", f"{word()}{digits(2)}@{word()}.org", f"{word()} (at) {word()} (dot) com", f"{word()} [at] {word()}.net", f"{word()} (at) {word()}.{word()}.com")),
    }
    other = (lambda: digits(rng.randint(1, 6)), lambda: digits(rng.randint(7, 20)), lambda: f"20{digits(2)}-{rng.randint(10, 12)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(4)}/{digits(4)}", lambda: f"{digits(2)}.{digits(2)}.20{digits(2)} {digits(2)}", lambda: " ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))), lambda: f"{digits(3)}-{digits(5)}-{digits(4)}", lambda: f"{word()}@{word()}", lambda: f"{digits(5)}-{digits(4)}", lambda: f"{digits(3)}.{digits(6)}", lambda: "300." + ".".join(digits(3) for _ in range(3)))
    out = []
    for i in range(n):
        if i % 5 == 4:  # keys: named ones, those without a name, and what looks like them
            kind = rng.choice(("named", "named", "plain", "hash", "slug", "slug"))
            text = word() + " " + (rng.choice(sorted(_SECRET_CUES)) + rng.choice((" = ", ": ", "=", ":")) if kind == "named" else rng.choice(("commit", "sha", "md5", "file", "uuid", "path")) + " " if kind == "hash" else rng.choice(("", word() + " ")))
            text += (quote := rng.choice(("", '"', "'")) if kind == "named" else "")
            piece = secret() if kind == "named" else base62(rng.randint(24, 48)) + digits(2) if kind == "plain" else hexed(rng.choice((32, 40))) if kind == "hash" else slug()
            lo, hi = len(text), len(text) + len(piece)
            out.append((text + piece + quote + rng.choice(("", ".", " " + word())), lo, hi, [(lo, hi, "secret")] if kind in ("named", "plain") else []))
            continue
        text = word() + " " + (rng.choice(sorted(w for k in _CUES for w in _CUES[k] if k != "secret")) + rng.choice((" ", ": ")) if rng.random() < 0.3 else word() + " ")
        lo, gold = len(text), []
        for k in range(rng.choice((1, 1, 1, 2, 3))):
            text += " " * (k > 0)
            kind = rng.choice([*make, "other", "other", "other"])
            if kind == "email" and k:
                kind = "card"
            piece = make[kind]() if kind in make else rng.choice(other)()
            if kind in make:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece
            if kind == "email" or "@" in piece:
                break
        hi = len(text)
        out.append((text + rng.choice((" ", ". ", ", ", "")) + word() * rng.randint(0, 1), lo, hi, gold))
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 120, l2: float = 0.02, rate: float = 0.25) -> dict[str, float]:
    """Weights of the features, by Adam on the conditional log-likelihood of the examples."""
    cases, index = [], {}
    for text, lo, hi, gold in examples():
        tokens = tokens_of(text, lo, hi)
        found = segments(text, tokens, lo, hi)
        true = {(a, b, k) for a, b, k in gold}
        rows = [(i, j, [index.setdefault(x, len(index)) for x in f], (tokens[i][0], tokens[j - 1][1], k) in true) for i, j, k, f in found]
        if rows:
            cases.append((len(tokens), rows))
    size = len(index)
    flat = [np.array(f) for _, rows in cases for _, _, f, _ in rows]
    where, which = np.repeat(np.arange(len(flat)), [len(f) for f in flat]), np.concatenate(flat)
    gold = np.array([g for _, rows in cases for *_, g in rows], float)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        score = np.bincount(where, w[which], len(flat))
        weight, expected, k = np.exp(np.clip(score, -30, 30)), np.empty(len(flat)), 0
        weights = weight.tolist()
        for n, rows in cases:  # forward and backward sums; a token outside weighs 1
            ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            starts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for r, (i, j, _, _) in enumerate(rows):
                ends[j].append((i, weights[k + r]))
                starts[i].append((j, weights[k + r]))
            ahead, back = [1.0] * (n + 1), [1.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = ahead[j - 1] + sum(ahead[i] * x for i, x in ends[j])
            for i in range(n - 1, -1, -1):
                back[i] = back[i + 1] + sum(back[j] * x for j, x in starts[i])
            for r, (i, j, _, _) in enumerate(rows):
                expected[k + r] = ahead[i] * weights[k + r] * back[j] / ahead[n]
            k += len(rows)
        g = np.bincount(which, (gold - expected)[where], size) - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return {name: float(w[i]) for name, i in index.items()}


def decode(text: str, lo: int, hi: int, weights: dict[str, float]) -> list[tuple[int, str, int]]:
    """The best segmentation of text[lo:hi]."""
    tokens = tokens_of(text, lo, hi)
    by_end: dict[int, list[tuple[int, float, str]]] = {}
    for i, j, kind, f in segments(text, tokens, lo, hi):
        by_end.setdefault(j, []).append((i, sum(weights.get(x, 0.0) for x in f), kind))
    if not by_end:
        return []
    best, came = [0.0], [None]
    for j in range(1, len(tokens) + 1):
        value, way = best[j - 1], None
        for i, score, kind in by_end.get(j, ()):
            if best[i] + score > value:
                value, way = best[i] + score, (i, kind)
        best.append(value)
        came.append(way)
    out, j = [], len(tokens)
    while j:
        if came[j]:
            i, kind = came[j]
            out.append((tokens[i][0], kind, tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where model spans can be; those of secrets first."""
    for m in _KEY.finditer(text):
        if key_like(m[0]):
            yield m.span()
    for m in _NAMED.finditer(text):
        lo, hi = m.span(1)
        while hi > lo and text[hi - 1] in ".,;:)]}!?":
            hi -= 1
        if hi - lo >= 6 and any(c in "0123456789" for c in text[lo:hi]):
            yield lo, hi
    for m in _STRETCH.finditer(text):
        if m.end() - m.start() >= 7:
            yield m.span()
    at, done = text.find("@"), 0
    while at >= 0:
        lo, hi = at, at + 1
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        yield lo, hi
        done = hi
        at = text.find("@", hi)
    yield from veiled_spans(text)


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans: base ones first, then secrets, then the model's others by place, none over another."""
    base = base_spans(text)
    model = {s for lo, hi in stretches(text) for s in decode(text, lo, hi, weights)}
    out, taken = list(base), sorted((a, b) for a, _, b in base)
    for secret in (True, False):
        extra, k, reach = [], 0, 0
        for a, kind, b in sorted(s for s in model if (s[1] == "secret") == secret):
            while k < len(taken) and taken[k][0] < b:
                reach, k = max(reach, taken[k][1]), k + 1
            if a >= reach:
                extra.append((a, kind, b))
                reach = b
        out += extra
        taken = sorted(taken + [(a, b) for a, _, b in extra])
    return base, sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    taken, extra = sorted((a, b) for a, _, b in base), []
    model = sorted({s for lo, hi in stretches(text) for s in decode(text, lo, hi, weights)})
    k, reach = 0, 0
    for a, kind, b in model:
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if a >= reach:
            extra.append((a, kind, b))
            reach = b
    return base, sorted([*base, *extra], key=lambda s: (s[0], ORDER[s[1]]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, hash of the base spans, all spans, and how many the model added, for docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(train())
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            rows = [(0, 0, 0, 0, empty, "", 0)] * len(texts)
            for i in np.flatnonzero(pc.match_substring_regex(texts, r"[0-9@]|(?i)[\[(]at[\])]").to_numpy(zero_copy_only=False)).tolist():
                base, spans = find(texts[i].as_py(), sent.value)
                n = [sum(k == kind for _, k, _ in base) for kind in KINDS[:4]]
                rows[i] = (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return merged(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, weights: dict[str, float]) -> str:
    """text with each span replaced by its kind in square brackets; spans that overlap are one."""
    out, at, end = [], 0, 0
    for a, kind, b in find(text, weights)[1]:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced; all other columns stay. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            hit = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|(?i)[\[(]at[\])]"), False).to_numpy(zero_copy_only=False)
            if hit.any():
                new = texts.to_pylist()
                for i in np.flatnonzero(hit).tolist():
                    new[i] = redacted(new[i], sent.value)
                batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
            yield batch

    return merged(docs).mapInArrow(run, docs.schema)


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
