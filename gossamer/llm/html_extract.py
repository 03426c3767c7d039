"""Operator 6: main text of pages by a linear-chain conditional random field.

A page is read once from left to right into leaf blocks: the text between two tags that
are not inline, with the tags open above it, what their class, id and role say, and
features of its text. A chain over the blocks with two labels (main, other) is fitted here
on labelled pages that `labelled_pages` makes, by gradient ascent on the exact conditional
likelihood, and decoded by Viterbi. Main blocks are joined in page order by one space.

Scripts, styles, templates, the head, comments of the markup and form controls are never
text. Null or empty html gives the empty text. Pages that end anywhere, repeated rows and
html of any length are read whole, in time that grows with the length; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import merged, read, slices

# Kinds of tags, and words of class, id and role with what they tell.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template head noscript textarea select svg math iframe object title canvas audio video".split())
NOTED = frozenset("article main nav header footer aside form section table ul ol li figure figcaption blockquote p h1 h2 h3 h4 h5 h6 dl address button label details td body div pre".split())
TOLD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip sitemap",
    "head": "header masthead topbar logo branding siteheader hero",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget widgets rail related recommended trending popular more tags",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner adsense taboola outbrain adbox",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay warning notification message toast privacy",
    "form": "form login signup signin subscribe subscription newsletter search register contact poll survey",
    "talk": "comment comments reply replies respond discussion disqus commentlist reviews thread",
    "share": "share social sharing follow facebook twitter",
    "text": "article post story entry content body text main page maincontent articlebody postcontent entrycontent",
}
_TOLD = {w: k for k, ws in TOLD.items() for w in ws.split()}
CUES = {
    "copyright": ("©", "copyright", "all rights reserved"),
    "consent": ("cookie", "consent", "privacy policy", "terms of"),
    "call": ("subscribe", "sign up", "log in", "newsletter", "click here", "read more", "share this", "advertisement", "sponsored"),
    "said": ("reply", "says:", "posted by", "comments"),
}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

Block = tuple[str, list[str]]


def told(attrs: str) -> set[str]:
    """What an element's class, id and role tell."""
    out = set()
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            for w in (*_PART.findall(value), *value.lower().split()):
                if (k := _TOLD.get(w.lower().replace("-", "").replace("_", ""))) is not None:
                    out.add(k)
    return out


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page: text and features."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    solid: list[str] = []  # the open tags that are not inline
    above: Counter[str] = Counter()  # what the open elements are and tell
    open_tags: Counter[str] = Counter()
    piece: list[str] = []
    linked = 0
    headed = False

    def flush() -> None:
        nonlocal linked, headed
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append((text, features(text, linked)))
            piece.clear()
        linked = 0

    def features(text: str, linked: int) -> list[str]:
        words, low = text.count(" ") + 1, text.lower()
        f = ["bias", *(f"in-{k}" for k, n in above.items() if n)]
        f.append(f"by-{solid[-1]}" if solid else "by-none")
        f.append("words-" + ("1" if words < 2 else "2" if words < 4 else "4" if words < 10 else "10" if words < 30 else "30" if words < 80 else "80"))
        share = linked / len(text)
        f.append("linked-all" if share > 0.8 else "linked-some" if share > 0.3 else "linked-no")
        if text[-1] in ".!?…:\"'”":
            f.append("ends")
        f += [f"cue-{k}" for k, ws in CUES.items() if any(w in low for w in ws)]
        if not above["article"] and not above["main"] and not above["told-text"]:
            f.append("no-home")
        if not headed:
            f.append("before-h1")
        return f

    def close(at: int) -> None:
        while len(stack) > at:
            tag, marks = stack.pop()
            open_tags[tag] -= 1
            if tag not in INLINE:
                solid.pop()
            for m in marks:
                above[m] -= 1

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            text = html.unescape(text) if "&" in text else text
            piece.append(text)
            if open_tags["a"]:
                linked += len(text.strip())
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            if not re.match(r"/?[A-Za-z]", page[lt + 1 : lt + 3]):  # a bare sign
                piece.append("<")
                at = lt + 1
                continue
            end = page.find(">", lt)
            if end < 0:
                break
            m = re.match(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", page[lt : end + 1])
            at = end + 1
        else:
            at = m.end()
        shut, tag, attrs = bool(m[1]), m[2].lower(), m[3]
        if tag not in INLINE:
            flush()
        if shut:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
                headed |= tag == "h1"
            continue
        if tag in SILENT and not attrs.endswith("/"):
            end = _find(page, tag, at)
            if tag == "head" and end < 0:
                body = re.compile("<body", re.I).search(page, at)
                end = body.start() if body else -1
            at = n if end < 0 else end
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and solid and solid[-1] == "p":  # a block ends the paragraph before it
            k = len(stack) - 1
            while stack[k][0] != "p":
                k -= 1
            close(k)
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        marks = [f"told-{k}" for k in told(attrs)]
        if tag in NOTED and tag not in ("div", "body", "p"):
            marks.append(tag)
        stack.append((tag, tuple(marks)))
        if tag not in INLINE:
            solid.append(tag)
        open_tags[tag] += 1
        above.update(marks)
    flush()
    return out


def _find(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I | re.A).search(page, at)
    return m.start() if m else -1


def labelled_pages(n: int = 700, seed: int = 5) -> list[list[tuple[str, bool]]]:
    """Made pages as lists of (markup, is main text) in page order; the markup of all parts together is the page."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstnlmdkp") for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice((".", ".", "!", ""))
    one = lambda *x: rng.choice(x)
    links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def box(kind: str, inner: str) -> str:
        name = rng.choice(TOLD[kind].split())
        tag = one("div", "div", "section", "aside", "ul" if "<li>" in inner else "div")
        return f'<{tag} {one("class", "class", "id")}="{one(name, name, name + "-" + word(), word() + " " + name)}">{inner}</{tag}>'

    def other(kind: str) -> str:
        long = sentence(2, 60)
        if kind == "menu":
            inner = f"<ul>{links(rng.randint(2, 8))}</ul>"
            return one(f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", box("menu", inner))
        if kind == "head":
            inner = f'{one("", f"<a href=/>{words(1, 2)}</a>")}<{one("p", "div", "span")}>{words(1, 8)}</{one("p", "div", "span")}>'
            return one(f"<header>{inner}</header>", box("head", inner))
        if kind == "foot":
            inner = one(f"&copy; {word()}.com &middot; {long}", f"<p>{long}</p>", f"<p>Copyright 2020 {word()}. All rights reserved.</p><ul>{links(3)}</ul>")
            return one(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", box("foot", inner))
        if kind == "side":
            inner = one(f"<h3>{words(1, 3)}</h3><ul>{links(5)}</ul>", f"<h2>{words(1, 4)}</h2><p>{long}</p>")
            return one(f"<aside>{inner}</aside>", box("side", inner))
        if kind == "talk":
            inner = f"<h3>{one('Comments', words(1, 2))}</h3>" + "".join(one(f"<div><b>{word()}</b><p>{sentence(3, 50)}</p></div>", f"<p>{sentence(3, 50)}</p>", f"<article><p>{sentence(4, 40)}</p></article>", f"<li>{sentence(3, 30)}</li>") for _ in range(rng.randint(1, 5)))
            return box("talk", inner)
        if kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=x>{one('', f'<p>{sentence(3, 25)}</p>')}<button>{words(1, 2)}</button>"
            return one(f"<form>{inner}</form>", f"<form>{inner}</form>", box("form", inner))
        inner = one(long, long, f"<p>{long}</p>", f"<p>{sentence(4, 30)}</p><a href=#>{words(1, 3)}</a>", f"<span>{long}</span>")
        return box(kind, inner)

    def text() -> str:
        t = rng.random()
        body = sentence(3, 90) if t < 0.8 else sentence(1, 8)
        if rng.random() < 0.2:
            body = body.replace(" ", " <b>", 1) + one("</b>", "")
        if rng.random() < 0.15:
            body += f' <a href="/{word()}">{words(1, 4)}</a> {words(1, 12)}.'
        return one(*[f"<p>{body}</p>"] * 6, f"<p>{body}", f"{body}<br>", f"<h2>{words(1, 8)}</h2>", f"<blockquote>{body}</blockquote>", f"<ul><li>{body}</li><li>{sentence(1, 20)}</li></ul>", f"<figure><figcaption>{sentence(2, 15)}</figcaption></figure>", f"<pre>{body}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>")

    out = []
    for _ in range(n):
        parts: list[tuple[str, bool]] = [("<!DOCTYPE html><html><head><title>x</title></head><body>", False)]
        for kind in ("note", "head", "menu", "ad", "menu", "form"):
            if rng.random() < (0.7 if kind == "menu" else 0.35):
                parts.append((other(kind), False))
        name = rng.choice(TOLD["text"].split())
        home = one("<article>", "<article>", "<article>", "<main>", "<main><article>", f'<div class="{name}">', f'<div id="{name}">', f'<section class="{word()} {name}">', f"<article class={word()}>", "<div>")
        shut = {"<main><article>": "</article></main>"}.get(home, f"</{re.match('<([a-z]+)', home)[1]}>")
        wrap = rng.random() < 0.15
        side = [other("side")] if wrap and rng.random() < 0.5 else []
        parts += [("<div class=wrap>" if wrap else "", False), *((s, False) for s in side), (home, False)]
        if rng.random() < 0.85:
            parts.append((f"<header><h1>{words(1, 12)}</h1></header>" if rng.random() < 0.12 else f"<h1>{words(1, 14)}</h1>", True))
        for _ in range(rng.randint(1, 9)):
            parts.append((text(), True))
            if rng.random() < 0.1:
                parts.append((other(one("ad", "ad", "share", "form", "side", "note")), False))
        if rng.random() < 0.12:
            parts.append((other("talk"), False))
        parts.append((shut, False))
        for kind, p in (("share", 0.15), ("side", 0.3), ("talk", 0.35), ("ad", 0.2), ("form", 0.2)):
            if rng.random() < p:
                parts.append((other(kind), False))
        parts += [("</div>" if wrap else "", False), (other("foot"), False) if rng.random() < 0.85 else ("", False), (one("</body></html>", ""), False)]
        out.append(parts)
    return out


def labelled_blocks(parts: list[tuple[str, bool]]) -> list[tuple[Block, bool]]:
    """Blocks of the whole page with their labels; parts mark their words, so that labels follow the words."""
    marked = "".join(re.sub(r"(>|^)([^<]+)", lambda m: m[1] + "\1" + m[2], p) if main else p for p, main in parts)
    return [((t.replace("\1", ""), f), "\1" in t) for t, f in blocks(marked)]


Model = tuple[dict[str, float], np.ndarray]


@lru_cache(maxsize=1)
def train(rounds: int = 150, l2: float = 0.05, rate: float = 0.2) -> Model:
    """Weights of the features for label main, and of the four transitions, by Adam on the conditional likelihood."""
    pages = [b for b in map(labelled_blocks, labelled_pages()) if b]
    index: dict[str, int] = {}
    width, count = max(map(len, pages)), len(pages)
    rows, cols = [], []
    gold, real = np.zeros((count, width), int), np.zeros((count, width), bool)
    for p, page in enumerate(pages):
        for k, ((_, f), main) in enumerate(page):
            gold[p, k], real[p, k] = main, True
            rows += [p * width + k] * len(f)
            cols += [index.setdefault(x, len(index)) for x in f]
    rows_, cols_ = np.array(rows), np.array(cols)
    pair = real[:, 1:]
    seen = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, m, v = (np.zeros(len(index) + 4) for _ in range(3))
    for t in range(1, rounds + 1):
        s = np.bincount(rows_, w[:-4][cols_], count * width).reshape(count, width)
        e = np.exp(np.stack([np.zeros_like(s), np.clip(s, -30, 30)], 2))
        e[~real] = 1.0
        T = np.exp(w[-4:].reshape(2, 2))
        ahead, back, scale = np.zeros_like(e), np.ones_like(e), np.ones((count, width))
        ahead[:, 0] = e[:, 0]
        for k in range(width):
            if k:
                ahead[:, k] = np.where(real[:, k, None], (ahead[:, k - 1] @ T) * e[:, k], ahead[:, k - 1])
            scale[:, k] = ahead[:, k].sum(1)
            ahead[:, k] /= scale[:, k, None]
        for k in range(width - 2, -1, -1):
            back[:, k] = np.where(real[:, k + 1, None], (back[:, k + 1] * e[:, k + 1]) @ T.T, back[:, k + 1])
            back[:, k] /= back[:, k].sum(1, keepdims=True)
        p = ahead * back
        p = (p / p.sum(2, keepdims=True))[:, :, 1] * real
        joint = ahead[:, :-1, :, None] * T * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        joint = joint / joint.sum((2, 3), keepdims=True) * pair[:, :, None, None]
        g = np.concatenate([np.bincount(cols_, ((gold * real) - p).ravel()[rows_], len(index)), (seen - joint.sum((0, 1))).ravel()]) - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return {x: float(w[i]) for x, i in index.items()}, w[-4:].reshape(2, 2).copy()


def decode(scores: list[float], step: np.ndarray) -> list[bool]:
    """Viterbi: the best labels (main or not) of a chain."""
    (oo, om), (mo, mm) = step.tolist()
    other, main, ways = 0.0, 0.0, []
    for k, s in enumerate(scores):
        if k:
            to_other, to_main = (mo + main > oo + other), (mm + main > om + other)
            other, main = (mo + main if to_other else oo + other), (mm + main if to_main else om + other) + s
            ways.append((to_other, to_main))
        else:
            main = s
    now, out = main > other, []
    for way in [*reversed(ways), None]:
        out.append(now)
        if way is not None:
            now = way[now]
    return out[: len(scores)][::-1]


def main_text(page: str | None, model: Model) -> str:
    weights, step = model
    found = blocks(page or "")
    labels = decode([sum(weights.get(x, 0.0) for x in f) for _, f in found], step)
    return " ".join(t for (t, _), main in zip(found, labels) if main)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, sent.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return merged(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_crf_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
