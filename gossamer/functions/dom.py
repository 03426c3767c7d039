"""A page's elements in document order, and what is extracted from them in one pass over the page.

Built on the standard library's tokenizer. An end tag closes the nearest element of its name, one without such
an element is ignored; nothing is closed by implication. Text of scripts, styles and templates is no text.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from typing import Any

from ..config import ContentRules, LinkRules, ParseRules
from .urls import resolve

# Elements without content, without text, and those dropped before text is read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(("script", "style", "template"))
NOISE = frozenset("script style nav header footer aside iframe noscript button".split())
HOMES = ("article", "main", "div", "section")
DATES = ("publish-date", "publication-date", "date", "DC.date")
ANCHOR_TEXT = 200


class Page(HTMLParser):
    """Nodes are numbered in document order; end[i] is one past the last node inside node i; text nodes have tag None."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = []
        self.attrs: list[dict[str, str]] = []
        self.text: list[str] = []
        self.end: list[int] = []
        self.up: list[int] = []
        self._open: list[int] = []
        self.feed(source)
        self.close()
        for i in self._open:
            self.end[i] = len(self.tag)

    def _add(self, tag: str | None, attrs: dict[str, str], text: str) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.up.append(self._open[-1] if self._open else -1)
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        first: dict[str, str] = {}
        for k, v in attrs:
            first[k] = v or ""
        i = self._add(tag, first, "")
        if tag not in VOID:
            self._open.append(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self._open) - 1, -1, -1):
            if self.tag[self._open[at]] == tag:
                for i in self._open[at:]:
                    self.end[i] = len(self.tag)
                del self._open[at:]
                return

    def handle_data(self, data: str) -> None:
        last = len(self.tag) - 1
        if last >= 0 and self.tag[last] is None and self.up[last] == (self._open[-1] if self._open else -1):
            self.text[last] += data
        else:
            self._add(None, {}, data)

    def find_all(self, *tags: str, lo: int = 0, hi: int | None = None, gone: frozenset[str] = frozenset()) -> list[int]:
        """Elements of these names between lo and hi, outside elements that are gone."""
        out, i, hi = [], lo, len(self.tag) if hi is None else hi
        while i < hi:
            if self.tag[i] in gone:
                i = self.end[i]
                continue
            if self.tag[i] in tags:
                out.append(i)
            i += 1
        return out

    def first(self, tag: str, gone: frozenset[str] = frozenset(), **attrs: str) -> int | None:
        for i in self.find_all(tag, gone=gone):
            if all(self.attrs[i].get(k.replace("_", "-")) == v for k, v in attrs.items()):
                return i
        return None

    def strings(self, i: int, gone: frozenset[str] = frozenset()) -> list[str]:
        """The stripped strings inside node i (-1: the page) that aren't blank."""
        at, hi = (i + 1, self.end[i]) if i >= 0 else (0, len(self.tag))
        out = []
        while at < hi:
            tag = self.tag[at]
            if tag is not None and (tag in UNREAD or tag in gone):
                at = self.end[at]
                continue
            if tag is None and (s := self.text[at].strip()):
                out.append(s)
            at += 1
        return out

    def only_string(self, i: int) -> str | None:
        """The string of an element whose content is one string, at whatever depth of single elements."""
        while True:
            if i + 1 >= self.end[i] or self.end[i + 1] != self.end[i]:  # no child, or more than the first
                return None
            i += 1
            if self.tag[i] is None:
                return self.text[i]

    def meta(self, key: str, value: str) -> str | None:
        """Stripped content of the first meta of that kind, where it is there and not empty."""
        for i in self.find_all("meta"):
            if self.attrs[i].get(key) == value:
                content = self.attrs[i].get("content")
                return content.strip() if content else None
        return None

    def metas(self, key: str, prefix: str) -> dict[str, str]:
        out = {}
        for i in self.find_all("meta"):
            name, content = self.attrs[i].get(key, ""), self.attrs[i].get("content", "").strip()
            if name.startswith(prefix) and (short := name.replace(prefix, "")) and content:
                out[short] = content
        return out


def title(page: Page) -> str | None:
    t = page.first("title")
    if t is not None and (s := page.only_string(t)):
        return s.strip()
    if (og := page.meta("property", "og:title")) is not None:
        return og
    h = page.first("h1")
    return None if h is None else "".join(page.strings(h))


def metadata(page: Page, rules: ParseRules) -> dict[str, Any]:
    """What the head says; keys without a value are left out."""
    if not rules.extract_metadata:
        return {}
    keywords = page.meta("name", "keywords")
    canonical = next((page.attrs[i]["href"].strip() for i in page.find_all("link") if "canonical" in page.attrs[i].get("rel", "").split() and page.attrs[i].get("href")), None)
    root = page.first("html")
    lang = page.attrs[root].get("lang") if root is not None else None
    first = lambda *found: next((f for f in found if f is not None), None)
    out = {
        "title": title(page),
        "description": first(page.meta("name", "description"), page.meta("property", "og:description")),
        "keywords": None if keywords is None else [k.strip() for k in keywords.split(",") if k.strip()],
        "author": first(page.meta("name", "author"), page.meta("property", "article:author")),
        "published_date": first(page.meta("property", "article:published_time"), *(page.meta("name", d) for d in DATES)),
        "canonical_url": canonical if rules.extract_canonical else None,
        "language": first(lang.strip() if lang else None, page.meta("http-equiv", "content-language"), page.meta("property", "og:locale")) if rules.extract_language else None,
        "open_graph": page.metas("property", "og:") if rules.extract_open_graph else {},
        "twitter_card": page.metas("name", "twitter:") if rules.extract_twitter_card else {},
    }
    return {k: v for k, v in out.items() if v is not None}


def links(page: Page, base: str, rules: LinkRules, scripts_stripped: bool = True) -> list[dict[str, Any]]:
    """Anchors, images, then (if asked for) stylesheets, scripts and frames: each address once, up to the limit of a page."""
    skipped = tuple(rules.skip_schemes)
    host = re.sub(r":.*", "", base.split("/")[2].lower()) if base.count("/") > 1 else ""
    gone = frozenset(("script", "style")) if scripts_stripped else frozenset()

    def anchor(i: int) -> str | None:
        if not rules.extract_anchor_text:
            return None
        text = "".join(page.strings(i, gone))
        return text[:ANCHOR_TEXT] + "..." if len(text) > ANCHOR_TEXT else text

    alt = lambda i: page.attrs[i].get("alt", "").strip() if rules.extract_anchor_text else None
    sheet = lambda i: "stylesheet" in page.attrs[i].get("rel", "").split()
    kinds = [("anchor", "a", "href", anchor, None)]
    kinds += [("image", "img", "src", alt, None)] * rules.extract_images + [("stylesheet", "link", "href", None, sheet)] * rules.extract_stylesheets
    kinds += [("script", "script", "src", None, None)] * rules.extract_scripts + [("iframe", "iframe", "src", None, None)] * rules.follow_iframes
    out: list[dict[str, Any]] = []
    seen: set[str] = set()
    for kind, tag, key, text, ok in kinds:
        for i in page.find_all(tag, gone=gone):
            if key not in page.attrs[i] or (ok and not ok(i)):
                continue
            url = resolve(page.attrs[i][key], base, skipped, not rules.ignore_fragments, not rules.ignore_query_params)
            if url is None or url in seen:
                continue
            seen.add(url)
            if rules.same_domain_only and re.sub(r":.*", "", url.split("/")[2].lower()) != host:
                continue
            out.append({"pos": len(out), "kind": kind, "url": url, "text": text(i) if text else None})
            if len(out) >= rules.max_links_per_page:
                return out
    return out


def clean_text(text: str, rules: ContentRules) -> str:
    if rules.decode_html_entities:
        text = html.unescape(text)
    if rules.normalize_whitespace:
        text = re.sub(r"[ \t]+", " ", text)
    if rules.remove_extra_newlines:
        text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip()


def content(page: Page, rules: ContentRules) -> tuple[str | None, dict[str, Any] | None]:
    """Main text and structure; nothing of either where the text is too short."""
    gone = NOISE if rules.remove_boilerplate else frozenset()
    home = next((h for h in (page.first(t, gone) for t in (*HOMES, "body")) if h is not None), -1)
    text = clean_text(" ".join(page.strings(home, gone)), rules)
    if len(text) < rules.min_text_length:
        return None, None
    text = text[: rules.max_content_length]
    joined = lambda i: "".join(page.strings(i, gone))
    headings = [{"level": n, "text": t} for n in range(1, 7) for i in page.find_all(f"h{n}", gone=gone) if (t := joined(i))] if rules.extract_headings else []
    paragraphs = [t for i in page.find_all("p", gone=gone) if len(t := joined(i)) >= rules.min_paragraph_length] if rules.extract_paragraphs else []
    lists, tables = [], []
    if rules.extract_lists:
        for i in page.find_all("ul", "ol", gone=gone):
            items = [t for j in page.find_all("li", lo=i + 1, hi=page.end[i], gone=gone) if page.up[j] == i and (t := joined(j))]
            if items:
                lists.append({"type": "ordered" if page.tag[i] == "ol" else "unordered", "items": items})
    if rules.extract_tables:
        for i in page.find_all("table", gone=gone):
            inside = lambda k, *tags: page.find_all(*tags, lo=k + 1, hi=page.end[k], gone=gone)
            heads = [joined(j) for h in inside(i, "thead")[:1] for j in inside(h, "th")]
            body = (inside(i, "tbody") or [i])[0]
            rows = [r for j in inside(body, "tr") if (r := [joined(c) for c in inside(j, "td", "th")])]
            if heads or rows:
                tables.append({"headers": heads, "rows": rows})
    return text, {"word_count": len(text.split()), "char_count": len(text), "headings": headings, "paragraphs": paragraphs, "lists": lists, "tables": tables}


FIELDS = frozenset(("title", "page_metadata", "links", "content"))


def extract(source: str, base: str, parse: ParseRules, link: LinkRules, rules: ContentRules, fields: frozenset[str] = FIELDS) -> dict[str, Any]:
    """What the tables keep of a page: all fields, or those asked for (content brings the text with it)."""
    try:
        page = Page(source)
        text, found = content(page, rules) if "content" in fields else (None, None)
        return {
            "title": title(page) if "title" in fields else None, "page_metadata": metadata(page, parse) if "page_metadata" in fields else None,
            "links": links(page, base, link, parse.strip_javascript) if "links" in fields else [], "text_content": text, "content": found, "error": None,
        }
    except Exception as e:  # a page that can't be read is reported, not lost
        return {"title": None, "page_metadata": None, "links": [], "text_content": None, "content": None, "error": f"{type(e).__name__}: {e}"}
