"""URL expressions: validity, normal form, hosts and suffixes, all of them in Catalyst."""

from __future__ import annotations

from urllib.parse import urljoin, urlparse, urlunparse

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 2048
#: Scheme, host (names with a last label of 2 to 6 letters, localhost, or four groups of digits), port, rest.
# What counts as an address of a page, and as one of an image.
VALID = (
    r"(?iU)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?]\S+)\n?\z"
)
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_PATH = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"
_IMAGE = r"(?i)\.(jpg|jpeg|png|gif|bmp|svg|webp)$"


def is_valid(url: Column) -> Column:
    return F.coalesce((url != "") & (F.length(url) <= MAX_LENGTH) & url.rlike(VALID), F.lit(False))


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path with parameters, 4 query."""
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    """Lower case, without a port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^([^:]*)", 1))


def _without_port(scheme: Column, authority: Column, compat_port_bug: bool) -> Column:
    """By default ':80' (http) and ':443' (https) go wherever they stand in the authority, as crawled stores have it."""
    if compat_port_bug:
        return F.when(scheme == "http", F.replace(authority, F.lit(":80"), F.lit(""))).when(scheme == "https", F.replace(authority, F.lit(":443"), F.lit(""))).otherwise(authority)
    return F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def decoded(text: Column) -> Column:
    """Escapes as UTF-8, as Python's unquoting has them: a sign without two hex digits stays, each byte of an encoded surrogate is an error. "+" is a space."""
    text = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.regexp_replace(text, "(?i)%ED%[AB][0-9A-F]", "%EF%BF%BD%EF%BF%BD"))


def _pairs(query: Column) -> Column:
    split = F.filter(F.split(query, "&"), lambda x: x != "")
    cut = lambda x: F.instr(x, "=")
    return F.transform(
        split,
        lambda x, i: F.struct(
            decoded(F.when(cut(x) > 0, F.substring(x, F.lit(1), cut(x) - 1)).otherwise(x)).alias("key"), i.alias("at"),
            F.when(cut(x) > 0, decoded(F.substring(x, cut(x) + 1, F.length(x)))).otherwise("").alias("value"),
        ),
    )


def normalized(url: Column, compat_port_bug: bool = True) -> Column:
    """Lower-case scheme and host, no default port, no trailing slashes, query sorted by key, no fragment."""
    url = F.regexp_replace(url, r"\n\z", "")
    scheme = F.lower(part(url, 1))
    authority = _without_port(scheme, F.lower(part(url, 2)), compat_port_bug)
    whole = part(url, 3)
    path, params = F.regexp_extract(whole, _PATH, 1), F.regexp_extract(whole, _PATH, 2)
    path = F.when(path == "", F.lit("/")).when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    rest = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
    rest = F.when((rest != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest)
    pairs = F.array_sort(_pairs(part(url, 4)))
    query = F.concat_ws("&", F.transform(pairs, lambda p: F.concat(_quoted(p.key), F.lit("="), _quoted(p.value))))
    return F.concat(scheme, F.lit("://"), authority, rest, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def in_domains(name: Column, domains: list[str]) -> Column:
    """Equal to one of the domains, or below one."""
    out = name.isin(domains) if domains else F.lit(False)
    for d in domains:
        out = out | name.endswith("." + d)
    return out


def domain_allowed(name: Column, allowed: list[str], blocked: list[str]) -> Column:
    return ~in_domains(name, blocked) & (in_domains(name, allowed) if allowed else F.lit(True))


def has_extension(path: Column, extensions: list[str]) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | F.lower(path).endswith(e)
    return out


def is_image(url: Column) -> Column:
    return url.rlike(_IMAGE)


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def resolve(href: str, base: str, skipped: tuple[str, ...], keep_fragment: bool = False, keep_query: bool = True) -> str | None:
    """The absolute form of a link on a page, or None for what is no web address."""
    href = href.strip()
    if not href or href.lower().startswith(skipped):
        return None
    try:
        p = urlparse(urljoin(base, href))
    except ValueError:
        return None
    if p.scheme not in ("http", "https") or not p.netloc:
        return None
    return urlunparse((p.scheme, p.netloc.lower(), p.path, p.params, p.query if keep_query else "", p.fragment if keep_fragment else ""))
