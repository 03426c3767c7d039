"""URL validation: the checks in order, the first that fails naming the drop reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UrlRules
from ..functions import urls


def validated(df: DataFrame, rules: UrlRules | None = None, compat_port_bug: bool = True) -> DataFrame:
    """df (url, depth, ...) with `drop_reason`: format, scheme, domain, depth, extension, or null. The url of rows that have
    the right format is put in normal form first, as later checks and all keys go by that. It is exploded from an array of one:
    the planner would else put the whole normal form in each place of a later filter that names the url."""
    rules = rules or UrlRules()
    marked = df.withColumn("_ok", urls.is_valid(F.col("url")))
    if rules.normalize_urls:
        form = F.when(F.col("_ok"), urls.normalized(F.when(F.col("_ok"), F.col("url")), compat_port_bug)).otherwise(F.col("url"))
        marked = marked.withColumn("url", F.explode(F.array(form)))
    url = F.col("url")
    path = F.regexp_extract(urls.part(url, 3), r"(?s)^((?:.*/)?[^/;]*)", 1)
    reason = (
        F.when(~F.col("_ok"), "format")
        .when(~F.lower(urls.part(url, 1)).isin(rules.allowed_schemes), "scheme")
        .when(~urls.domain_allowed(urls.host(url), rules.allowed_domains, rules.blocked_domains), "domain")
        .when(F.col("depth") > rules.max_depth, "depth")
        .when(urls.has_extension(path, rules.blocked_extensions), "extension")
    )
    return marked.withColumn("drop_reason", reason).drop("_ok")


def listed_domains(df: DataFrame, domains: DataFrame, how: str) -> DataFrame:
    """Rows whose host is, or lies below, one of many domains (how: left_semi), or none (left_anti): a join on host suffixes."""
    labels = F.split(urls.host(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = df.select("url").distinct().withColumn("domain", F.explode(suffixes)).join(domains.select("domain").distinct(), "domain", "left_semi").select("url").distinct()
    return df.join(hit, "url", how)
