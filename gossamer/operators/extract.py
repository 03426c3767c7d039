"""Parsing: one pass over each page gives title, metadata, links, text and structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..config import ContentRules, LinkRules, ParseRules
from ..functions import dom, urls
from ..schema import EXTRACTED

BATCH_BYTES = 1 << 20  # of html whose extracts a worker holds at once


def pieces(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows where their html reaches another `limit` bytes, so that a piece has fewer than that beside its first page."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("_html")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def parsed(df: DataFrame, parse: ParseRules | None = None, link: LinkRules | None = None, content: ContentRules | None = None, fields: frozenset[str] = dom.FIELDS) -> DataFrame:
    """df (url, raw_html, final_url?, content_type?, ...) with title, page_metadata, links, text_content, content, error and
    `drop_reason` (no html, not html, too large). What is dropped never reaches Python. Of title, page_metadata, links and content only
    the fields asked for are extracted; the others are null."""
    parse, link, content = parse or ParseRules(), link or LinkRules(), content or ContentRules()
    kind = F.lower("content_type") if "content_type" in df.columns else F.lit(None).cast("string")
    reason = (
        F.when(F.coalesce(F.col("raw_html"), F.lit("")) == "", "no html")
        .when(F.coalesce(kind, F.lit("")).rlike(".") & ~kind.contains("text/html"), "not html")
        .when(F.octet_length("raw_html") > parse.max_html_size_mb * 1024 * 1024, "too large")
    )
    marked = df.withColumn("drop_reason", reason)
    base = F.coalesce("final_url", "url") if "final_url" in df.columns else F.col("url")
    made = _parse_datatype_string(EXTRACTED)
    arrow = to_arrow_type(made)
    marked = marked.withColumns({"_base": base, "_html": F.when(F.col("drop_reason").isNull(), F.col("raw_html"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for b, h in zip(batch.column("_base").to_pylist(), batch.column("_html").to_pylist()):
                row = None if h is None else dom.extract(h, b or "", parse, link, content, fields)
                rows.append({"links": [], "title": None} if row is None else row)
            found = pa.array(rows, arrow)
            kept = [c for c in batch.schema.names if c not in ("_base", "_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found.flatten()], names=[*kept, *(f.name for f in arrow)])

    out = marked.drop("_base", "_html").schema
    for f in made.fields:
        out = out.add(f)
    return marked.mapInArrow(run, out)


def link_table(pages: DataFrame) -> DataFrame:
    """source_url, pos, target_url, anchor_text of pages (url, links); images are those addresses that end like one."""
    one = pages.select(F.col("url").alias("source_url"), F.explode("links").alias("l"))
    return one.where(~urls.is_image(F.col("l.url"))).select("source_url", "l.pos", F.col("l.url").alias("target_url"), F.nullif("l.text", F.lit("")).alias("anchor_text"))


def image_table(pages: DataFrame) -> DataFrame:
    one = pages.select(F.col("url").alias("page_url"), F.explode("links").alias("l"))
    return one.where(urls.is_image(F.col("l.url"))).select("page_url", F.col("l.url").alias("image_url"), F.lit(None).cast("string").alias("alt_text"))


def anchor_texts(pages: DataFrame) -> DataFrame:
    """pages with `anchor_texts`: address to text, where there is one."""
    named = F.filter("links", lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return pages.withColumn("anchor_texts", F.map_from_entries(F.transform(named, lambda x: F.struct(x["url"], x["text"]))))


def parse_stats(df: DataFrame) -> DataFrame:
    ok = F.col("drop_reason").isNull() & F.col("error").isNull()
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(F.col("drop_reason") == "not html").alias("skipped_non_html"), (100 * F.count_if(ok) / F.nullif(F.count("*"), F.lit(0))).alias("success_rate"))


def link_stats(pages: DataFrame) -> DataFrame:
    image = lambda x: x["url"].rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|svg|webp)$")
    n, m = F.size(F.filter("links", lambda x: ~image(x))), F.size(F.filter("links", image))
    return pages.agg(F.count("*").alias("pages"), F.sum(n).alias("links"), F.sum(m).alias("images"), F.max(n).alias("most_links"), (F.sum(n) / F.nullif(F.count("*"), F.lit(0))).alias("mean_links"))


def content_stats(pages: DataFrame) -> DataFrame:
    ok = F.col("content").isNotNull()
    return pages.agg(F.count("*").alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("too_short"), F.sum("content.word_count").alias("words"), F.sum("content.char_count").alias("chars"), (F.sum("content.word_count") / F.nullif(F.count_if(ok), F.lit(0))).alias("mean_words"))
