"""Read queries over stored tables, and a scan of an SQLite store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STORED = {
    "pages": "url string, final_url string, title string, content_type string, status_code int, depth int, parent_url string, text_content string, word_count int, char_count int, crawled_at string, metadata string",
    "links": "source_url string, target_url string, anchor_text string",
    "images": "page_url string, image_url string, alt_text string",
}


def sqlite_table(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    """A table of a crawl store. Tasks read disjoint ranges of row ids; the file must be in a folder that all of them see."""
    columns = [c.split()[0] for c in STORED[table].split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            for f in frames:
                for k in f["id"]:
                    lo, hi = c.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {table}").fetchone()
                    step = (hi - lo + parts) // parts
                    found = c.execute(f"select {', '.join(columns)} from {table} where rowid >= ? and rowid < ?", (lo + k * step, lo + (k + 1) * step))
                    while rows := found.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.range(0, parts, 1, parts).mapInPandas(run, STORED[table])


def ok_pages(pages: DataFrame, limit: int | None = 5) -> DataFrame:
    """url, word_count where the status is 200; in order of url, so that a limit means the same rows each time."""
    out = pages.where("status_code = 200").select("url", "word_count").orderBy("url")
    return out if limit is None else out.limit(limit)


def page_rows(pages: DataFrame, limit: int = 10) -> DataFrame:
    return pages.select("url", "word_count", "status_code").orderBy("url").limit(limit)


def link_rows(links: DataFrame, limit: int = 10) -> DataFrame:
    return links.select("source_url", "target_url", "anchor_text").orderBy("source_url", "target_url", "anchor_text").limit(limit)


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("url", "title")


def counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return pages.agg(F.count("*").alias("pages")).crossJoin(links.agg(F.count("*").alias("links")))  # one row each
