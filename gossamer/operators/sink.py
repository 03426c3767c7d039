"""Stored tables: pages by key, links and images appended, and the layout by host."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import StorageRules
from ..functions import urls
from ..plans.tables import materialized
from .extract import anchor_texts, image_table, link_table

PAGE_COLUMNS = ("url", "final_url", "title", "content_type", "status_code", "depth", "parent_url", "raw_html", "text_content", "word_count", "char_count", "crawled_at", "metadata")


def page_rows(pages: DataFrame, rules: StorageRules | None = None, at: Column | None = None) -> DataFrame:
    """Rows of the pages table from crawled pages; columns that are not stored are null."""
    rules = rules or StorageRules()
    has = lambda c: F.col(c) if c in pages.columns else F.lit(None)
    meta = [c for c in ("crawl_delay", "response_time", "fetch_method", "headers", "page_metadata", "anchor_texts", "content") if c in pages.columns]
    made = {
        "raw_html": has("raw_html").cast("string") if rules.store_html else F.lit(None).cast("string"),
        "text_content": has("text_content").cast("string") if rules.store_text else F.lit(None).cast("string"),
        "word_count": F.coalesce(F.col("content.word_count"), F.lit(0)) if "content" in pages.columns else F.lit(0),
        "char_count": F.coalesce(F.col("content.char_count"), F.lit(0)) if "content" in pages.columns else F.lit(0),
        "crawled_at": at if at is not None else F.current_timestamp(),
        "metadata": F.to_json(F.struct(*meta)) if rules.store_metadata and meta else F.lit(None).cast("string"),
    }
    kinds = {"status_code": "int", "depth": "int"}
    return pages.select(*(made[c].alias(c) if c in made else has(c).cast(kinds.get(c, "string")).alias(c) for c in PAGE_COLUMNS))


def compressed(pages: DataFrame) -> DataFrame:
    """raw_html as gzip bytes."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else gzip.compress(x.encode(), mtime=0))

    return pages.withColumn("raw_html", pack("raw_html"))


def uncompressed(pages: DataFrame) -> DataFrame:
    """raw_html of stored rows as text again."""

    @F.pandas_udf("string")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else gzip.decompress(x).decode())

    return pages.withColumn("raw_html", unpack("raw_html")) if dict(pages.dtypes)["raw_html"] == "binary" else pages


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], on_conflict: str = "replace") -> DataFrame:
    """One row a key: the last by order (`replace`, `update`) or the first (`ignore`), old rows before all new ones."""
    if on_conflict not in ("replace", "update", "ignore"):
        raise ValueError(f"unknown conflict rule {on_conflict!r}")
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    by = [F.col(c) for c in ("_new", *order)]
    ranked = both.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by if on_conflict == "ignore" else [c.desc() for c in by])))
    return ranked.where("_nth = 1").drop("_nth", "_new")


def store(pages: DataFrame, folder: str, rules: StorageRules | None = None, at: Column | None = None) -> None:
    """pages, links and images as Parquet under folder. Pages of earlier runs give way by the conflict rule: the merged table is
    written beside the old one and takes its place; a break between leaves it as pages_before. Links and images are appended
    each time. Html is kept as gzip bytes where the rules say so."""
    rules = rules or StorageRules()
    spark = pages.sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    disk = path("pages").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    pages = anchor_texts(pages) if "links" in pages.columns else pages
    rows = page_rows(pages, rules, at)
    rows = compressed(rows) if rules.compress_html and rules.store_html else rows
    if disk.exists(path("pages")):
        old = spark.read.parquet(f"{folder}/pages")
        if dict(old.dtypes)["raw_html"] != dict(rows.dtypes)["raw_html"]:  # the rules have changed since
            old = uncompressed(old) if dict(old.dtypes)["raw_html"] == "binary" else compressed(old)
        upserted(old, rows, ["url"], ["crawled_at"], rules.on_conflict).write.mode("overwrite").parquet(f"{folder}/pages_next")
        disk.delete(path("pages_before"), True)
        disk.rename(path("pages"), path("pages_before"))  # kept until the new table has its name
        disk.rename(path("pages_next"), path("pages"))
        disk.delete(path("pages_before"), True)
    else:
        upserted(rows.limit(0), rows, ["url"], ["crawled_at"], rules.on_conflict).write.parquet(f"{folder}/pages")
    if rules.store_links:
        link_table(pages).drop("pos").write.mode("append").parquet(f"{folder}/links")
    image_table(pages).write.mode("append").parquet(f"{folder}/images")


def file_path(url: Column, compat: bool = True) -> Column:
    """<host with _ for :>/<path with _ for />, `index` for none, 200 characters at most. Queries are no part of it, so
    addresses may share a path; otherwise a hash of the address keeps them apart."""
    host = F.replace(urls.part(url, 2), F.lit(":"), F.lit("_"))
    name = F.replace(F.regexp_replace(F.regexp_extract(urls.part(url, 3), r"(?s)^((?:.*/)?[^/;]*)", 1), "^/+|/+$", ""), F.lit("/"), F.lit("_"))
    name = F.substring(F.when(name == "", "index").otherwise(name), 1, 200)
    return F.concat(host, F.lit("/"), name if compat else F.concat(name, F.lit("-"), F.lower(F.hex(F.xxhash64(url)))))


def store_by_host(pages: DataFrame, folder: str, compat: bool = True) -> None:
    """Rows with their file path, in a folder a host; rows that share a path are one, the last by url."""
    kept = pages.withColumn("path", file_path(F.col("url"), compat))
    last = Window.partitionBy("path").orderBy(F.col("url").desc())
    kept = kept.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    kept.withColumn("domain", F.substring_index("path", "/", 1)).write.mode("overwrite").partitionBy("domain").parquet(folder)


def store_jdbc(pages: DataFrame, url: str, rules: StorageRules | None = None, at: Column | None = None, properties: dict[str, str] | None = None) -> None:
    """pages, links and images as tables of a database. Rows of pages meet the stored ones by the conflict rule; the merged rows are
    staged in Spark's shared folder, then the table is overwritten in one transaction a partition."""
    rules, properties = rules or StorageRules(), properties or {}
    spark = pages.sparkSession
    pages = anchor_texts(pages) if "links" in pages.columns else pages
    rows = page_rows(pages, rules, at)
    try:
        old = spark.read.jdbc(url, "pages", properties=properties)
        old = old.toDF(*(c.lower() for c in old.columns))
    except Exception as e:  # a first run finds no table
        if "exist" not in str(e).lower():
            raise
        old = rows.limit(0)
    merged = materialized(upserted(old, rows, ["url"], ["crawled_at"], rules.on_conflict), "merged")
    merged.write.option("truncate", "true").jdbc(url, "pages", mode="overwrite", properties=properties)
    if rules.store_links:
        link_table(pages).drop("pos").write.jdbc(url, "links", mode="append", properties=properties)
    image_table(pages).write.jdbc(url, "images", mode="append", properties=properties)


def write(pages: DataFrame, rules: StorageRules | None = None, folder: str | None = None, at: Column | None = None) -> None:
    """Store by the configured kind: `filesystem` by host, `postgresql` in that database (its driver must be on the class path), all others as tables."""
    rules = rules or StorageRules()
    if rules.storage_type == "postgresql":
        url = f"jdbc:postgresql://{rules.postgres_host}:{rules.postgres_port}/{rules.postgres_database}"
        store_jdbc(pages, url, rules, at, {"user": rules.postgres_user, "password": rules.postgres_password, "driver": "org.postgresql.Driver"})
    elif rules.storage_type == "filesystem":
        store_by_host(page_rows(pages, rules, at), folder or rules.output_directory)
    else:
        store(pages, folder or rules.output_directory, rules, at)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Empty Parquet tables of the stored model in the catalog."""
    for name, columns in (("pages", schema.PAGES), ("links", schema.LINK_ROWS), ("images", schema.IMAGE_ROWS), ("crawl_stats", schema.CRAWL_STATS), ("seen_urls", schema.SEEN_URLS)):
        spark.sql(f"create table if not exists {database}.{name} ({columns.replace('timestamp timestamp', '`timestamp` timestamp')}) using parquet")


def storage_stats(stored: DataFrame) -> DataFrame:
    """stored (ok, links): stored, failed, links, success rate."""
    return stored.agg(F.count_if("ok").alias("stored"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.size("links")).alias("links_stored"), (100 * F.count_if("ok") / F.nullif(F.count("*"), F.lit(0))).alias("success_rate"))
