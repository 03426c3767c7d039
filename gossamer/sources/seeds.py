"""Seeds: where a crawl begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD


def seeds(spark: SparkSession, urls: list[str], depth: int = 0) -> DataFrame:
    return spark.createDataFrame([(u, depth, None) for u in urls], RECORD)


def seeds_from_text(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """One URL a line; blank lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''").select("url", F.lit(depth).alias("depth"), F.lit(None).cast("string").alias("parent_url"))
