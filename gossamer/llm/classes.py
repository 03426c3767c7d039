"""Rows of equal key as one class with its few smallest ids, however many rows share the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def equal_classes(rows: DataFrame, key: str, row_id: str, keep: int) -> DataFrame:
    """key, first (the smallest id), ids (the `keep` smallest, rising): a limit in each map task, one in each salt, then one in each key."""
    salt = F.pmod(F.xxhash64(row_id), F.lit(SALTS))
    near = Window.partitionBy(key, "salt").orderBy(row_id)
    some = rows.select(key, F.col(row_id).alias("id"), salt.alias("salt")).withColumnRenamed("id", row_id)
    some = some.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= keep)
    some = some.drop("salt", "nth").withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(row_id))).where(F.col("nth") <= keep)
    return some.groupBy(key).agg(F.min(row_id).alias("first"), F.sort_array(F.collect_list(row_id)).alias("ids"))
