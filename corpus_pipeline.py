"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) with the columns of `documents` and returns a DataFrame
with them; the last returns packed pieces. run() writes what a stage returns to the shared
folder before the next one reads it, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import jaccard_join, language_id, mixing, packing, pii
from gossamer.llm.common import durable, fold, read, sized

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null and empty ones among them, and texts that no learnt language explains, go. Repeated rows are
    judged alike; a missing lang is filled in; an empty table stays empty."""
    return language_id.keep_known(docs, language_id.learn(docs, ~fold(0)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once where its row repeats.
    Rows that share a doc_id are one document, and stay where one of their texts may; rows without a doc_id can't be told apart
    and all stay. Texts that are null or have no words link with nothing and stay."""
    found = durable(jaccard_join.join(docs), "near", free=True)
    gone = found.groupBy("doc_id").agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("stays")).where("stays = 0")
    again = durable(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again", free=True)
    kept = docs.join(sized(gone.select("doc_id")), "doc_id", "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(sized(again), "doc_id", "left_anti")
    repeated = kept.join(sized(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(docs.columns).union(repeated.select(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in square brackets; n_chars follows. Null texts stay null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as many times as the mix takes them; those it does not take go, as do texts without words.
    Rows that share a doc_id all come as often as the one of them that the mix takes most."""
    mixed = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    # names that no column of docs has
    mine, times = (next(n for n in (f"{base}_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("mixed_id", "copies"))
    copies = durable(mixed.select(F.col("doc_id").alias(mine), F.col("copies").alias(times)), "copies")
    taken = docs.join(sized(copies), F.col("doc_id").eqNullSafe(F.col(mine)))
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens. Null and empty texts are a closing id alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A language model's and a tokenizer's results are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
