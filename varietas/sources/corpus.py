"""Readers for the corpora the operators run on.

Every reader returns the canonical corpus columns ``ds_name, doc_id,
nl_instructions`` so the sentence table is built the same way from any
source; only the columns used are read (Parquet column pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "nl_instructions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-spread an under-partitioned scan (e.g. one file with one row
    group) over the cluster before per-row text work.  A scan that already
    has at least ``defaultParallelism`` partitions is left untouched, so on
    a large input this is a no-op."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``: one dataset per ``source``."""
    return spread(read_table(spark, sf_dir, "documents").select(
        F.col("source").alias("ds_name"), "doc_id", F.col("text").alias(TEXT)))


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as one dataset named ``conversations``;
    the key holds the turn in its lower 32 bits, so no two turns share one."""
    conv = read_table(spark, sf_dir, "conversations")
    return spread(conv.select(
        F.lit("conversations").alias("ds_name"),
        (F.col("conv_id").cast("bigint") * (1 << 32) + F.col("turn")).alias("doc_id"),
        F.col("text").alias(TEXT)))
