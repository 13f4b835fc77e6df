"""The training-data pipeline over ``documents``.

Every stage takes what its predecessor kept, as written and reread Parquet,
and returns the columns of ``documents``; the last returns the packed pieces.

1. quality: documents whose best grade is less likely than not are dropped.
2. line dedup: lines spread over sites are removed from all documents but
   their first; a document that loses its whole text this way is dropped.
3. near duplicates: of each group of linked documents the one with the
   smallest ``doc_id`` stays (one row, also if ids are null, which come
   last, or repeat; then the text's hash decides); documents without shingles
   are linked with nothing and stay.
4. decontamination: documents of which a twentieth or more is benchmark text
   are dropped.
5. packing: the remaining texts as pieces of sequences.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varietas.llm import decontaminate, jaccard_join, linededup, packing, quality  # noqa: E402
from varietas.llm.common import table, unused, written  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.keep(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, removed = unused(docs, "_lines"), unused(docs, "_removed")
    cleaned = linededup.remove_spread_lines(docs, n_lines=lines, n_removed=removed)
    emptied = (F.col(removed) > 0) & (F.trim("text") == "")
    return cleaned.where(~emptied) \
        .withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("bigint"))
                    .otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = unused(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))  # equal rows are alike
    groups = written(jaccard_join.jaccard_components(keyed, key=row), "groups").where("n_shingles > 0")
    members = groups.select(row, "component_id").distinct().join(
        keyed.select(row, F.col("doc_id").alias("key")).distinct(), row)
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("key").isNull().alias("last"), "key", row)).alias("first"))
    dropped = members.join(first, "component_id").where(F.col(row) != F.col(f"first.{row}")).select(row)
    kept = keyed.join(dropped, row, "left_anti")
    repeated = groups.groupBy(row).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(row)
    if repeated.take(1):
        once = kept.join(repeated, row, "left_semi").dropDuplicates([row])
        kept = kept.join(repeated, row, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier's weights and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
