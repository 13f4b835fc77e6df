"""The feature job (J1) on a file stream.

Cleaning, splitting and annotation are stateless row operations, so the
same plan runs unchanged under Structured Streaming: new corpus files are
picked up, turned into sentence rows with features and appended to a
Parquet sink.  The checkpoint lives in the sink's own folder
(``_checkpoint``, which readers of the sink pass over) unless one is given: a
restarted job goes on where it stopped, and two jobs never share one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from varietas.plans.features import build_features

DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def stream_features(spark: SparkSession, source_dir: str, sink_dir: str,
                    schema: T.StructType = DOCUMENTS_SCHEMA, glob: str | None = None,
                    checkpoint_dir: str | None = None, available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the streaming feature job; returns the running query."""
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.load(source_dir)
    corpus = docs.selectExpr("source AS ds_name", "doc_id", "text AS nl_instructions")
    feats = build_features(corpus, parse_tree=True)
    ckpt = checkpoint_dir or f"{sink_dir.rstrip('/')}/_checkpoint"
    writer = (feats.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
