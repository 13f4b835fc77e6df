"""Reading corpora and catalogues, writing feature tables and reports."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "nl_instructions"
# Default pattern of a dataset name inside a results path.
RESULTS_DIR_PATTERN = r"results/([^/]+)/"


def read_corpus(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
                schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a corpus.  Parquet by default; CSV with a header row and
    ``"`` as escape, columns as strings unless ``schema`` is given.

    A CSV file is split over tasks.  ``multi_line`` allows line breaks inside
    quoted fields, for which a file has to be read by one task: set it only
    for corpora of many files."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = (reader.option("header", True).option("multiLine", multi_line)
                  .option("escape", '"'))
        if schema is None:
            reader = reader.option("inferSchema", False)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def ds_name_from_path(path: Column | str, pattern: str = RESULTS_DIR_PATTERN,
                      fail: bool = True) -> Column:
    """Dataset name = first group of ``pattern`` in the path; a path
    without a match raises (``fail=True``) or gives null."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(c, pattern, 1)
    if fail:
        return F.when(name == "", F.raise_error(F.concat(F.lit("no dataset name in path: "), c))) \
            .otherwise(name)
    return F.nullif(name, F.lit(""))


def read_catalog(spark: SparkSession, catalog_path: str, base_dir: str = "",
                 names: Iterable[str] | None = None, fmt: str = "csv",
                 schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Resolve dataset names through a JSON catalogue ``{name: path}``
    and read the chosen datasets into one table tagged with ``ds_name``.

    A path may be a file, a folder or a glob, and may hold blanks.  Each
    entry has a reader of its own, whose rows bear the entry's name whatever
    files it finds; the tables are united by column name, a column that an
    entry lacks being null.  A name that the catalogue lacks, or a path
    without a file, raises.  The catalogue is one small JSON file read by
    Spark; only its entries reach the driver.
    """
    entries = {r.ds_name: r.path for r in spark.read.text(catalog_path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("ds_name", "path")).collect()}
    wanted = sorted(entries if names is None else set(names))
    unknown = [n for n in wanted if n not in entries]
    if unknown or not wanted:
        raise ValueError(f"not in the catalogue: {', '.join(unknown) or 'any dataset'}")
    base = base_dir.rstrip("/") + "/" if base_dir else ""
    tables = [read_corpus(spark, base + entries[n], fmt, schema, multi_line).withColumn("ds_name", F.lit(n))
              for n in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_features(df: DataFrame, path: str, fmt: str = "parquet",
                   partition_by: str | None = "ds_name", mode: str = "overwrite") -> None:
    """S3: write the feature table.  Parquet keeps arrays; CSV cannot hold
    arrays, so they are written as JSON strings."""
    out = df
    if fmt == "csv":
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                out = out.withColumn(f.name, F.to_json(f.name))
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """The report table as Parquet plus one report text per dataset
    (``text/ds_name=...``, lines in ``ord`` order).  A dataset's report has
    one row per metric, so each text is one small file."""
    report.write.mode("overwrite").parquet(f"{path}/table")
    (report.repartition("ds_name").sortWithinPartitions("ds_name", "ord").select("ds_name", "line")
     .write.mode("overwrite").partitionBy("ds_name").text(f"{path}/text"))
