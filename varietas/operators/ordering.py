"""Total order, dense row index and prefix sums without a global window.

A ``row_number()`` over an un-partitioned window (or one partitioned only by
a dataset that may hold a third of the rows) puts everything in one task.
Here the rows are range-partitioned on the order, every partition numbers
its own rows, and a tiny table of per-partition totals turns local numbers
into global ones.  The per-partition table has at most
``partitions x groups`` rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.operators.joins import broadcast_if_small
from varietas.session import checkpoint

def document_key(df: DataFrame, by: Sequence[str] = ()) -> list[str]:
    """Columns that tell the documents of a group apart.  Ids are unique in
    their dataset only, so the dataset belongs to the key where the groups do
    not fix it."""
    return [c for c in ("ds_name",) if c in df.columns and c not in by] + ["doc_id"]


def with_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with group columns: ``by``, or for an ungrouped run the one
    constant ``_all``, to be dropped from the result."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, by: Sequence[str], order: Sequence, num_partitions: int | None = None,
           materialize: bool = True) -> DataFrame:
    """Range-partition on ``by + order``, sort each partition, and tag every
    row with ``_mid`` (partition id in the high bits, local position in the
    low 33 bits).  Materialised through a reliable checkpoint so range
    bounds and ids cannot change if tasks are re-run."""
    cols = [*by, *order]
    out = (df.repartitionByRange(_partitions(df, num_partitions), *cols)
           .sortWithinPartitions(*cols)
           .withColumn("_mid", F.monotonically_increasing_id()))
    return checkpoint(out) if materialize else out


def dense_index(df: DataFrame, order: Sequence, by: Sequence[str] = (),
                out_col: str = "row_idx", num_partitions: int | None = None,
                materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """0-based position of each row in its group under ``order``.

    Returns ``(indexed rows, sizes)`` where ``sizes`` has one row per group
    with ``N``.  Equal to ``row_number() over (partition by by order by
    order) - 1`` when the order is total.
    """
    keys = list(by)
    r = ranged(df, keys, order, num_partitions, materialize)
    part = F.shiftright("_mid", 33).alias("_part")
    totals = r.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("_n"),
                                        F.min("_mid").alias("_first"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    sizes = totals.groupBy(*keys).agg(F.sum("_n").alias("N"))
    indexed = (r.withColumn("_part", F.shiftright("_mid", 33))
               .join(broadcast_if_small(offsets.select("_part", *keys, "_off", "_first")),
                     on=["_part", *keys])
               .withColumn(out_col, F.col("_off") + F.col("_mid") - F.col("_first"))
               .drop("_part", "_off", "_first", "_mid"))
    return indexed, sizes


def prefix_sum(df: DataFrame, weight: Column | str, order: Sequence, by: Sequence[str] = (),
               out_col: str = "offset", num_partitions: int | None = None,
               materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Exclusive running sum of ``weight`` in each group under ``order``.

    The running sum inside a range partition uses a window partitioned by
    (range partition, group): its size is bounded by one range partition.
    Returns ``(rows with out_col, totals per group)``.
    """
    keys = list(by)
    wcol = F.col(weight) if isinstance(weight, str) else weight
    r = ranged(df.withColumn("_w", wcol.cast("bigint")), keys, order, num_partitions, materialize)
    r = r.withColumn("_part", F.shiftright("_mid", 33))
    wl = Window.partitionBy("_part", *keys).orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, -1)
    local = r.withColumn("_local", F.coalesce(F.sum("_w").over(wl), F.lit(0)))
    totals = r.groupBy("_part", *keys).agg(F.sum("_w").alias("_tot"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_poff", F.coalesce(F.sum("_tot").over(w), F.lit(0)))
    sizes = totals.groupBy(*keys).agg(F.sum("_tot").alias("total"))
    out = (local.join(broadcast_if_small(offsets.select("_part", *keys, "_poff")),
                      on=["_part", *keys])
           .withColumn("_pres", F.col("_poff") + F.col("_local"))
           .drop("_part", "_poff", "_local", "_mid", "_w")
           .withColumnRenamed("_pres", out_col))
    return out, sizes
