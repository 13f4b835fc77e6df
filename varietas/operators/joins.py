"""Joins whose strategy follows from measured bytes, and spread hot keys."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its measured bytes are at most this many.
BROADCAST_MAX_BYTES = 64 << 20
SALTS = 16


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes in a hash table."""
    sized = {"string", "binary"}
    total = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind not in sized and kind.split("<")[0] not in ("array", "map", "struct"):
            total = total + 16
        else:
            total = total + 16 + F.coalesce(F.octet_length(c if kind in sized else c.cast("string")), F.lit(0))
    return total


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows; an action over ``df``."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint behind a check of the bytes; otherwise a shuffle join."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], spread: str,
                how: str = "inner", max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``rows`` joined with a ``table`` that has one row per key.

    A table of few bytes is broadcast.  Beyond that each of its rows is
    copied ``SALTS`` times and the rows are dealt by ``spread``, so that the
    rows of a hot key go to several tasks."""
    if measured_bytes(table) <= max_bytes:
        return rows.join(F.broadcast(table), list(on), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
