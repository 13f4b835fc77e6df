"""Size-balanced shards by sampled splitters, in DataFrame functions alone.

Rows are ordered by a 64-bit key: the text's hash above, the row key's hash
below.  Equal texts stand together, yet a text that holds any share of all
rows can be cut anywhere between its rows.

1. Draw: each row enters the sample with a probability in proportion to its
   size (about ``ranges * per_range`` rows whatever the table; a row larger
   than the step is always in).
2. Splitters: the sample's equal-count quantiles, ``ranges - 1`` of them.
3. Range-partition: every row finds its range by binary search; ranges with
   more than twice the mean of bytes or rows are subdivided by splitters drawn
   among their own rows, until none is overfull or a key cannot be cut.
4. The exact bytes of the ranges, a table bounded by their number, place every
   range in the global order; a running sum inside a range places its rows.
   The order's bytes are cut into equal shares, so shard sizes differ by about
   one row at most.  ``slot`` numbers a shard's rows without gaps.

Only (key, row key, size, checksum) is ever shuffled, never a text.

Defined results: a null text has no bytes and the checksum of none; a null
row key comes first; repeated rows are shards' rows each; the law is
``bytes``, so ``grown_shard`` is null; an empty table gives no rows.  Only
the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import table, written

OVERHEAD, RANGES, PER_RANGE, ROUNDS = 16, 2048, 24, 4


def sort_key(text: Column, key: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 32)
    return high.bitwiseOR(F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF)))


def weighted_sample(rows: DataFrame, step: float, seed: int) -> DataFrame:
    """Rows drawn with probability ``size / step`` (at most 1), repeatable."""
    draw = F.shiftrightunsigned(F.xxhash64("key", "row", "size", F.lit(seed)), 11) / float(1 << 53)
    return rows.where(draw * F.lit(float(step)) < F.col("size"))


def quantiles(sample: list[int], parts: int) -> list[int]:
    """Up to ``parts - 1`` different cuts at equal counts of the sample."""
    ordered = sorted(sample)
    return sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)} if ordered else ())


def range_of(splitters: list[int]) -> Column:
    """Number of splitters at or below ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    width = 1 << (len(splitters)).bit_length()
    cuts = F.lit(splitters)
    steps = [width >> i for i in range(1, width.bit_length())]
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(splitters)) & (F.get(cuts, at + step - 1) <= F.col("key")),
            at + step).otherwise(at))


def splitters_of(rows: DataFrame, ranges: int, per_range: int, rounds: int) -> list[int]:
    """Cuts between ranges; the driver holds the bounded sample and a line
    for each range."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not total.rows:
        return []
    step = total.bytes / (ranges * per_range)
    cuts = quantiles([r.key for r in weighted_sample(rows, step, 0).select("key").collect()], ranges)
    for round_ in range(1, rounds):
        sizes = rows.groupBy(range_of(cuts).alias("range")).agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        full = {r.range: max(r.bytes / total.bytes, r.rows / total.rows) * ranges for r in sizes}
        full = {k: v for k, v in full.items() if v > 2}
        if not full:
            break
        bytes_of = {r.range: r.bytes for r in sizes}
        inside = rows.withColumn("range", range_of(cuts)).where(F.col("range").isin(*full))
        # about per_range draws for each new range, at least one a row's mean
        most = sum(2 * v * per_range for v in full.values())
        drawn = weighted_sample(inside, sum(bytes_of[k] for k in full) / most, round_)
        found: dict[int, list[int]] = {}
        for r in drawn.select("range", "key").collect():
            found.setdefault(r.range, []).append(r.key)
        new = {c for k, keys in found.items() for c in quantiles(keys, 2 * int(full[k]) + 1)}
        if new <= set(cuts):
            break
        cuts = sorted(set(cuts) | new)
    return cuts


def shard(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text",
          ranges: int = RANGES, per_range: int = PER_RANGE, rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``key``, ``size``, ``text_crc32``, ``law``, ``shard``,
    ``slot`` and ``grown_shard`` (see the module)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(key).cast("bigint").alias("row"), sort_key(body, F.col(key)).alias("key"),
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("crc")), "shard-rows")
    placed = rows.withColumn("range", range_of(splitters_of(rows, ranges, per_range, rounds)))
    order = Window.partitionBy("range").orderBy(
        "key", F.col("row").asc_nulls_first(), "crc", "size")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c"))
    all_before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "range", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("c").over(all_before), F.lit(0)).alias("rows_before"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    # a row for each range: bounded by the number of splitters
    located = placed.withColumn("own", F.coalesce(F.sum("size").over(upto), F.lit(0))) \
        .withColumn("nth", F.row_number().over(order) - 1) \
        .join(F.broadcast(offsets), "range") \
        .withColumn("middle", F.col("bytes_before") + F.col("own") + F.expr("size div 2")) \
        .withColumn("shard", F.least(F.expr(f"cast(middle * {shards} div total as int)"),
                                     F.lit(shards - 1))) \
        .withColumn("place", F.col("rows_before") + F.col("nth"))
    located = written(located.select("row", "size", "crc", "shard", "place"), "shard-places")
    firsts = located.groupBy("shard").agg(F.min("place").alias("first"))  # a row a shard
    return located.join(F.broadcast(firsts), "shard").select(
        F.col("row").alias(key), "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40)
