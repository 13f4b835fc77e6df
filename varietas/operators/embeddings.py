"""Greedy matching of token vectors (the BERTScore formula without the
encoder): for a pair of items, precision is the mean over query vectors of
the best cosine against the reference vectors, recall the converse, and F1
their harmonic mean.

Vectors come from a table ``(item, vector)``; the encoder itself is not
part of this package.  Each item becomes one array of vectors of length 1,
normalised once; a pair row holds two such arrays, and both maxima come from
the one table of their products.  The work is bounded by item sizes, not by
the table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions.similarity import bind_all


def unit_vector(vector: Column) -> Column:
    """The vector as doubles, divided by its length; a zero vector stays."""
    doubles = F.transform(vector, lambda x: x.cast("double"))

    def divided(v: Column, size: Column) -> Column:
        return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))

    return bind_all(lambda v: bind_all(divided, v=v, size=F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), v=doubles)


def item_vectors(vectors: DataFrame, item_col: str, vec_id: str, vec_col: str) -> DataFrame:
    """``_item, _vecs``: the unit vectors of each item in order of their id."""
    unit = F.struct(F.col(vec_id).alias("id"), unit_vector(F.col(vec_col)).alias("vec"))
    return vectors.select(F.col(item_col).alias("_item"), unit.alias("_u")).groupBy("_item").agg(
        F.transform(F.array_sort(F.collect_list("_u")), lambda u: u["vec"]).alias("_vecs"))


def best_matches(q: Column, r: Column) -> Column:
    """``precision`` and ``recall`` of two arrays of unit vectors."""
    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)

    def both(products: Column) -> Column:
        columns = F.sequence(F.lit(0), F.size(products[0]) - 1)
        return F.struct(
            mean(F.transform(products, F.array_max)).alias("precision"),
            mean(F.transform(columns, lambda j: F.array_max(
                F.transform(products, lambda row: F.get(row, j))))).alias("recall"))

    table = F.transform(q, lambda a: F.transform(r, lambda b: product(a, b)))
    return F.when((F.size(q) > 0) & (F.size(r) > 0), bind_all(both, products=table))


def greedy_match_pairs(pairs: DataFrame, vectors: DataFrame, pair_key: Sequence[str],
                       q_item: str, r_item: str, item_col: str = "item",
                       vec_id: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Add ``precision, recall, f1`` to every pair of items; null, null and 0
    for an item without vectors."""
    items = item_vectors(vectors, item_col, vec_id, vec_col)
    out = pairs
    for side, item in (("_q", q_item), ("_r", r_item)):
        out = out.join(items.select(F.col("_item").alias(item), F.col("_vecs").alias(side)), item, "left")
    out = out.withColumn("_m", best_matches(F.col("_q"), F.col("_r")))
    out = out.select(*pairs.columns, "_m.precision", "_m.recall")
    pr = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(pr != 0, 2 * F.col("precision") * F.col("recall") / pr)
                          .otherwise(F.lit(0.0)))
