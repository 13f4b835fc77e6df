"""Connected components of a link table, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import written


def least_neighbours(edges: DataFrame) -> DataFrame:
    """Least end reachable over one link, per node ``u``: pre-aggregated."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the least node of its component) of all nodes of
    ``links(u, v)``.  Large-star and small-star steps alternate: every node's
    larger, then smaller, neighbours are linked to its least one, until only
    stars around the roots are left.  A node's links never meet in one task:
    minima are pre-aggregated and joined back."""
    edges = written(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_neighbours(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        least = least_neighbours(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.withColumnRenamed("m", "v"))
        edges = written(small.where("u <> v").distinct(), "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
