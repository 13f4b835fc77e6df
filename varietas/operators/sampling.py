"""Seeded, reproducible draws of rows and row pairs (with replacement).

A draw is ``md5(seed|group|trial|sid|side)`` read as a 48-bit integer modulo
the group size ``N``: the same seed gives the same pairs for every metric,
and any SQL engine with ``md5`` reproduces them.  Only keys are broadcast, and
only after their bytes are measured; the corpus is streamed through a hash
join that keeps the drawn rows, whose payload then meets the draws in a
shuffle join on the row key.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.operators.joins import BROADCAST_MAX_BYTES, measured_bytes
from varietas.operators.ordering import dense_index, document_key, prefix_sum
from varietas.session import checkpoint

DEFAULT_BY = ("ds_name",)
ORDER = ("doc_id", "pos")


def _by(by) -> list[str]:
    return list(DEFAULT_BY if by is None else by)


def row_order(S: DataFrame, by: Sequence[str], order: Sequence[str]) -> list[str]:
    """Columns that order and identify the rows of a group.  By default the
    document key comes first, which holds the dataset in an ungrouped run:
    two datasets may use the same ids."""
    return [*document_key(S, by), "pos"] if tuple(order) == ORDER else list(order)


def draw_hash(*parts: Column) -> Column:
    """48-bit non-negative integer from md5 of the '|'-joined parts."""
    tag = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(tag), 1, 12), 16, 10).cast("bigint")


def draws(sizes: DataFrame, n_samples: int, trials: int, seed: int, by: Sequence[str],
          sides: Sequence[str] = ("q", "r"), distinct: bool = False,
          batches: int = 1) -> DataFrame:
    """One row per (group, trial, [batch,] sid) with an index per side.

    ``distinct=True`` draws the second side from the other N-1 rows (the
    i != j pairs of homogenisation).
    """
    keys = list(by)
    per_trial = n_samples * batches
    k = F.explode(F.sequence(F.lit(0), F.lit(trials * per_trial - 1))).alias("_k")
    base = sizes.filter(F.col("N") > (1 if distinct else 0)).select(*keys, "N", k)
    cols = [*keys,
            (F.col("_k") / per_trial).cast("int").alias("trial")]
    if batches > 1:
        cols.append(((F.col("_k") % per_trial) / n_samples).cast("int").alias("batch"))
    cols += [(F.col("_k") % n_samples).cast("int").alias("sid"), "N"]
    base = base.select(*cols)
    ident = [F.lit(str(seed)), *[F.col(c) for c in keys], F.col("trial")]
    if batches > 1:
        ident.append(F.col("batch"))
    ident.append(F.col("sid"))
    first = None
    for i, side in enumerate(sides):
        h = draw_hash(*ident, F.lit(side))
        if distinct and i == 1:
            rr = F.pmod(h, F.col("N") - 1)
            idx = F.when(rr >= first, rr + 1).otherwise(rr)
        else:
            idx = F.pmod(h, F.col("N"))
        base = base.withColumn(f"{side}_idx", idx)
        if i == 0:
            first = F.col(f"{side}_idx")
    # the draws come from a tiny sizes table; spread them over an explicit
    # number of partitions (AQE does not coalesce an explicit count) so the
    # joins and the per-pair scoring downstream run in parallel
    n_parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return base.drop("N").repartition(n_parts, *keys, "trial", "sid")


def index_corpus(S: DataFrame, by: Sequence[str] | None = None,
                 order: Sequence[str] = ORDER, dense_pos: bool = True) -> tuple[DataFrame, DataFrame]:
    """Dense index ``row_idx`` over the key columns (the text is not shuffled).

    With ``order = (doc_id, pos)`` and ``pos`` dense (0..n-1 inside a
    document, as ``clean_and_standardize`` produces), the index is built at
    document level: one row per document with its sentence count (a
    partial aggregate: a document's rows come from one input row), a
    distributed prefix sum over those small rows, then ``row_idx = offset +
    pos`` exploded back without a shuffle.  Otherwise the general
    range-partitioned dense index runs over the key rows.
    """
    keys = _by(by)
    order = row_order(S, keys, order)
    if dense_pos and order[-2:] == list(ORDER):
        # one small row per document, written once: the range partitioner's
        # bound sampling and shuffle then read this, not the corpus
        doc = order[:-1]
        docs = checkpoint(S.groupBy(*keys, *doc).agg(F.count(F.lit(1)).alias("_n")))
        offs, totals = prefix_sum(docs, "_n", doc, keys, out_col="_off")
        indexed = offs.select(*keys, *doc, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
                              .alias("pos"), "_off") \
            .select(*keys, *doc, F.col("pos").cast("int").alias("pos"),
                    (F.col("_off") + F.col("pos")).alias("row_idx"))
        return indexed, totals.withColumnRenamed("total", "N")
    return dense_index(S.select(*keys, *order), order, keys)


def attach(picks: DataFrame, S: DataFrame, indexed: DataFrame, by: Sequence[str],
           sides: Sequence[str], payload: Sequence[str], order: Sequence[str] = ORDER,
           derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Replace each ``<side>_idx`` by that row's payload columns.

    Draws meet the index by key, and the distinct drawn keys filter the
    corpus as it streams by; these keys are broadcast if their measured bytes
    allow it.  The payload is never broadcast: the drawn rows are dealt once
    by row key, and each side of the draws is merged with them there.
    ``derive`` adds payload columns to the drawn rows, each row once, so that
    the rest of the corpus is neither worked on nor shuffled.
    """
    keys = list(by)
    order = row_order(S, keys, order)
    small = measured_bytes(picks) * (1 + len(order)) <= BROADCAST_MAX_BYTES

    def hint(df):
        # every join below keeps the row count of ``picks`` (one index row
        # per pick) and adds key columns only, so one measure covers them all
        return F.broadcast(df) if small else df

    out = picks
    for side in sides:
        ix = indexed.select(*keys, F.col("row_idx").alias(f"{side}_idx"),
                            *[F.col(o).alias(f"{side}_{o}") for o in order])
        out = ix.join(hint(out), on=[*keys, f"{side}_idx"])
    if not payload:
        return out
    if not small:
        # one row per draw, written once: for the keys and for the last join
        out = checkpoint(out)
    need = None
    for side in sides:
        part = out.select(*keys, *[F.col(f"{side}_{o}").alias(o) for o in order])
        need = part if need is None else need.unionByName(part)
    n_parts = int(S.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = need.distinct()
    rows = S if derive else S.select(*keys, *order, *payload)
    if not small and measured_bytes(need) <= BROADCAST_MAX_BYTES:
        small = True
        if len(order) > 1:
            # only documents with a drawn row are split into sentences
            docs = need.select(*keys, *order[:-1]).distinct()
            rows = rows.join(F.broadcast(docs), on=[*keys, *order[:-1]], how="left_semi")
    rows = rows.join(hint(need), on=[*keys, *order], how="left_semi").repartition(n_parts, *keys, *order)
    if derive:
        rows = derive(rows)
    for side in sides:
        rs = rows.select(*keys, *[F.col(o).alias(f"{side}_{o}") for o in order],
                         *[F.col(p).alias(f"{side}_{p}") for p in payload])
        out = out.join(rs.hint("merge"), on=[*keys, *[f"{side}_{o}" for o in order]])
    return out


def sample_pairs(S: DataFrame, n_samples: int = 1000, trials: int = 3, seed: int = 0,
                 by: Sequence[str] | None = None, payload: Sequence[str] = ("nl_instructions",),
                 distinct: bool = False, order: Sequence[str] = ORDER,
                 index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """R2: ``trials x n_samples`` (query, reference) pairs per group, drawn
    uniformly with replacement (``distinct=True``: never the same row).
    ``index`` reuses an :func:`index_corpus` result of the same ``S``."""
    keys = _by(by)
    indexed, sizes = index if index is not None else index_corpus(S, keys, order)
    picks = draws(sizes, n_samples, trials, seed, keys, ("q", "r"), distinct)
    return attach(picks, S, indexed, keys, ("q", "r"), payload, order)


def sample_with_replacement(S: DataFrame, n_samples: int, trials: int = 3, batches: int = 1,
                            seed: int = 0, by: Sequence[str] | None = None,
                            payload: Sequence[str] = ("nl_instructions",),
                            order: Sequence[str] = ORDER,
                            derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``n_samples`` rows per (group, trial, batch), with replacement.
    ``derive`` adds payload columns to the drawn rows (:func:`attach`)."""
    keys = _by(by)
    indexed, sizes = index_corpus(S, keys, order)
    picks = draws(sizes, n_samples, trials, seed, keys, ("s",), batches=batches)
    out = attach(picks, S, indexed, keys, ("s",), payload, order, derive)
    ren = {f"s_{p}": p for p in payload}
    return out.select(*[F.col(c).alias(ren.get(c, c)) for c in out.columns])


def shuffle_rows(S: DataFrame, seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """The rows of each group in a seeded random order.

    The sort key is ``md5(seed|row key)``; ``position`` is the row's place in
    the group, 0 to N - 1.  The rows are range-partitioned on the key and
    written sorted, partition after partition, so reading the result gives
    the order and a restarted task gives the same rows."""
    keys = _by(by)
    order = row_order(S, keys, ORDER)
    drawn = S.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), *[
        F.col(c).cast("string") for c in (*keys, *order)])))
    shuffled, _ = dense_index(drawn, ["shuffle_key", *order], keys, out_col="position")
    return shuffled


def trial_means(scored: DataFrame, score_col: str = "score", by: Sequence[str] | None = None) -> DataFrame:
    """Mean score per (group, trial)."""
    return scored.groupBy(*_by(by), "trial").agg(F.avg(score_col).alias("trial_mean"))


def trial_summary(means: DataFrame, by: Sequence[str] | None = None,
                  mean_col: str = "trial_mean") -> DataFrame:
    """Average and population standard deviation of the trial means."""
    return means.groupBy(*_by(by)).agg(F.avg(mean_col).alias("avg"),
                                       F.stddev_pop(mean_col).alias("std"))
