"""Sampled pairwise similarity: draw pairs, score them, summarise trials.

One draw of pairs serves every metric (same seed -> same pairs), and all
metrics of a draw are scored in one projection over the pair table.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.functions.similarity import (bleu, jaccard, levenshtein, rouge_l_f,
                                           rouge_n_f)
from varietas.functions.text import lower_tokens, rouge_tokens, tokenize
from varietas.operators.sampling import (DEFAULT_BY, sample_pairs, trial_means,
                                         trial_summary)

TEXT = "nl_instructions"

# metric -> (token preparation or None for raw text, pair score)
METRICS: dict[str, tuple[Callable | None, Callable]] = {
    "bleu": (tokenize, bleu),
    "rouge_l": (rouge_tokens, rouge_l_f),
    "rouge_1": (rouge_tokens, rouge_n_f),
    "jaccard": (lambda c: F.array_distinct(lower_tokens(c)), jaccard),
    "levenshtein": (None, levenshtein),
}


def _by(by) -> list[str]:
    return list(DEFAULT_BY if by is None else by)


def pair_score(metric: str, q: Column | str, r: Column | str) -> Column:
    prep, fn = METRICS[metric]
    q = F.col(q) if isinstance(q, str) else q
    r = F.col(r) if isinstance(r, str) else r
    if prep is None:
        return fn(q, r).cast("double")
    return fn(prep(q), prep(r)).cast("double")


def score_pairs(pairs: DataFrame, metrics: Sequence[str], q_col: str = f"q_{TEXT}",
                r_col: str = f"r_{TEXT}") -> DataFrame:
    """Add one score column per metric.

    Token arrays are computed once per side in a first projection and the
    scores read them, so tokenisation is not repeated per metric.
    """
    preps = {}
    staged = pairs
    for m in metrics:
        prep, _ = METRICS[m]
        if prep is not None:
            key = {"bleu": "ws", "rouge_l": "rg", "rouge_1": "rg", "jaccard": "jc"}[m]
            if key not in preps:
                staged = staged.withColumn(f"_q_{key}", prep(F.col(q_col))) \
                               .withColumn(f"_r_{key}", prep(F.col(r_col)))
                preps[key] = True
    out = staged
    for m in metrics:
        prep, fn = METRICS[m]
        if prep is None:
            sc = fn(F.col(q_col), F.col(r_col))
        else:
            key = {"bleu": "ws", "rouge_l": "rg", "rouge_1": "rg", "jaccard": "jc"}[m]
            sc = fn(F.col(f"_q_{key}"), F.col(f"_r_{key}"))
        out = out.withColumn(m, sc.cast("double"))
    return out.drop(*[c for c in out.columns if c.startswith("_q_") or c.startswith("_r_")])


def metric_pairs(S: DataFrame, metric: str, n_samples: int = 1000, trials: int = 3,
                 seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """Scored pair table: ``by, trial, sid, q/r keys, score``."""
    keys = _by(by)
    pairs = sample_pairs(S, n_samples, trials, seed, keys)
    return score_pairs(pairs, [metric]).withColumnRenamed(metric, "score")


def pairwise_summary(S: DataFrame, metric: str, n_samples: int = 1000, trials: int = 3,
                     seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """Sample -> score -> mean per trial -> average and population std."""
    keys = _by(by)
    scored = metric_pairs(S, metric, n_samples, trials, seed, keys)
    return trial_summary(trial_means(scored, "score", keys), keys)


def pairwise_summaries(S: DataFrame, metrics: Sequence[str], n_samples: int = 1000,
                       trials: int = 3, seed: int = 0,
                       by: Sequence[str] | None = None, index=None) -> DataFrame:
    """All metrics from one draw: ``by, metric, avg, std`` (long format)."""
    keys = _by(by)
    scored = score_pairs(sample_pairs(S, n_samples, trials, seed, keys, index=index), metrics)
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"))
                                for m in metrics])).alias("_m")
    long = scored.select(*keys, "trial", stack).select(*keys, "trial", "_m.metric", "_m.score")
    means = long.groupBy(*keys, "metric", "trial").agg(F.avg("score").alias("trial_mean"))
    return means.groupBy(*keys, "metric").agg(F.avg("trial_mean").alias("avg"),
                                              F.stddev_pop("trial_mean").alias("std"))
