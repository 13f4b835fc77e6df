"""The report job — chosen metrics over the sentence table, one row per
(group, metric), with the report line.

The sentence table is materialised once (reliable checkpoint) and every
metric reads it; all pair metrics share one draw of pairs.  Metrics are
worked out one after the other and their few rows written, so that the disk
holds the shuffles of one metric at a time.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.operators import annotate, diversity, pairwise, patterns, sampling, stats, trees
from varietas.session import checkpoint, shuffles_dropped

TEXT = "nl_instructions"
TREE = "constituency_parse_tree"

# Report line formats and their order ({v} value, {s} stddev).
LINES = {
    "unique_commands": "Number of unique commands in dataset: {v}",
    "unique_unigrams": "Number of unique unigrams in dataset: {v}",
    "rouge_l": "Average rouge-l pairwise scores: {v}. Stddev: {s}.",
    "rouge_1": "Average rouge-1 pairwise scores: {v}. Stddev: {s}.",
    "bleu": "Average bleu pairwise scores: {v}. Stddev: {s}.",
    "bertscore": "Average bertscore pairwise scores: {v}. Stddev: {s}.",
    "levenshtein": "Average levenshtein pairwise distances: {v}. Stddev: {s}.",
    "treekernel": "Average tree kernel pairwise distances: {v}. Stddev: {s}.",
    "jaccard": "Average Jaccard pairwise distances: {v}. Stddev: {s}.",
    "compression_ratio": "Compression Ratio: {v}. ",
    "homogenization": "Homogenization Score for rougel, estimated from drawn pairs: {v}. Stddev: {s}.",
    "homogenization_minhash": "Homogenization Score for jaccard, over all pairs: {v}. Standard error: {s}.",
    "ngram_diversity": "Ngram Diversity Score for 4-gram: {v}. ",
    "common_patterns": "Common Parses:\n{v}",
    "homogenization_cosine": "Homogenization (mean cosine over all pairs): {v}. ",
}
ORDER = {m: i for i, m in enumerate(LINES)}
PAIR_METRICS = ("rouge_l", "rouge_1", "bleu", "levenshtein", "jaccard")
ALL_METRICS = tuple(LINES)
# bertscore needs a table of vectors besides the texts
TEXT_METRICS = tuple(m for m in ALL_METRICS if m != "bertscore")
SQL_METRICS = ("unique_commands", "unique_unigrams", "rouge_l", "rouge_1", "bleu",
               "levenshtein", "jaccard", "homogenization", "homogenization_minhash",
               "homogenization_cosine", "ngram_diversity")


def fmt4(c: Column) -> Column:
    """Value with 4 decimals, rounded once from the double."""
    return F.when(c.isNotNull(), F.format_string("%.4f", c))


def _line(metric: str, v: Column, s: Column | None) -> Column:
    head, _, rest = LINES[metric].partition("{v}")
    if "{s}" in rest:
        mid, _, tail = rest.partition("{s}")
        return F.concat(F.lit(head), v, F.lit(mid), s, F.lit(tail))
    return F.concat(F.lit(head), v, F.lit(rest))


def _rows(df: DataFrame, keys: list[str], metric: str, value: str, std: str | None,
          integer: bool = False) -> DataFrame:
    v = F.col(value).cast("double")
    s = F.col(std).cast("double") if std else F.lit(None).cast("double")
    vtxt = F.col(value).cast("bigint").cast("string") if integer else fmt4(v)
    line = _line(metric, vtxt, fmt4(s) if std else None)
    return df.select(*keys, F.lit(ORDER[metric]).alias("ord"), F.lit(metric).alias("metric"),
                     F.round(v, 6).alias("value"), F.round(s, 6).alias("std"), line.alias("line"))


def build_report(S: DataFrame, metrics: Sequence[str] = TEXT_METRICS,
                 by: Sequence[str] = ("ds_name",), n_samples: int = 1000, trials: int = 3,
                 seed: int = 0, materialize: bool = True,
                 scored_vectors: DataFrame | None = None) -> DataFrame | None:
    """Report rows ``(by, ord, metric, value, std, line)``; ``None`` when no
    metric is chosen (the job then writes no report).

    ``bertscore`` needs ``scored_vectors``: drawn pairs ``(by, trial, sid,
    f1)`` from ``embeddings.greedy_match_pairs``, since vectors come from a
    table of their own.  An unknown metric, or one that cannot be filled,
    raises."""
    unknown = [m for m in metrics if m not in LINES]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    if "bertscore" in metrics and scored_vectors is None:
        raise ValueError("bertscore needs scored_vectors")
    if not metrics:
        return None
    with shuffles_dropped(S.sparkSession):
        parts = _parts(S, metrics, list(by), n_samples, trials, seed, materialize, scored_vectors)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parts(S: DataFrame, metrics: Sequence[str], keys: list[str], n_samples: int, trials: int, seed: int,
           materialize: bool, scored_vectors: DataFrame | None) -> list[DataFrame]:
    """The written rows of each metric."""
    S = S.select(*keys, "doc_id", "pos", TEXT)
    if materialize:
        S = checkpoint(S)
    parts: list[DataFrame] = []

    def add(*row) -> None:
        parts.append(checkpoint(_rows(*row)))

    # one sampling index serves every drawn metric (pairs, trees, homogenisation)
    idx = (sampling.index_corpus(S, keys)
           if set(metrics) & {*PAIR_METRICS, "treekernel", "homogenization"} else None)
    if "unique_commands" in metrics:
        add(stats.unique_commands(S, by=keys), keys, "unique_commands", "n_unique", None, True)
    if "unique_unigrams" in metrics:
        add(stats.unique_unigrams(S, by=keys), keys, "unique_unigrams", "n_unigrams", None, True)
    pm = [m for m in PAIR_METRICS if m in metrics]
    if pm:
        summ = checkpoint(pairwise.pairwise_summaries(S, pm, n_samples, trials, seed, keys, index=idx))
        for m in pm:
            parts.append(_rows(summ.filter(F.col("metric") == m), keys, m, "avg", "std"))
    if "bertscore" in metrics:
        means = sampling.trial_means(scored_vectors.withColumnRenamed("f1", "score"), by=keys)
        add(sampling.trial_summary(means, by=keys), keys, "bertscore", "avg", "std")
    if "treekernel" in metrics:
        # parse only the drawn sentences (same draws as over a tree table)
        pairs = sampling.sample_pairs(S, n_samples, trials, seed, keys, index=idx)
        pairs = pairs.select(*keys, "trial", *[annotate.shallow_tree_of_text(F.col(f"{s}_{TEXT}"))
                                               .alias(f"{s}_{TREE}") for s in ("q", "r")])
        scored = trees.treekernel_pairs(pairs, f"q_{TREE}", f"r_{TREE}")
        add(trees.treekernel_summary(scored, keys), keys, "treekernel", "avg", "std")
    if "compression_ratio" in metrics:
        add(diversity.compression_ratio(S, keys), keys, "compression_ratio", "compression_ratio", None)
    if "homogenization" in metrics:
        add(diversity.homogenization(S, "rouge_l", n_samples, trials, seed, keys, idx), keys, "homogenization",
            "homogenization", "std")
    if "homogenization_minhash" in metrics:
        add(diversity.homogenization_minhash(S, keys), keys, "homogenization_minhash", "homogenization", "std_error")
    if "homogenization_cosine" in metrics:
        add(diversity.homogenization_cosine(S, keys), keys, "homogenization_cosine", "homogenization", None)
    if "ngram_diversity" in metrics:
        add(diversity.ngram_diversity(S, 4, keys), keys, "ngram_diversity", "ngram_diversity", None)
    if "common_patterns" in metrics:
        pj = patterns.patterns_json(patterns.common_patterns(S, seed=seed, by=keys, tag=annotate.pos_tag), keys)
        none = F.lit(None).cast("double")
        parts.append(checkpoint(pj.select(
            *keys, F.lit(ORDER["common_patterns"]).alias("ord"), F.lit("common_patterns").alias("metric"),
            none.alias("value"), none.alias("std"), _line("common_patterns", F.col("patterns_json"), None).alias("line"))))
    return parts
