"""Words and word pairs of a word cloud, with collocations.

Two adjacent words that stand together far more often than their own counts
explain are one term.  The measure is the log-likelihood ratio of the pair's
2 x 2 counts (Dunning 1993): how much better two separate rates of the second
word, after the first word and elsewhere, explain the counts than one common
rate.  Occurrences that belong to an accepted pair are taken off its words.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.operators.joins import broadcast_if_small, lookup_join
from varietas.operators.ordering import with_group
from varietas.operators.stats import STOPWORDS, adjacent_words, merged_plurals, top_k_per_group, words_of
from varietas.session import checkpoint

DEFAULT_BY = ("ds_name",)
# Fixed value: the default score that a pair has to exceed.
THRESHOLD = 30.0


def log_likelihood_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Score of a pair seen ``both`` times, whose words were seen ``first``
    and ``second`` times among ``total`` words; 0 if a word is all there is."""

    def log_rate(hits: Column, trials: Column, rate: Column) -> Column:
        # 0 hits of a rate 0 add nothing: the floor only keeps the logarithm finite
        floor = F.lit(1e-10)
        return (hits * F.log(F.greatest(rate, floor))
                + (trials - hits) * F.log(F.greatest(1 - rate, floor)))

    after, elsewhere = first, total - first
    hits_after, hits_elsewhere = both, second - both
    common = second / total
    apart = log_rate(hits_after, after, hits_after / after) \
        + log_rate(hits_elsewhere, elsewhere, hits_elsewhere / elsewhere)
    together = log_rate(hits_after, after, common) + log_rate(hits_elsewhere, elsewhere, common)
    return F.when((total <= first) | (total <= second), F.lit(0.0)).otherwise(2 * (apart - together))


def word_forms(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``word, standard, n``: each counted word with the form that stands
    for it (the singular if that is a word too) and that form's count."""
    plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss")
    stem = F.when(plural, F.expr("substring(word, 1, length(word) - 1)")).otherwise(F.col("word"))
    stems = counts.groupBy(*keys, stem.alias("_stem")).agg(
        F.sum(F.when(~plural, F.col("n"))).alias("_one"), F.sum(F.when(plural, F.col("n"))).alias("_many"))
    several = F.concat("_stem", F.lit("s"))
    standard = F.when(F.col("_one").isNotNull(), F.col("_stem")).otherwise(several)
    seen = F.array_compact(F.array(F.when(F.col("_one").isNotNull(), F.col("_stem")),
                                   F.when(F.col("_many").isNotNull(), several)))
    return stems.select(*keys, F.explode(seen).alias("word"), standard.alias("standard"),
                        (F.coalesce("_one", F.lit(0)) + F.coalesce("_many", F.lit(0))).alias("n"))


def scored_pairs(df: DataFrame, col: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(pairs, words)``: pairs with ``bigram, n, first, second, score`` and
    standard words with ``word, n``."""
    found = words_of(F.col(col))
    # written once: one row per word and per pair, which several steps below read
    counts = checkpoint(df.select(*keys, F.explode_outer(found).alias("word"))
                        .where(F.col("word").isNotNull() & ~F.col("word").isin(*STOPWORDS))
                        .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")))
    forms = word_forms(counts, keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    grams = df.select(*keys, F.explode_outer(adjacent_words(found)).alias("key")).where(F.col("key").isNotNull())
    pairs = checkpoint(merged_plurals(grams, list(keys)).withColumnRenamed("key", "bigram"))
    parts = F.split("bigram", " ")
    for side, at in (("first", 0), ("second", 1)):
        lookup = forms.select(*keys, F.col("word").alias("_word"), F.col("standard").alias(side),
                              F.col("n").alias(f"_{side}"))
        # the pairs are distinct, so a frequent word has one row per partner:
        # no key is so hot that a large table were worth copying for it
        pairs = pairs.withColumn("_word", parts[at]).join(broadcast_if_small(lookup), [*keys, "_word"]).drop("_word")
    pairs = lookup_join(pairs, totals, keys, "bigram")
    score = log_likelihood_ratio(*[F.col(c).cast("double") for c in ("n", "_first", "_second", "_total")])
    words = forms.where(F.col("word") == F.col("standard")).select(*keys, "word", "n")
    return pairs.select(*keys, "bigram", "n", "first", "second", score.alias("score")), words


def collocations(df: DataFrame, col: str = "nl_instructions", by: Sequence[str] | None = None,
                 max_words: int = 100, threshold: float = THRESHOLD) -> DataFrame:
    """The ``max_words`` most frequent terms of each group: ``term, n, rank,
    rel, score``.  A term is a word, or a pair whose ``score`` exceeds
    ``threshold``; an accepted pair's occurrences no longer count for its
    words."""
    df, keys = with_group(df, list(DEFAULT_BY if by is None else by))
    pairs, words = scored_pairs(df, col, keys)
    taken = checkpoint(pairs.where(F.col("score") > threshold))
    used = taken.select(*keys, "n", F.explode(F.array("first", "second")).alias("word")) \
        .groupBy(*keys, "word").agg(F.sum("n").alias("_used"))
    left = words.join(used, [*keys, "word"], "left").select(
        *keys, F.col("word").alias("term"), (F.col("n") - F.coalesce("_used", F.lit(0))).alias("n"),
        F.lit(None).cast("double").alias("score"))
    terms = left.unionByName(taken.select(*keys, F.col("bigram").alias("term"), "n", "score"))
    top = top_k_per_group(terms, keys, [F.col("n").desc(), F.col("term")], max_words, bucket_col="term")
    w = Window.partitionBy(*keys)
    return top.select(*keys, "term", "n", "rank", (F.col("n") / F.max("n").over(w)).alias("rel"), "score").drop("_all")
