"""The feature job — read, clean, annotate, (write)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.operators import annotate, clean

TEXT = "nl_instructions"


def build_features(corpus: DataFrame, text_col: str = TEXT, nouns: bool = True,
                   verbs: bool = True, seq_len: bool = True, parse_tree: bool = True,
                   dep_tree: bool = False) -> DataFrame:
    """Cleaned sentences with the requested feature columns, as one lazy
    narrow plan (no shuffle): split/clean, tag, then per-row features."""
    S = clean.clean_and_standardize(corpus, text_col)
    T = annotate.add_features(S, text_col, nouns=nouns, verbs=verbs, seq_len=seq_len)
    if parse_tree:
        T = T.withColumn("constituency_parse_tree",
                         annotate.shallow_tree(F.col("tokens"), F.col("tags")))
    if dep_tree:
        T = T.withColumn("dep_parse_tree", annotate.dep_tree_string(
            annotate.dependency_struct(F.col("tokens"), F.col("tags"))))
    return T.drop("tokens", "tags", "upos")
