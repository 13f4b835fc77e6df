"""Sentence table construction: clean, split, explode (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.functions.text import clean_text, split_sentences, tokenize

TEXT = "nl_instructions"


def clean_column(df: DataFrame, text_col: str = TEXT) -> DataFrame:
    """Replace the text column by its cleaned form (null when empty)."""
    return df.withColumn(text_col, clean_text(text_col))


def split_column(df: DataFrame, text_col: str = TEXT, out_col: str = "sentences") -> DataFrame:
    """Add ``array<string>`` of cleaned, non-empty sentences."""
    return df.withColumn(out_col, split_sentences(text_col))


def explode_sentences(df: DataFrame, list_col: str = "sentences",
                      text_col: str = TEXT, pos_col: str = "pos") -> DataFrame:
    """One row per list element; the element position is kept in ``pos``."""
    others = [c for c in df.columns if c not in (list_col, text_col, pos_col)]
    return df.select(*others, F.posexplode(list_col).alias(pos_col, text_col))


def drop_blank(df: DataFrame, text_col: str = TEXT) -> DataFrame:
    """Rows whose text is neither null nor the empty string."""
    c = F.col(text_col)
    return df.filter(c.isNotNull() & (c != ""))


def drop_na(df: DataFrame, text_col: str = TEXT) -> DataFrame:
    """Rows with a non-null text."""
    return df.filter(F.col(text_col).isNotNull())


def clean_and_standardize(df: DataFrame, text_col: str = TEXT, pos_col: str = "pos") -> DataFrame:
    """One cleaned sentence per row; every other column is repeated.

    ``pos`` is the 0-based position of the sentence among the kept sentences
    of its input row, so ``(row key, pos)`` is a total order.  A single
    narrow projection: runs inside the scan stage, no shuffle.
    """
    others = [c for c in df.columns if c not in (text_col, pos_col)]
    return df.select(*others, F.posexplode(split_sentences(text_col)).alias(pos_col, text_col))


def with_tokens(df: DataFrame, text_col: str = TEXT, out_col: str = "tokens") -> DataFrame:
    """Add whitespace tokens of the text."""
    return df.withColumn(out_col, tokenize(text_col))
