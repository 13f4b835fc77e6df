"""Text cleaning and tokenisation as Spark column expressions.

All of these compile to JVM expressions (regexp_replace, translate, split,
filter/transform higher-order functions), so they run inside the scan
stage with no Python worker and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
# the 32 ASCII punctuation characters deleted by cleaning (Python's
# ``string.punctuation``), in their natural order.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""

# Python's ``str.split()`` / ``re`` ``\s`` treat U+001C..U+001F as
# whitespace; Java's Unicode ``\s`` does not, so they are added explicitly.
_WS = r"[\s\x1c-\x1f]"
WHITESPACE_RUN = r"(?U)" + _WS + "+"
# The same characters without the blank, and the runs that are not yet one
# blank: text with single blanks needs no replacement.
_OTHER_WS = r"[\s\x1c-\x1f&&[^ ]]"
OTHER_WHITESPACE = r"(?U)" + _OTHER_WS
UNCOLLAPSED_RUN = r"(?U)(?:" + _OTHER_WS + _WS + "*| " + _WS + "+)"
# A sentence ends at whitespace that follows '.', '!' or '?'.
SENTENCE_BREAK = r"(?U)(?<=[.!?])" + _WS + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cleaned(c) -> Column:
    return F.translate(F.trim(F.regexp_replace(_col(c), UNCOLLAPSED_RUN, " ")), PUNCTUATION, "")


def clean_text(c) -> Column:
    """Collapse whitespace runs, strip, delete ASCII punctuation; '' -> null.

    Punctuation is removed after the collapse, so ``a - b`` keeps two
    spaces (``a  b``) and ``- -`` becomes a single space, which is kept.
    """
    return F.nullif(_cleaned(c), F.lit(""))


def split_sentences(c) -> Column:
    """Split on whitespace after ``.!?``, clean every piece, drop empties.

    Returns ``array<string>`` (empty array when nothing survives, null for a
    null input) so that ``posexplode`` yields one row per kept sentence.
    """
    pieces = F.split(_col(c), SENTENCE_BREAK)
    # empty strings are dropped without a null in their place, which would
    # clean every piece twice
    return F.filter(F.transform(pieces, _cleaned), lambda s: s != "")


def tokenize(c) -> Column:
    """Whitespace tokens; empty strings that ``split`` leaves are removed.

    Other whitespace becomes blanks first: a split at one plain character
    compiles no pattern for each row."""
    return F.filter(F.split(F.regexp_replace(_col(c), OTHER_WHITESPACE, " "), " "), lambda t: t != "")


def lower_tokens(c) -> Column:
    """Lower-cased whitespace tokens (Jaccard's token definition)."""
    return tokenize(F.lower(_col(c)))


def rouge_tokens(c) -> Column:
    """ROUGE tokenisation: lower-case, every run outside [a-z0-9] is a
    separator, no stemming."""
    return F.filter(
        F.split(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "), " "),
        lambda t: t != "")


def ngrams(tokens, n: int) -> Column:
    """Overlapping n-grams of a token array, each joined with one space."""
    arr = _col(tokens)
    size = F.size(arr)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1),
                        lambda i: F.array_join(F.slice(arr, i, n), " "))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))
