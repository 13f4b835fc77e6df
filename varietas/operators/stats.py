"""Corpus statistics: counts, distinct counts, histograms, frequencies.

Every statistic is grouped by ``by`` (default ``["ds_name"]``; ``[]`` gives
one corpus-wide row).  Aggregations are partial (map-side) first, so the
shuffle carries one row per group per partition, not one row per input row.
Top-k per group never sorts a whole group in one task: candidates are cut
per (group, hash bucket) first, then per group (at most k * buckets rows).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.functions.text import tokenize
from varietas.operators.joins import broadcast_if_small
from varietas.operators.ordering import dense_index
from varietas.session import checkpoint

TEXT = "nl_instructions"
DEFAULT_BY = ("ds_name",)

# The default stop-word list of the word-cloud step (lower
# case; a token is dropped when its lower-cased form is in the list).
STOPWORDS = (
    "a about above after again against all also am an and any are aren't as "
    "at be because been before being below between both but by can can't "
    "cannot com could couldn't did didn't do does doesn't doing don't down "
    "during each else ever few for from further get had hadn't has hasn't "
    "have haven't having he he'd he'll he's hence her here here's hers "
    "herself him himself his how how's however http i i'd i'll i'm i've if "
    "in into is isn't it it's its itself just k let's like me more most "
    "mustn't my myself no nor not of off on once only or other otherwise "
    "ought our ours ourselves out over own r same shall shan't she she'd "
    "she'll she's should shouldn't since so some such than that that's the "
    "their theirs them themselves then there there's therefore these they "
    "they'd they'll they're they've this those through to too under until "
    "up very was wasn't we we'd we'll we're we've were weren't what what's "
    "when when's where where's which while who who's whom why why's with "
    "won't would wouldn't www you you'd you'll you're you've your yours "
    "yourself yourselves"
).split()

# Word pattern of the word-cloud step: a word character followed by one or
# more word characters or apostrophes (so single characters are skipped).
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def _by(by) -> list[str]:
    return list(DEFAULT_BY if by is None else by)


def total_instructions(df: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """A1: number of rows per group."""
    return df.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("n_rows"))


def unique_commands(df: DataFrame, text_col: str = TEXT,
                    by: Sequence[str] | None = None) -> DataFrame:
    """A2: distinct texts per group, a null text counted as one value."""
    c = F.col(text_col)
    return df.groupBy(*_by(by)).agg(
        (F.count_distinct(c) + F.max(c.isNull().cast("int"))).cast("bigint").alias("n_unique"))


def nunique(df: DataFrame, col: str, by: Sequence[str] | None = None,
            approx_rsd: float | None = None) -> DataFrame:
    """A3: distinct non-null values per group.

    ``approx_rsd`` switches to HyperLogLog++ (``approx_count_distinct``),
    which needs no shuffle of the values themselves at very large scale.
    """
    c = F.col(col)
    agg = (F.approx_count_distinct(c, approx_rsd) if approx_rsd else F.count_distinct(c))
    return df.groupBy(*_by(by)).agg(agg.cast("bigint").alias("n_unique"))


def unique_unigrams(df: DataFrame, text_col: str = TEXT,
                    by: Sequence[str] | None = None) -> DataFrame:
    """A4: distinct case-sensitive whitespace tokens per group.

    Tokens are exploded and de-duplicated per (group, token) with a partial
    aggregate before the shuffle; the shuffle key includes the token, so a
    hot group is spread over all reducers.
    """
    keys = _by(by)
    # a text without tokens gives one null, so its group is counted as 0
    toks = df.select(*keys, F.explode_outer(tokenize(text_col)).alias("_tok"))
    distinct = toks.distinct()
    return distinct.groupBy(*keys).agg(F.count("_tok").alias("n_unigrams"))


def with_seq_len(df: DataFrame, text_col: str = TEXT, out_col: str = "seq_len") -> DataFrame:
    """Token count of the text (whitespace tokens)."""
    return df.withColumn(out_col, F.size(tokenize(text_col)))


def length_histogram(df: DataFrame, len_col: str = "seq_len",
                     by: Sequence[str] | None = None) -> DataFrame:
    """A5: count of rows per length value."""
    return df.groupBy(*_by(by), len_col).agg(F.count(F.lit(1)).alias("n"))


def length_histogram_summary(df: DataFrame, len_col: str = "seq_len",
                             by: Sequence[str] | None = None,
                             truncation_limit: int = 30, tail: str = "sum") -> DataFrame:
    """Share of rows per length per group, lengths clipped at a limit.

    ``share = n / sum(n) over the group``; lengths above the limit land in
    the last bin, which adds their shares (``tail='sum'``) or averages them
    (``tail='mean'``, what a bar plot of the clipped rows shows).
    """
    keys = _by(by)
    hist = length_histogram(df, len_col, keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    # hist has one row per (group, length): the window is over a histogram,
    # never over the input rows.
    shares = hist.withColumn("share", F.col("n") / F.sum("n").over(w))
    clipped = shares.withColumn("bin", F.least(F.col(len_col), F.lit(truncation_limit)))
    agg = F.sum("share") if tail == "sum" else F.avg("share")
    return clipped.groupBy(*keys, "bin").agg(agg.alias("share"))


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int,
                    bucket_col: str | None = None, buckets: int = 64) -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order``.

    Two rounds so no task ever ranks a whole group: rank inside
    (group, hash(bucket_col) % buckets) and keep k, then rank the at most
    ``k * buckets`` survivors of each group.
    """
    keys = list(by)
    if bucket_col is not None:
        df = df.withColumn("_b", F.pmod(F.xxhash64(bucket_col), F.lit(buckets)))
        w1 = Window.partitionBy(*keys, "_b").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_b")
    w2 = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def word_tokens(df: DataFrame, col: str, by: Sequence[str] | None = None) -> DataFrame:
    """Words of the word-cloud step: pattern words, trailing 's removed,
    all-digit words dropped, stop words (case-insensitive) dropped."""
    keys = _by(by)
    c = F.col(col)
    if dict(df.dtypes).get(col, "").startswith("array"):
        c = F.array_join(c, " ")
    words = df.select(*keys, F.explode(F.regexp_extract_all(
        c, F.lit("(" + WORD_PATTERN + ")"), 1)).alias("word"))
    w = F.col("word")
    words = words.withColumn("word", F.when(w.endswith("'s") | w.endswith("'S"), F.expr(
        "substring(word, 1, length(word) - 2)")).otherwise(w))
    # no word that begins with a byte from A to z is all digits: only the
    # others meet the pattern
    no_number = ((w >= "A") & (w < "{")) | ~w.rlike(r"^\p{Nd}+$")
    # the stop list is a fixed constant: an InSet filter, no join
    return words.filter(no_number & (w != "") & ~F.lower("word").isin(*STOPWORDS))


def merged_plurals(words: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per word with ``xs`` folded into ``x`` when ``x`` is also a
    word (not for ``ss``).  Both forms are counted side by side under their
    stem, so one aggregation does it; a stem never ends in ``s`` itself."""
    plural = F.col("key").endswith("s") & ~F.col("key").endswith("ss")
    stems = words.select(*keys, plural.alias("_plural"), F.when(
        plural, F.expr("substring(key, 1, length(key) - 1)")).otherwise(F.col("key")).alias("_stem"))
    counts = stems.groupBy(*keys, "_stem").agg(
        F.count_if(~F.col("_plural")).alias("_singular"), F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.when(F.col("_singular") > 0, F.col("_stem"))
                         .otherwise(F.concat("_stem", F.lit("s"))).alias("key"), "n")


def word_frequency(df: DataFrame, col: str = TEXT, by: Sequence[str] | None = None,
                   max_words: int = 100, normalize_plurals: bool = True) -> DataFrame:
    """The ``max_words`` most frequent words per group, case-folded,
    with ``rel = n / max(n)`` (the word-cloud scaling)."""
    keys = _by(by)
    words = word_tokens(df, col, keys).select(*keys, F.lower("word").alias("key"))
    counts = (merged_plurals(words, keys) if normalize_plurals else
              words.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n")))
    top = top_k_per_group(counts, keys, [F.col("n").desc(), F.col("key")], max_words,
                          bucket_col="key")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return top.select(*keys, F.col("key").alias("word"), "n", "rank",
                      (F.col("n") / F.max("n").over(w)).alias("rel"))


def words_of(c: Column) -> Column:
    """Pattern words of a text in order, lower case, trailing 's removed,
    all-digit words dropped; stop words are kept."""
    def plain(w: Column) -> Column:
        return F.when(w.endswith("'s"), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w)

    found = F.transform(F.regexp_extract_all(c, F.lit("(" + WORD_PATTERN + ")"), 1), lambda w: plain(F.lower(w)))
    return F.filter(found, lambda w: ~w.rlike(r"^\p{Nd}+$") & (w != ""))


def adjacent_words(words: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a blank; a pair that
    holds a stop word is dropped.  ``words`` is evaluated once."""
    def pairs(w: Column) -> Column:
        # a stop word becomes null, which makes its pairs null
        kept = F.transform(w, lambda x: F.when(~x.isin(*STOPWORDS), x))
        return F.transform(F.array(kept), lambda k: F.array_compact(F.zip_with(
            k, F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))[0]

    return F.transform(F.array(words), pairs)[0]


def bigram_frequency(df: DataFrame, col: str = TEXT, by: Sequence[str] | None = None,
                     top: int = 100) -> DataFrame:
    """Most frequent adjacent word pairs, counted inside each text,
    never across texts.  Words are paired first; a pair that holds a stop
    word is dropped, so no pair bridges a removed word.  (Pattern words,
    trailing 's removed, all-digit words dropped before pairing.)"""
    keys = _by(by)
    # an outer explode: a plain one puts a filter on the array's size before
    # it, and all words would be formed a second time
    grams = df.select(*keys, F.explode_outer(adjacent_words(words_of(F.col(col)))).alias("bigram")) \
        .where(F.col("bigram").isNotNull())
    counts = grams.groupBy(*keys, "bigram").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, keys, [F.col("n").desc(), F.col("bigram")], top,
                           bucket_col="bigram")


def _first_seen(df: DataFrame, keys: list[str], col: str, order_cols: Sequence[str]) -> Column:
    return F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order_cols)]))


def _firsts(df: DataFrame, keys: list[str], col: str, order_cols: Sequence[str],
            extra_aggs: Sequence[Column] = ()) -> tuple[DataFrame, list[str]]:
    """One row per distinct value with the place it is first seen at, and the
    columns of that place."""
    first = df.groupBy(*keys, col).agg(_first_seen(df, keys, col, order_cols).alias("_first"),
                                       *extra_aggs)
    fcols = [f"_f{i}" for i in range(len(order_cols))]
    return first.select("*", *[F.col(f"_first._o{i}").alias(f) for i, f in enumerate(fcols)]).drop("_first"), fcols


def value_codes(df: DataFrame, col: str, order_cols: Sequence[str], out_col: str = "code",
                by: Sequence[str] | None = None, extra_aggs: Sequence[Column] = (),
                keep_value: bool = True) -> DataFrame:
    """One row per distinct value with its first-appearance code (0, 1, ...).

    The distinct values are ranked by their first ``order_cols`` with the
    range-partitioned dense index, so no window ever holds all distinct
    values of a group.  Without ``keep_value`` the values, which may be long,
    are left behind before that order.
    """
    keys = _by(by)
    first, fcols = _firsts(df, keys, col, order_cols, extra_aggs)
    if not keep_value:
        first = checkpoint(first.drop(col))
    indexed, _ = dense_index(first, fcols, keys, out_col=out_col)
    return indexed.drop(*fcols)


def dictionary_encode(df: DataFrame, col: str, order_cols: Sequence[str], out_col: str = "code",
                      by: Sequence[str] | None = None) -> DataFrame:
    """Code every distinct value by its first appearance (0, 1, ...)
    and join the codes back to the rows (equi-join on the value)."""
    keys = _by(by)
    codes = value_codes(df, col, order_cols, out_col, keys)
    # one row per distinct value: broadcast when a count shows it is small,
    # so a hot value is not a skewed join key; otherwise AQE splits skew
    return df.join(broadcast_if_small(codes), on=[*keys, col], how="left")


def value_counts(df: DataFrame, col: str, by: Sequence[str] | None = None) -> DataFrame:
    """A8d: rows per value."""
    return df.groupBy(*_by(by), col).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, k: int = 25, by: Sequence[str] | None = None,
               exemplar_col: str | None = None,
               order_cols: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """The k most frequent values and, optionally, the
    ``exemplar_col`` of the first row holding each value (``min_by`` in the
    same partial aggregate)."""
    keys = _by(by)
    aggs = [F.count(F.lit(1)).alias("n")]
    if exemplar_col:
        aggs.append(F.min_by(exemplar_col, F.struct(*order_cols)).alias("exemplar"))
    counts = df.groupBy(*keys, col).agg(*aggs)
    return top_k_per_group(counts, keys, [F.col("n").desc(), F.col(col)], k, bucket_col=col)


def common_parses(df: DataFrame, col: str, exemplar_col: str, k: int = 25,
                  by: Sequence[str] | None = None,
                  order_cols: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Code, count and exemplar of the k most frequent parses.

    The distinct parses are written once; only their places are put in order
    for the codes, and the few best parses look their codes up."""
    keys = _by(by)
    first, fcols = _firsts(df, keys, col, order_cols, [
        F.count(F.lit(1)).alias("n"),
        F.min_by(exemplar_col, F.struct(*order_cols)).alias("exemplar")])
    first = checkpoint(first.withColumn("_id", F.monotonically_increasing_id()))
    codes, _ = dense_index(first.select(*keys, *fcols, "_id"), fcols, keys, out_col="code")
    top = checkpoint(top_k_per_group(first, keys, [F.col("n").desc(), F.col(col)], k, bucket_col=col))
    return codes.select("_id", "code").join(broadcast_if_small(top), "_id") \
        .select(*keys, col, "n", "exemplar", "code", "rank")
