"""Common part-of-speech patterns and map merging.

A pattern is a run of ``n`` consecutive tags of the concatenated sample (or
corpus); its texts are the token runs carrying it.  The most frequent
``top_k`` patterns of each sample are kept with all their texts, and the
samples are merged (union of texts per pattern).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from varietas.operators.ngrams import BUCKET, gram, inner_runs, run_rows, token_offsets, token_runs
from varietas.operators.joins import broadcast_if_small
from varietas.operators.ordering import with_group
from varietas.operators.runs import distinct_rows
from varietas.operators.sampling import sample_with_replacement
from varietas.operators.stats import top_k_per_group
from varietas.session import checkpoint

DEFAULT_BY = ("ds_name",)
# Numbers that runs of tags may take before they are numbered anew.
MOST_RUNS = 1 << 20


def _by(by) -> list[str]:
    return list(DEFAULT_BY if by is None else by)


def _text_counts(grams: DataFrame, group: list[str]) -> DataFrame:
    """Rows per (group, pattern, text): each text of a pattern once."""
    return grams.where(F.col("pattern").isNotNull()).groupBy(*group, "pattern", "text") \
        .agg(F.count(F.lit(1)).alias("n"))


def _ranked(patterns: DataFrame, group: list[str], top_k: int) -> DataFrame:
    """The ``top_k`` most frequent patterns; ``patterns`` has one row per
    distinct pattern of a group."""
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), F.col("pattern"))
    return patterns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k).drop("_r")


def common_patterns(T: DataFrame, n: int = 4, top_k: int = 5, n_samples: int = 10000,
                    batches: int = 4, trials: int = 3, seed: int = 0,
                    by: Sequence[str] | None = None, cross_boundary: bool = True,
                    tag: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per (trial, batch) draw ``n_samples // batches`` tagged sentences
    with replacement, find the ``top_k`` most frequent tag n-grams of the
    concatenated sample and every token n-gram carrying one of them; merge
    all batches.  Returns distinct ``(by, pattern, text)``.

    ``T`` needs ``tokens`` and ``tags`` arrays (from ``annotate.pos_tag``), or
    ``tag`` adds them to the sentences drawn: their number does not grow with
    the corpus, so a large one should come untagged.
    A sample is one array row per (group, trial, batch), bounded by the batch
    size and not by the corpus.  Its n-grams are formed once: counted per
    text, gathered with their texts per pattern, and the best patterns keep
    the texts they already hold.
    """
    T, keys = with_group(T, _by(by))
    per_batch = n_samples // batches
    picks = sample_with_replacement(T, per_batch, trials, batches, seed, keys,
                                    payload=("tokens", "tags"), derive=tag)
    group = [*keys, "trial", "batch"]
    if cross_boundary:
        drawn = picks.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("sid", "tokens", "tags"))).alias("_s"))
        rows = drawn.select(*group, F.flatten("_s.tokens").alias("token"), F.flatten("_s.tags").alias("tag"))
    else:
        rows = picks.select(*group, F.col("tokens").alias("token"), F.col("tags").alias("tag"))
    runs = inner_runs(rows, ["token", "tag"], group, n)
    counts = _text_counts(runs.select(*group, gram("tag", n).alias("pattern"), gram("token", n).alias("text")), group)
    patterns = counts.groupBy(*group, "pattern").agg(F.sum("n").alias("n"), F.collect_list("text").alias("_texts"))
    return _ranked(patterns, group, top_k).select(*keys, "pattern", F.explode("_texts").alias("text")) \
        .distinct().drop("_all")


def common_patterns_full(T: DataFrame, n: int = 4, top_k: int = 5,
                         by: Sequence[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """The same over the whole concatenated corpus of each group.

    Runs inside a document come from its own row, runs across documents from
    the documents' ends (``ngrams.token_runs``).  Patterns are counted without
    their texts, of which most are distinct; then only the runs of the few
    best patterns give their texts.
    """
    T, keys = with_group(T, _by(by))
    placed = token_offsets(T, F.col("tokens"), keys)
    pattern = gram("tag", n).alias("pattern")
    tags, _ = token_runs(T, {"tag": F.col("tags")}, n, keys, bucket, placed)
    totals = tags.select(*keys, pattern).where(F.col("pattern").isNotNull()) \
        .groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n"))
    top = checkpoint(top_k_per_group(totals, keys, [F.col("n").desc(), F.col("pattern")], top_k,
                                     bucket_col="pattern").select(*keys, "pattern"))
    rows = run_rows(T, {"token": F.col("tokens"), "tag": F.col("tags")}, n, keys, bucket, placed)
    # groups x top_k patterns go to the rows; the texts of a task leave it once
    best = top.groupBy(*keys).agg(F.collect_list("pattern").alias("_best"))
    named = [f for f in rows.schema.fields if f.name in keys]
    hits = rows.join(broadcast_if_small(best), keys, "left").select(*keys, "_best", "token", "tag").mapInArrow(
        _texts_of_best(n, len(keys)), StructType([*named, *[StructField(c, StringType()) for c in ("pattern", "text")]]))
    return hits.distinct().drop("_all")


def _texts_of_best(n: int, n_keys: int):
    """The ``mapInArrow`` function that gives the distinct texts of each batch
    that carry one of their group's ``_best`` patterns."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(batch.column("tag").value_lengths(), 0), np.int64)
            begin = np.cumsum(sizes) - sizes
            tags, tokens = (batch.column(c).flatten().dictionary_encode() for c in ("tag", "token"))
            names = tags.dictionary.to_pylist()
            tag, token = np.asarray(tags.indices, np.int64), np.asarray(tokens.indices, np.int64)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[c.to_pylist() for c in batch.columns[:n_keys]])):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                best = batch.column("_best")[rows[0]].as_py()
                starts = np.maximum(sizes[rows] - n + 1, 0)
                if not best or not starts.sum():
                    continue
                at = np.repeat(begin[rows] - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
                runs, span = tag[at], len(names)
                for i in range(1, n):
                    runs, span = runs * len(names) + tag[at + i], span * len(names)
                    if span > MOST_RUNS:  # the place of each run of tags among the distinct ones
                        distinct, runs = np.unique(runs, return_inverse=True)
                        span = len(distinct)
                first = np.full(span, -1)
                first[runs] = at
                kept = np.zeros(span, np.int64)  # from 1: the best pattern that a distinct run is
                for run in np.flatnonzero(first >= 0).tolist():
                    name = " ".join([names[t] for t in tag[first[run]:first[run] + n].tolist()])
                    if name in best:
                        kept[run] = best.index(name) + 1
                hit = np.flatnonzero(kept[runs])
                columns = [kept[runs[hit]], *[token[at[hit] + i] for i in range(n)]]
                if not len(hit):
                    continue
                found = distinct_rows(columns, max(len(best) + 1, len(tokens.dictionary)).bit_length())
                words = [tokens.dictionary.take(pa.array(c)) for c in found[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([k] * len(found[0]), t) for k, t in zip(key, batch.schema.types)],
                     pa.array(best, pa.string()).take(pa.array(found[0] - 1)), pc.binary_join_element_wise(*words, " ")],
                    [*batch.schema.names[:n_keys], "pattern", "text"])

    return texts


def merge_maps(df: DataFrame, map_col: str | Column, by: Sequence[str]) -> DataFrame:
    """Merge many ``key -> value(s)`` maps per group: every key with the
    union of its values, duplicates removed.  Long form ``(by, key, value)``
    (array values are flattened); no group is ever collected."""
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    ent = df.select(*by, F.explode(m).alias("key", "_v"))
    vtype = dict(ent.dtypes)["_v"]
    if vtype.startswith("array"):
        ent = ent.select(*by, "key", F.explode("_v").alias("_v"))
    return ent.select(*by, "key", F.col("_v").alias("value")).distinct()


def flatten_nested(c: Column, depth: int = 2) -> Column:
    """Flatten ``depth`` levels of nested arrays into one array."""
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


def patterns_json(patterns: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """One JSON object ``{pattern: [texts...]}`` per group for the
    report, one text a line, indented by four spaces; patterns and texts
    sorted.  Input is the (bounded) output of :func:`common_patterns`."""
    keys = _by(by)

    def quoted(c: Column) -> Column:
        # the JSON writer's own escapes, without the brackets of the array
        whole = F.to_json(F.array(c))
        return F.substring(whole, F.lit(2), F.length(whole) - 2)

    texts = F.array_join(F.transform(F.array_sort(F.collect_set("text")), quoted), ",\n        ")
    per = patterns.groupBy(*keys, "pattern").agg(texts.alias("_texts"))
    entry = F.concat(F.lit("    "), quoted(F.col("pattern")), F.lit(": [\n        "), "_texts", F.lit("\n    ]"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("pattern", entry.alias("entry")))), lambda x: x["entry"])
    return per.groupBy(*keys).agg(
        F.concat(F.lit("{\n"), F.array_join(entries, ",\n"), F.lit("\n}")).alias("patterns_json"))
