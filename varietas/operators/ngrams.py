"""Token runs of a corpus that is read as one long text per group.

A document's tokens stay one array row, so runs inside a document are array
slices of that row.  Only runs that cross from one document into the next
need an order over the corpus: for those, each document gives its first and
last ``n - 1`` tokens, placed by a prefix sum over one small row per
document.  The tokens themselves move once, by document, and are neither
range-partitioned nor written.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.operators.ordering import document_key, prefix_sum

# Positions per window of the tokens at the documents' ends.
BUCKET = 1 << 20


def document_arrays(S: DataFrame, arrays: dict[str, Column], by: Sequence[str],
                    doc: Sequence[str]) -> DataFrame:
    """One row per document: the sentences' arrays in order of ``pos``, each
    as one long array."""
    rows = S.select(*by, *doc, F.struct("pos", *[c.alias(k) for k, c in arrays.items()]).alias("_s"))
    docs = rows.groupBy(*by, *doc).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    # exploded from an array of one, so that the long arrays are formed once
    # and not for each of their places
    joined = F.struct(*[F.flatten(F.col(f"_s.{k}")).alias(k) for k in arrays])
    return docs.select(*by, *doc, F.explode(F.array(joined)).alias("_j")).select(*by, *doc, *[
        F.col(f"_j.{k}").alias(k) for k in arrays])


def inner_runs(rows: DataFrame, names: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    """Every position of every row's arrays with the ``n - 1`` that follow in
    the row (null past its end), as rows of :func:`token_runs`."""
    cut = rows.select(*by, *[
        F.slice(k, i + 1, F.greatest(F.size(k) - i, F.lit(0))).alias(f"{k}_{i}")
        for k in names for i in range(n)])
    columns = [f"{k}_{i}" for k in names for i in range(n)]
    return cut.select(*by, F.explode(F.arrays_zip(*columns)).alias("_z")) \
        .select(*by, F.lit(1).cast("bigint").alias("least"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def _crossing(docs: DataFrame, offsets: DataFrame, names: Sequence[str], by: Sequence[str],
              doc: Sequence[str], n: int, bucket: int) -> DataFrame:
    """Positions near a document's end with the ``n - 1`` that follow in the
    corpus; ``least`` is the length at which a run leaves the document."""
    k = n - 1
    size = F.size(names[0])
    places = F.when(size <= 2 * k, F.sequence(F.lit(0), size - 1)).otherwise(
        F.concat(F.sequence(F.lit(0), F.lit(k - 1)), F.sequence(size - k, size - 1)))
    ends = docs.where(size > 0).select(*by, *doc, size.alias("_size"), F.transform(
        places, lambda i: F.struct(i.alias("i"), *[F.get(F.col(c), i).alias(c) for c in names])).alias("_e"))
    # an outer join leaves the documents' rows as the inner runs read them, so
    # that both read one shuffle; a document without a place has no ends
    rows = ends.join(offsets, [*by, *doc], "left").select(
        *by, "_off", (F.col("_off") + F.col("_size")).alias("_end"),
        F.explode(F.when(F.col("_off").isNotNull(), F.col("_e"))).alias("_e")) \
        .select(*by, (F.col("_off") + F.col("_e.i")).alias("p"), "_end", *[F.col(f"_e.{c}") for c in names])
    b = F.floor(F.col("p") / bucket).cast("bigint")
    own = rows.withColumn("_b", b).withColumn("_own", F.lit(True))
    # the first positions of a window also end the one before
    spill = rows.where((F.col("p") % bucket < k) & (F.col("p") >= bucket)) \
        .withColumn("_b", b - 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(*by, "_b").orderBy("p")

    def following(c: str, i: int) -> Column:
        # the next token kept may stand further on in the corpus
        return F.when(F.lead("p", i).over(w) == F.col("p") + i, F.lead(c, i).over(w))

    out = own.unionByName(spill).select(
        *by, "_own", (F.col("_end") - F.col("p") + 1).alias("least"),
        *[(following(c, i) if i else F.col(c)).alias(f"{c}_{i}") for c in names for i in range(n)])
    return out.where(F.col("_own") & (F.col("least") <= n)).drop("_own")


def token_offsets(S: DataFrame, tokens: Column, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(offsets, totals)``: the tokens before each document of its group
    (``_off``), and the number of tokens of each group."""
    doc = document_key(S, by)
    sizes = S.groupBy(*by, *doc).agg(F.sum(F.coalesce(F.size(tokens), F.lit(0))).alias("_n"))
    return prefix_sum(sizes, "_n", doc, by, out_col="_off")


def token_runs(S: DataFrame, arrays: dict[str, Column], n: int, by: Sequence[str], bucket: int = BUCKET,
               placed: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(runs, totals)`` of the concatenated corpus of each group.

    A row of ``runs`` is a start position: columns ``{name}_0`` to
    ``{name}_{n-1}`` for each array, and ``least``.  The run of ``m`` items
    from there counts in this row if ``m >= least`` and ``{name}_{m-1}`` is
    not null; over all rows each run of the corpus counts exactly once.
    ``totals`` has the number of tokens of each group.  ``placed`` reuses a
    :func:`token_offsets` result of the same ``S``."""
    assert bucket >= n
    by, names = list(by), list(arrays)
    doc = document_key(S, by)
    offsets, totals = placed if placed is not None else token_offsets(S, arrays[names[0]], by)
    docs = document_arrays(S, arrays, by, doc)
    runs = inner_runs(docs, names, by, n)
    if n > 1:
        runs = runs.unionByName(_crossing(docs, offsets.select(*by, *doc, "_off"), names, by, doc, n, bucket))
    return runs, totals


def token_rows(S: DataFrame, tokens: Callable[[str], Column], text_col: str, n: int, by: Sequence[str],
               bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """``(rows, totals)``: the runs of :func:`token_runs` as rows of tokens
    ``_t``, whose first ``_starts`` tokens begin a run of the ``n`` that follow
    in the row or of as many as there are.  Sentences move as texts and are
    made tokens where they meet."""
    assert bucket >= n
    by = list(by)
    doc = document_key(S, by)
    offsets, totals = token_offsets(S, tokens(text_col), by)
    texts = S.select(*by, *doc, F.struct("pos", F.col(text_col).alias("text")).alias("_s")) \
        .groupBy(*by, *doc).agg(F.collect_list("_s").alias("_s"))
    sentences = F.array_sort(F.transform("_s", lambda s: F.struct(s["pos"].alias("pos"), tokens(s["text"]).alias("t"))))
    # exploded from an array of one, so that a document's tokens are formed once
    docs = texts.select(*by, *doc, F.explode(F.array(F.flatten(F.transform(sentences, lambda s: s["t"])))).alias("token"))
    rows = docs.select(*by, F.size("token").alias("_starts"), F.col("token").alias("_t")).where(F.col("_starts") > 0)
    if n > 1:
        cross = _crossing(docs, offsets.select(*by, *doc, "_off"), ["token"], by, doc, n, bucket)
        rows = rows.unionByName(cross.select(*by, F.lit(1).alias("_starts"), F.filter(
            F.array(*[f"token_{i}" for i in range(n)]), lambda t: t.isNotNull()).alias("_t")))
    return rows, totals


def run_rows(S: DataFrame, arrays: dict[str, Column], n: int, by: Sequence[str], bucket: int = BUCKET,
             placed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The runs of ``n`` items of :func:`token_runs` as rows of arrays: each
    such run of the corpus is once inside a row."""
    assert bucket >= n
    by, names = list(by), list(arrays)
    doc = document_key(S, by)
    docs = document_arrays(S, arrays, by, doc)
    rows = docs.select(*by, *names)
    if n > 1:
        offsets, _ = placed if placed is not None else token_offsets(S, arrays[names[0]], by)
        cross = _crossing(docs, offsets.select(*by, *doc, "_off"), names, by, doc, n, bucket)
        rows = rows.unionByName(cross.where(F.col(f"{names[0]}_{n - 1}").isNotNull()).select(*by, *[
            F.array(*[f"{k}_{i}" for i in range(n)]).alias(k) for k in names]))
    return rows


def gram(name: str, m: int) -> Column:
    """The run of ``m`` tokens of a row of :func:`token_runs`, or null."""
    words = F.concat_ws(" ", *[F.col(f"{name}_{i}") for i in range(m)])
    return F.when((F.col("least") <= m) & F.col(f"{name}_{m - 1}").isNotNull(), words)
