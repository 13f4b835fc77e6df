"""Corpus-level diversity: n-gram diversity, compression ratio,
homogenisation.

All three look at the corpus of a group as one long text (sentences joined
by a space, in ``(doc_id, pos)`` order).  None of them builds that text in
one place: token and byte positions come from a distributed prefix sum,
and every window / Python call sees one bounded bucket of the corpus.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varietas.functions.text import lower_tokens, tokenize
from varietas.operators.blobs import keyed_slices, packed, smallest, unpacked
from varietas.operators.joins import broadcast_if_small
from varietas.operators.ngrams import BUCKET, token_rows
from varietas.operators.runs import BUCKET_RUNS, count_runs, deal_runs
from varietas.operators.ordering import document_key, prefix_sum, with_group
from varietas.operators.pairwise import pair_score
from varietas.operators.sampling import index_corpus, sample_pairs, trial_means, trial_summary
from varietas.session import checkpoint

TEXT = "nl_instructions"
DEFAULT_BY = ("ds_name",)
# Raw bytes per compression block.
COMPRESSION_BLOCK = 1 << 20
# Bytes that deflate looks back.
WINDOW = 1 << 15


def _by(by) -> list[str]:
    return list(DEFAULT_BY if by is None else by)


def ngram_diversity(S: DataFrame, n: int = 4, by: Sequence[str] | None = None,
                    text_col: str = TEXT, bucket: int = BUCKET) -> DataFrame:
    """D3: sum over k=1..n of distinct k-grams / all k-grams of the group's
    concatenated corpus (whitespace tokens, case-sensitive)."""
    S, keys = with_group(S, _by(by))
    rows, totals = token_rows(S, tokenize, text_col, n, keys, bucket)
    # equal runs meet in one bucket of a group; a task deals out its distinct
    # runs once, many as one value
    dealt = F.ceil(F.col("total") / BUCKET_RUNS).alias("_buckets")
    rows = rows.join(broadcast_if_small(totals.select(*keys, dealt)), keys, "left") \
        .select(*keys, F.coalesce("_buckets", F.lit(1)).alias("_buckets"), "_starts", "_t")
    named = [f for f in rows.schema.fields if f.name in keys]
    n_parts = int(S.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(deal_runs(n, len(keys)), T.StructType(
        [*named, *[T.StructField(c, T.IntegerType()) for c in ("_m", "_b")], T.StructField("_v", T.BinaryType())]))
    found = dealt.repartition(n_parts, *keys, "_m", "_b").sortWithinPartitions(*keys, "_m", "_b") \
        .mapInArrow(count_runs(n, len(keys)), T.StructType(
            [*named, T.StructField("n", T.IntegerType()), T.StructField("_d", T.LongType())]))
    distinct = found.groupBy(*keys, "n").agg(F.sum("_d").alias("n_distinct")).where(F.col("n_distinct") > 0)
    per_n = distinct.join(totals, on=keys) \
        .withColumn("n_total", F.col("total") - F.col("n") + 1) \
        .filter(F.col("n_total") > 0)
    return per_n.groupBy(*keys).agg(
        F.sum(F.col("n_distinct") / F.col("n_total")).alias("ngram_diversity"),
        F.first("total").alias("n_tokens")).drop("_all")


# --------------------------------------------------------------- compression
def gzip_size(data: bytes, name: str = "tmp.txt") -> int:
    """Size of a gzip file (level 9) holding ``data`` under ``name``."""
    buf = io.BytesIO()
    with gzip.GzipFile(filename=name, mode="wb", fileobj=buf, compresslevel=9, mtime=0) as f:
        f.write(data)
    return len(buf.getvalue())


# Header and trailer of the file of ``gzip_size``; an empty text deflates to 2.
GZIP_FRAME = gzip_size(b"") - 2


def _compress_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deflated size of a block as part of one stream: with the text before
    it as the window, and ended as a middle (``sync``) or the last part."""
    pdf = pdf.sort_values("_off")
    own = pdf[pdf["_own"]]
    out = own.iloc[:1][[c for c in pdf.columns if c not in ("_off", "_text", "_own")]].copy()
    if not len(own):  # no row starts in this block
        return out.assign(raw_bytes=0, sync_bytes=0, last_bytes=0)
    raw = b" ".join(own["_text"].tolist())
    before = b" ".join(pdf.loc[~pdf["_own"], "_text"].tolist())[-WINDOW:]
    coder = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL,
                             zlib.Z_DEFAULT_STRATEGY, before)
    part = raw if own["_off"].iloc[0] == 0 else b" " + raw
    size = len(coder.compress(part))
    middle = coder.copy()
    out["raw_bytes"] = len(raw)
    out["sync_bytes"] = size + len(middle.flush(zlib.Z_SYNC_FLUSH))
    out["last_bytes"] = size + len(coder.flush(zlib.Z_FINISH))
    return out


def placed_texts(S: DataFrame, keys: Sequence[str], text_col: str,
                 block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Each text with its byte offset ``_off`` in the group's joined corpus
    and its block ``_blk``, and the totals per group.

    The order comes from a prefix sum over one small row per document; the
    texts meet their document's offset in a join on the document, whose
    partitioning the running sum inside the document uses again."""
    doc = document_key(S, keys)
    rows = S.where(F.col(text_col).isNotNull()).select(
        *keys, *doc, "pos", F.col(text_col).cast("binary").alias("_text"))
    size = F.octet_length("_text") + 1
    offsets, totals = prefix_sum(rows.groupBy(*keys, *doc).agg(F.sum(size).alias("_n")), "_n", doc, keys,
                                 out_col="_doc")
    w = Window.partitionBy(*keys, *doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets.select(*keys, *doc, "_doc"), [*keys, *doc]).select(
        *keys, "_text", (F.col("_doc") + F.coalesce(F.sum(size).over(w), F.lit(0))).alias("_off"))
    return placed.withColumn("_blk", F.floor(F.col("_off") / block_bytes).cast("bigint")), totals


def compression_blocks(S: DataFrame, by: Sequence[str] | None = None, text_col: str = TEXT,
                       block_bytes: int = COMPRESSION_BLOCK) -> DataFrame:
    """The blocks that D1 deflates: ``block, n_texts, n_bytes, md5`` of each
    block's texts joined by a space."""
    S, keys = with_group(S, _by(by))
    placed, _ = placed_texts(S, keys, text_col, block_bytes)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_off", "_text"))),
                        lambda x: x["_text"].cast("string"))
    joined = F.array_join("_texts", " ")
    return placed.groupBy(*keys, F.col("_blk").alias("block")).agg(texts.alias("_texts")).select(
        *keys, "block", F.size("_texts").cast("bigint").alias("n_texts"),
        F.octet_length(joined).cast("bigint").alias("n_bytes"), F.md5(joined.cast("binary")).alias("md5")).drop("_all")


def compression_ratio(S: DataFrame, by: Sequence[str] | None = None, text_col: str = TEXT,
                      block_bytes: int = COMPRESSION_BLOCK) -> DataFrame:
    """Bytes of the space-joined corpus / bytes of its gzip.

    The corpus is cut into blocks of about ``block_bytes`` (byte offsets
    from a prefix sum over documents) and each block is deflated in its own
    Arrow batch (``applyInPandas`` on ``(group, block)``: bounded input per
    call), primed with the ``WINDOW`` bytes before it.  The parts are one
    gzip stream with one header; a block adds the few bytes that end it.
    """
    S, keys = with_group(S, _by(by))
    offs, totals = placed_texts(S, keys, text_col, block_bytes)
    own = offs.select(*keys, "_blk", "_off", "_text", F.lit(True).alias("_own"))
    # the next row starts at ``end``; blocks that start less than a window
    # later see the row's end
    end = F.col("_off") + F.octet_length("_text") + 1
    after = F.greatest(F.col("_blk") + 1, (end / block_bytes).cast("bigint"))
    upto = ((end + WINDOW - 1) / block_bytes).cast("bigint")
    window = offs.where(upto >= after).select(
        *keys, F.explode(F.sequence(after, upto)).alias("_blk"), "_off",
        F.expr(f"substring(_text, -{WINDOW}, {WINDOW})").alias("_text"), F.lit(False).alias("_own"))
    blocks = own.unionByName(window)
    sizes = ("raw_bytes", "sync_bytes", "last_bytes")
    schema = T.StructType([*[f for f in blocks.schema.fields if f.name in keys],
                           T.StructField("_blk", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in sizes]])
    per_block = blocks.groupBy(*keys, "_blk").applyInPandas(_compress_block, schema)
    out = per_block.groupBy(*keys).agg(
        (F.sum("sync_bytes") + F.max_by(F.col("last_bytes") - F.col("sync_bytes"), "_blk")
         + GZIP_FRAME).alias("gz_bytes"),
        F.count(F.lit(1)).alias("n_blocks"))
    # raw size of the whole joined text: sum of (bytes + 1) minus the last separator
    out = out.join(totals, on=keys).withColumn("raw_bytes", F.col("total") - 1)
    return out.select(*keys, "raw_bytes", "gz_bytes", "n_blocks",
                      (F.col("raw_bytes") / F.col("gz_bytes")).alias("compression_ratio")).drop("_all")


# ------------------------------------------------------------ homogenization
def homogenization(S: DataFrame, measure: str = "rouge_l", n_samples: int = 1000,
                   trials: int = 3, seed: int = 0, by: Sequence[str] | None = None,
                   index=None) -> DataFrame:
    """Mean similarity over ordered pairs of *different* rows.

    Estimated from ``trials x n_samples`` uniform draws of pairs i != j
    (seeded, reproducible); ``avg`` is the estimate and ``std`` the spread
    of the trial means.  The exact all-pairs mean of these measures is
    quadratic in the corpus, so it is not enumerated;
    ``homogenization_cosine`` is exact.
    """
    keys = _by(by)
    pairs = sample_pairs(S, n_samples, trials, seed, keys, distinct=True, index=index)
    scored = pairs.withColumn("score", pair_score(measure, f"q_{TEXT}", f"r_{TEXT}"))
    return trial_summary(trial_means(scored, "score", keys), keys) \
        .withColumnRenamed("avg", "homogenization")


def homogenization_estimate(S: DataFrame, measure: str = "rouge_l", n_samples: int = 1000,
                            trials: int = 3, seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """The estimate of :func:`homogenization` (same draws) with the number of
    rows, of pairs drawn and its standard error; null for fewer than 2 rows."""
    keys = _by(by)
    index = index_corpus(S, keys)
    pairs = sample_pairs(S, n_samples, trials, seed, keys, distinct=True, index=index)
    scored = pairs.select(*keys, pair_score(measure, f"q_{TEXT}", f"r_{TEXT}").alias("_score"),
                          F.lit(None).cast("bigint").alias("_n"))
    sizes = index[1].select(*keys, F.lit(None).cast("double").alias("_score"), F.col("N").alias("_n"))
    return scored.unionByName(sizes).groupBy(*keys).agg(
        F.max("_n").alias("n_rows"), F.count("_score").alias("n_pairs"),
        F.avg("_score").alias("estimate"),
        (F.stddev_samp("_score") / F.sqrt(F.count("_score"))).alias("std_error"))


# Collision hashes: two 31-bit numbers from a token's md5, combined by each
# hash's own coefficients modulo a prime.  Any two of the hashes are
# independent of each other over the choice of those numbers.
PRIME = (1 << 31) - 1
N_HASHES = 256
# Rows of a group that one task hashes: the more, the fewer distinct values are
# dealt again; few rows are spread over some SHARES tasks.
SHARE_ROWS = (1 << 17, 1 << 20)
SHARES = 32
# Rows after which a task folds the least values it has gathered, folds that
# are joined, and distinct values after which it passes on what it holds.
FOLDED_ROWS = 1 << 15
HELD_FOLDS = 6
HELD_VALUES = 1 << 25


def _two_numbers(text: str) -> tuple[int, int]:
    digest = hashlib.md5(text.encode()).hexdigest()
    return int(digest[:8], 16) % PRIME, int(digest[8:16], 16) % PRIME


def _least_hashes(batch: pa.Array, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """The least value of each hash (rows) in each list of tokens (columns;
    at least one token each)."""
    sizes = np.asarray(batch.value_lengths(), np.int64)
    words = batch.flatten().dictionary_encode()
    numbers = np.array([_two_numbers(w) for w in words.dictionary.to_pylist()], np.int64)
    codes, starts = np.asarray(words.indices), np.cumsum(sizes) - sizes
    out = np.empty((len(pairs), len(sizes)), np.int32)
    for j, (a, b) in enumerate(pairs):
        h = ((numbers[:, 0] * a % PRIME + numbers[:, 1] * b) % PRIME).astype(np.int32)
        out[j] = np.minimum.reduceat(h[codes], starts)
    return out


def _added_up(folds: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of several folds, with the sums of their counts."""
    values, counts = (np.concatenate(x) for x in zip(*folds))
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else order
    return values[first], np.add.reduceat(counts[order], first) if len(first) else counts


class _Counts:
    """How often each least value of each hash occurred: values are gathered
    as they come and folded into distinct values with counts now and then,
    so what is held grows with the words of a group, not with its rows."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.folds: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.n)]

    def add(self, least: np.ndarray) -> None:
        self.waiting.append(least)
        if sum(x.shape[1] for x in self.waiting) >= FOLDED_ROWS:
            self.fold()
            if len(self.folds[0]) >= HELD_FOLDS:
                self.join()

    def fold(self) -> None:
        if self.waiting:
            for folds, row in zip(self.folds, np.concatenate(self.waiting, axis=1)):
                folds.append(np.unique(row, return_counts=True))
            self.waiting = []

    def join(self) -> None:
        self.folds = [[_added_up(f)] if len(f) > 1 else f for f in self.folds]

    def held(self) -> int:
        """Distinct values held, of all hashes."""
        return sum(len(values) for folds in self.folds for values, _ in folds)

    def counted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct least values of each hash in order, and their counts."""
        self.fold()
        self.join()
        return [f[0] for f in self.folds if f]

    def collisions(self) -> list[float]:
        return [_collisions(c) for _, c in self.counted()]


def _collisions(counts: np.ndarray) -> float:
    """Ordered pairs of different rows with the same value."""
    c = counts.astype(np.int64)
    return float((c * (c - 1)).sum())


def _arrow_rows(schema: pa.Schema, n_keys: int, rows: Sequence[tuple], names: Sequence[str],
                kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
    """``rows`` as a batch: the first ``n_keys`` columns are those of ``schema``."""
    types = [*schema.types[:n_keys], *kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      [*schema.names[:n_keys], *names])


def _least_counts(n_hashes: int, n_keys: int):
    """The ``mapInArrow`` function that counts the least values of the rows of
    each group and share, which come together; a row for each hash, with its
    distinct values (as steps from one to the next) and their counts."""
    hashes = [_two_numbers(f"minhash {j}") for j in range(n_hashes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, mine, lists, schema = _Counts(n_hashes), None, [], None

        def hashed() -> None:
            if lists:
                found.add(_least_hashes(pa.concat_arrays(lists), hashes))
                lists.clear()

        def result() -> pa.RecordBatch:
            out = [(*mine[:-1], j, packed([np.diff(values, prepend=np.int32(0)).astype(np.uint32), smallest(c)]))
                   for j, (values, c) in enumerate(found.counted())]
            found.clear()
            return _arrow_rows(schema, n_keys, out, ["_j", "_v"], [pa.int32(), pa.binary()])

        for batch in batches:
            schema = batch.schema
            for key, rows in keyed_slices(batch, n_keys + 1):
                if key != mine and mine is not None:
                    hashed()
                    yield result()
                mine = key
                lists.append(rows.column("_t"))
                if sum(map(len, lists)) >= FOLDED_ROWS:
                    hashed()
                    if found.held() > HELD_VALUES:
                        yield result()
        if mine is not None:
            hashed()
            if found.waiting or found.held():
                yield result()

    return count


def _all_collisions(n_keys: int):
    """The ``mapInArrow`` function that adds up the counts of each group and
    hash, whose rows come together, to its collisions."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, mine, out, schema, most = [], None, [], None, 0
        for batch in batches:
            schema = batch.schema
            for key, rows in keyed_slices(batch, n_keys + 1):
                if key != mine:
                    if mine is not None:
                        out.append((*mine, _collisions(_added_up(folds)[1])))
                    folds, mine, most = [], key, 1 << 21
                for data in rows.column("_v").to_pylist():
                    steps, counts = unpacked(data)
                    folds.append((np.cumsum(steps, dtype=np.int32), counts.astype(np.int64)))
                    if sum(len(values) for values, _ in folds) > most:
                        folds = [_added_up(folds)]
                        most = max(most, 2 * len(folds[0][0]))
        if mine is not None:
            out.append((*mine, _collisions(_added_up(folds)[1])))
            yield _arrow_rows(schema, n_keys + 1, out, ["_s"], [pa.float64()])

    return add_up


def homogenization_minhash(S: DataFrame, by: Sequence[str] | None = None, text_col: str = TEXT,
                           n_hashes: int = N_HASHES) -> DataFrame:
    """D2 for Jaccard: mean over all ordered pairs of different rows, without
    a draw of pairs and without forming any.

    Two rows have the same least hash with a probability that is their
    Jaccard similarity.  So for each hash the share of ordered pairs that
    collide, ``sum of c (c - 1)`` over the counts ``c`` of the least values
    against ``N (N - 1)``, has the mean similarity as its expectation.
    ``homogenization`` is the average over ``n_hashes`` hashes and
    ``std_error`` its standard error.  A hash that happens to put a frequent
    token first counts many pairs at once, so the error falls slowly with the
    number of hashes (64 gave some 12 % of the mean on prose, 256 some 6 %);
    groups share the hashes, so their errors are not independent.  A row without tokens has similarity 0
    with every other; null for fewer than 2 rows."""
    S, keys = with_group(S, _by(by))
    rows = S.where(F.col(text_col).isNotNull())
    sizes = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
    # a group's rows are dealt once, as their texts, in shares that one task
    # hashes; what is dealt again is each hash's distinct least values
    n_parts = int(S.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(max((sizes.agg(F.sum("n_rows")).first()[0] or 0) // SHARES, SHARE_ROWS[0]), SHARE_ROWS[1])
    shares = broadcast_if_small(sizes.select(*keys, F.ceil(F.col("n_rows") / share).alias("_shares")))
    known = [c for c in ("ds_name", "doc_id", "pos", text_col) if c in rows.columns]
    dealt = rows.select(*keys, F.col(text_col).alias("_text"), F.xxhash64(*known).alias("_h")).join(shares, keys) \
        .select(*keys, F.pmod("_h", "_shares").alias("_part"), "_text") \
        .repartition(n_parts, *keys, "_part").sortWithinPartitions(*keys, "_part") \
        .select(*keys, "_part", F.array_distinct(lower_tokens("_text")).alias("_t")).where(F.size("_t") > 0)
    named = [f for f in dealt.schema.fields if f.name in keys]
    counts = dealt.mapInArrow(_least_counts(n_hashes, len(keys)), T.StructType(
        [*named, T.StructField("_j", T.IntegerType()), T.StructField("_v", T.BinaryType())]))
    collided = counts.repartition(n_parts, *keys, "_j").sortWithinPartitions(*keys, "_j") \
        .mapInArrow(_all_collisions(len(keys)), T.StructType(
            [*named, T.StructField("_j", T.IntegerType()), T.StructField("_s", T.DoubleType())]))
    # every hash with a row has a share; groups without tokens have none
    sums = collided.groupBy(*keys).agg(F.avg("_s").alias("_mean"),
                                     (F.stddev_samp("_s") / F.sqrt(F.lit(float(n_hashes)))).alias("_error"))
    n = F.col("n_rows").cast("double")

    def per_pair(c: str) -> Column:
        return F.when(n > 1, F.coalesce(F.col(c), F.lit(0.0)) / (n * (n - 1)))

    return sizes.join(sums, keys, "left").select(
        *keys, "n_rows", (F.col("n_rows") * (F.col("n_rows") - 1)).alias("n_pairs"),
        per_pair("_mean").alias("homogenization"), per_pair("_error").alias("std_error")).drop("_all")


def _bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, also where lambdas use it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def token_weights(tokens: Column) -> Column:
    """Distinct tokens with their weights in the row's unit count vector."""
    def runs(t):
        firsts = F.filter(F.sequence(F.lit(0), F.size(t) - 1),
                          lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return _bound(firsts, lambda at: F.transform(at, lambda a, k: F.struct(
            F.get(t, a).alias("token"),
            (F.coalesce(F.get(at, k + 1), F.size(t)) - a).cast("double").alias("n"))))

    def unit(counts):
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda z, c: z + c["n"] * c["n"]))
        return _bound(norm, lambda size: F.transform(
            counts, lambda c: F.struct(c["token"].alias("token"), (c["n"] / size).alias("w"))))

    return F.when(F.size(tokens) > 0, _bound(_bound(F.sort_array(tokens), runs), unit))


def homogenization_cosine(S: DataFrame, by: Sequence[str] | None = None,
                          text_col: str = TEXT) -> DataFrame:
    """D2, exact: mean cosine of the token count vectors over all ordered
    pairs of different rows, ``(|sum of unit vectors|^2 - M) / (N (N - 1))``
    with ``M`` of the ``N`` rows holding a token; null for fewer than 2 rows.
    A row without tokens has cosine 0 with every other."""
    keys = _by(by)
    rows = S.filter(F.col(text_col).isNotNull()).select(*keys, tokenize(text_col).alias("_toks"))
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.size("_toks") > 0, 1)).alias("_m")) \
        .withColumn("_q", F.lit(0.0))
    sums = rows.select(*keys, F.explode(token_weights(F.col("_toks"))).alias("_t")) \
        .groupBy(*keys, "_t.token").agg(F.sum("_t.w").alias("_s"))
    none = F.lit(0).cast("bigint")
    squares = sums.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q")) \
        .select(*keys, none.alias("_n"), none.alias("_m"), "_q")
    n = F.col("n_rows").cast("double")
    return sizes.unionByName(squares).groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum("_m").alias("_m"), F.sum("_q").alias("_q")) \
        .select(*keys, "n_rows", (F.col("n_rows") * (F.col("n_rows") - 1)).alias("n_pairs"),
                F.when(F.col("n_rows") > 1, (F.col("_q") - F.col("_m")) / (n * (n - 1)))
                .alias("homogenization"))
