"""Hard-negative mining with Kronecker-packed inner products.

Vectors are quantised to integers, so that a score is an exact integer inner
product.  A bias makes every component non-negative; the components of
several candidates then stand in separated fields of one wide integer, which
is multiplied once by an anchor's component.  After the sum over components
each field holds one candidate's biased product, and the bias terms are taken
off again.  Fields are as wide as the largest possible sum, a figure that one
aggregate over the table gives.  While a field fits the 53 exact bits of a
double, the wide integers are doubles and the products one matrix
multiplication; wider fields use Python's unbounded integers.

The anchors are a stated query set.  They go to the executors in blocks of at
most ``block_bytes``; each block meets all rows twice, first for its
positives, then for the negatives inside the windows that the positives'
scores set.  Each task keeps the best few rows of each anchor and Spark merges
those, in two levels, so that nothing gathers by anchor, label or id.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component (once scaled, as a double) take no part; an empty vector
has score 0 with every row, and missing components of a shorter vector count
as 0; a score beyond 64 bits counts as the nearest 64-bit integer; ties go by
smaller id; repeated rows are rows of their own, as candidates and as anchors;
an anchor without positives, or a positive without rows in its window, gives
no rows; an empty table gives none.  Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import ship_by_value, small_batches, table, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of its positive's
SCALE = 256
BLOCK_BYTES = 8 << 20
# Candidates and anchors multiplied at once, candidates packed in a Python
# integer, and products a task should at least have to do.
ROWS, ANCHORS, WIDE = 4096, 256, 64
TASK_PRODUCTS = 1 << 28
SLOTS = 32
LONG = np.iinfo(np.int64)


class Packing:
    """Widths and bias for components within ``[least, most]`` (quantised)
    and vectors of up to ``dim`` components."""

    def __init__(self, dim: int, least: float, most: float):
        self.dim = dim
        self.bias = max(0, -int(least))
        self.span = int(max(most, 0)) + self.bias
        self.bits = max(1, (dim * self.span * self.span).bit_length())
        self.narrow = self.bits <= 53
        self.fields = 53 // self.bits if self.narrow else WIDE
        self.type = np.float64 if self.narrow else object

    def biased(self, vectors: np.ndarray) -> np.ndarray:
        """Components as non-negative integers of the packing's type."""
        if self.narrow:
            return vectors + float(self.bias)
        return np.frompyfunc(lambda x: int(x) + self.bias, 1, 1)(vectors).astype(object)

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products (rows x anchors, int64) of quantised rows."""
        n, f = len(rows), self.fields
        a, c = self.biased(anchors), self.biased(rows)
        pad = np.zeros((-n % f, self.dim), self.type)
        parts = np.concatenate([c, pad]).reshape(-1, f, self.dim)
        wide = np.zeros((len(parts), self.dim), self.type)
        for k in range(f):
            wide = wide + parts[:, k] * (1 << k * self.bits)
        sums = wide.dot(a.T)  # one multiplication per anchor component
        if self.narrow:
            sums = sums.astype(np.int64)
            c, a = c.astype(np.int64), a.astype(np.int64)
        mask = (1 << self.bits) - 1
        fields = np.stack([(sums >> k * self.bits) & mask for k in range(f)], 1)
        out = fields.reshape(-1, len(a))[:n]
        b = self.bias
        out = out - b * c.sum(1)[:, None] - b * a.sum(1)[None, :] + self.dim * b * b
        if self.narrow:
            return out
        return np.frompyfunc(lambda x: min(max(x, LONG.min), LONG.max), 1, 1)(out).astype(np.int64)


def matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Quantised vectors of a list column, short ones filled up with 0."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(flat * scale)
    return out


def best(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: higher scores first, then smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    # ~x reverses the order of int64 and, unlike -x, never overflows
    return some[np.lexsort((ident[some], ~score[some]))[:k]]


class Anchors:
    """One block of anchors."""

    def __init__(self, batch: pa.Table, packing: Packing, scale: float):
        batch = batch.combine_chunks()
        self.number = np.arange(batch.num_rows)
        self.ident = np.asarray(batch["ident"], np.int64)
        self.label = np.asarray(batch["label"], np.int64)
        self.copies = np.asarray(batch["copies"], np.int64)
        self.vectors = matrix(batch["vector"].combine_chunks(), packing.dim, scale)


def tiles(batches: Iterator[pa.RecordBatch], anchors: Anchors, packing: Packing, scale: float):
    """``(ids, labels, anchor places, scores)`` of rows met with anchors."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ident = np.asarray(part.column("ident"), np.int64)
            label = np.asarray(part.column("label"), np.int64)
            rows = matrix(part.column("vector"), packing.dim, scale)
            for a in range(0, len(anchors.ident), ANCHORS):
                yield ident, label, a, packing.scores(rows, anchors.vectors[a:a + ANCHORS])


class Best:
    """The best ``k`` rows so far of each of ``n`` keys."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * n
        self.ident = [np.empty(0, np.int64)] * n

    def add(self, key: int, score: np.ndarray, ident: np.ndarray) -> None:
        score = np.concatenate([self.score[key], score])
        ident = np.concatenate([self.ident[key], ident])
        top = best(score, ident, self.k)
        self.score[key], self.ident[key] = score[top], ident[top]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.score]
        return pa.RecordBatch.from_pydict({
            "key": pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()),
            "score": pa.array(np.concatenate([*self.score, np.empty(0, np.int64)]), pa.int64()),
            "ident": pa.array(np.concatenate([*self.ident, np.empty(0, np.int64)]), pa.int64())})


FOUND = "key bigint, score bigint, ident bigint"


def nearest_same(anchors: Anchors, packing: Packing, scale: float, k: int):
    """The ``mapInArrow`` function for the best ``k`` rows of an anchor's
    label, the anchor itself among them (key: the anchor's number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(anchors.ident), k)
        for ident, label, a, scores in tiles(batches, anchors, packing, scale):
            for j in range(scores.shape[1]):
                same = np.flatnonzero(label == anchors.label[a + j])
                if len(same):
                    found.add(a + j, scores[same, j], ident[same])
        yield found.batch()

    return run


def inside_windows(anchors: Anchors, packing: Packing, scale: float, k: int,
                   whose: np.ndarray, least: np.ndarray, most: np.ndarray):
    """The ``mapInArrow`` function for the best ``k`` rows of other labels
    with scores inside each window (key: the window's number); ``whose``
    gives the windows' anchors in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(whose), k)
        upto = np.searchsorted(whose, np.arange(len(anchors.ident) + 1))
        for ident, label, a, scores in tiles(batches, anchors, packing, scale):
            for j in range(scores.shape[1]):
                windows = np.arange(upto[a + j], upto[a + j + 1])
                if not len(windows):
                    continue
                score = scores[:, j]
                use = np.flatnonzero((score >= least[windows].min()) & (score <= most[windows].max())
                                     & (label != anchors.label[a + j]))
                s, names = score[use], ident[use]
                for w in windows:
                    hit = (s >= least[w]) & (s <= most[w])
                    if hit.any():
                        found.add(w, s[hit], names[hit])
        yield found.batch()

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each key, numbered from 1 as ``place``: first
    within a slot of the key, then over its slots."""
    order = (F.col("score").desc(), F.col("ident"))
    slots = found.withColumn("slot", F.spark_partition_id() % SLOTS)
    some = slots.withColumn("place", F.row_number().over(
        Window.partitionBy("key", "slot").orderBy(*order))).where(F.col("place") <= k)
    return some.withColumn("place", F.row_number().over(
        Window.partitionBy("key").orderBy(*order))).where(F.col("place") <= k).drop("slot")


def usable(df: DataFrame, ident: str, vector: str, label: Column, anchor: Column,
           scale: float) -> DataFrame:
    """Rows that take part, as ``ident, label, vector, anchor``."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x * float(scale)) < float("inf"), F.lit(False)))
    return df.select(F.col(ident).cast("bigint").alias("ident"), label.cast("bigint").alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"),
                     F.coalesce(anchor, F.lit(False)).alias("anchor")) \
        .where(F.col("ident").isNotNull() & F.col("label").isNotNull()
               & F.col("vector").isNotNull() & finite)


def positives_of(anchors: Anchors, top: np.ndarray, own: np.ndarray, k: int):
    """``(anchor numbers, ids, scores)`` of the first ``k`` rows of each
    anchor besides itself; ``top`` has (anchor, score, id) in order.  A row
    that equals the anchor in id and score stands for it, as the results
    would be the same whichever of them is left out."""
    out = []
    for a, rows in zip(anchors.number, np.split(top, np.searchsorted(top[:, 0], anchors.number[1:]))):
        self_at = np.flatnonzero((rows[:, 2] == anchors.ident[a]) & (rows[:, 1] == own[a]))[:1]
        out.append(np.delete(rows, self_at, 0)[:k])
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest integer ``x`` with ``low * score <= 100 * x <=
    high * score``."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(df: DataFrame, *, ident: str = "vec_id", vector: str = "embedding",
                   label: Column | None = None, anchor: Column | None = None,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, scale: float = SCALE,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per anchor, positive and rank: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.

    ``label`` is the class of a row (column ``label`` by default), ``anchor``
    says which rows are anchors (ids divisible by 100 by default)."""
    spark = df.sparkSession
    small_batches(spark)
    label = F.col("label") if label is None else label
    anchor = F.col(ident) % 100 == 0 if anchor is None else anchor
    rows = usable(df, ident, vector, label, anchor, scale)
    total = rows.select(F.size("vector").alias("d"), F.array_min("vector").alias("lo"),
                        F.array_max("vector").alias("hi"), "anchor") \
        .agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.min("lo").alias("lo"),
             F.max("hi").alias("hi"), F.count(F.when(F.col("anchor"), 1)).alias("a")).first()
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")
    if not total.a:
        return spark.createDataFrame([], schema)
    packing = Packing(max(1, total.d), np.floor((total.lo or 0.0) * scale),
                      np.floor((total.hi or 0.0) * scale))
    # the anchors, equal rows as one with their number, dealt over blocks
    # that are collected one at a time
    size = total.a * (8 * packing.dim + 64 * positives)
    blocks = 1 + 2 * size // block_bytes if size > block_bytes else 1
    ones = rows.where("anchor").groupBy("ident", "label", "vector").agg(
        F.count(F.lit(1)).alias("copies"))
    if blocks > 1:
        ones = written(ones, "anchors")
    tasks = max(1, min(rows.rdd.getNumPartitions(),
                       -(-total.n * -(-total.a // blocks) * packing.dim // TASK_PRODUCTS)))
    others = rows.drop("anchor").coalesce(tasks)
    results = None
    for b in range(blocks):
        mine = ones if blocks == 1 else ones.where(
            F.pmod(F.xxhash64("ident", "vector"), F.lit(blocks)) == b)
        block = Anchors(mine.toArrow(), packing, scale)
        if len(block.ident):
            part = mined(others, block, packing, scale, positives, negatives, low, high)
            part = part if blocks == 1 else written(part, "negatives")
            results = part if results is None else results.unionByName(part)
    return results


def mined(rows: DataFrame, block: Anchors, packing: Packing, scale: float, positives: int,
          negatives: int, low: int, high: int) -> DataFrame:
    """The rows of :func:`hard_negatives` for one block of anchors."""
    spark = rows.sparkSession
    near = merged(rows.mapInArrow(nearest_same(block, packing, scale, positives + 1), FOUND),
                  positives + 1)
    near = near.orderBy("key", "place").toArrow()  # a few rows per anchor of the block
    top = np.stack([np.asarray(near[c], np.int64) for c in ("key", "score", "ident")], 1)
    own = np.array([packing.scores(v[None], v[None])[0, 0] for v in block.vectors], np.int64)
    found = positives_of(block, top, own, positives)
    bounds = np.array([window_of(int(s), low, high) for s in found[:, 1]], np.int64).reshape(-1, 2)
    hits = rows.mapInArrow(inside_windows(block, packing, scale, negatives, found[:, 0],
                                          bounds[:, 0], bounds[:, 1]), FOUND)
    windows = spark.createDataFrame(pa.table({
        "key": np.arange(len(found)), "anchor_id": block.ident[found[:, 0]],
        "positive_id": found[:, 2], "positive_score": found[:, 1],
        "copies": block.copies[found[:, 0]]}))
    # a block's windows are bounded: ``positives`` an anchor, counted in its bytes
    return merged(hits, negatives).join(F.broadcast(windows), "key").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"),
        F.col("ident").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
        F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, label=label)


OP11_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q
           from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, a.l al, e.l, e.vec_id other,
             coalesce(list_sum(list_transform(list_zip(a.q, e.q), lambda z: z[1] * z[2])), 0)::bigint score
      from e a, e where a.vec_id % 100 = 0 and a.vec_id <> e.vec_id),
p as (select anchor_id, al, other positive_id, score positive_score from s where l = al
      qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id,
       row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int rank,
       other negative_id, positive_score, score negative_score
from p join s on s.anchor_id = p.anchor_id and s.l <> p.al
  and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

ship_by_value(__name__)
