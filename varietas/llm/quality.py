"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < ... < G.  One weight vector over hashed text
features, shared by all grades, gives a score ``s``; ordered thresholds give
``P(grade <= g) = sigmoid(threshold_g - s)``.  From these follow the expected
grade and the tail probability ``P(grade >= g)`` that selects documents.

Features of a text, hashed to ``2^BITS`` weights: its words, its runs of ASCII
punctuation, and words that repeat the word before.  A feature's value is the
square root of its share of the text, so every text has length one and a rare
but telling word still counts.

The fit takes a documented bounded sample: the ``sample`` labelled rows with
the smallest key hash, with their whole texts (default ``SAMPLE``).  Scoring is
one pass over all rows without a shuffle.

Defined results: a null or blank text has no features and the score 0; a text
of any length is read whole; repeated rows have a row each; rated rows whose
document is absent, or whose rating is null, are not used; without any rated
row the thresholds are those of equally likely grades; an empty table gives
no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import (Words, chunks, mix, ship_by_value, small_batches, starts_of,
                                 table, unused)
from varietas.llm.decontaminate import item_words

BITS, SAMPLE, GRADES = 18, 6000, 3
STEPS, RATE, DECAY = 200, 1.0, 1e-5


def marks() -> Words:
    """Runs of ASCII punctuation."""
    inside = np.zeros(256, bool)
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        inside[a:b] = True
    return Words(inside)


class Features:
    """Sparse features of texts: ``(row bounds, weight numbers, values)``."""

    def __init__(self, bits: int = BITS):
        self.bits, self.words, self.marks = bits, item_words(), marks()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        parts, rows = [], []
        for salt, kind in ((1, self.words), (2, self.marks)):
            h, counts = kind.hashes(texts)
            row = np.repeat(np.arange(len(texts)), counts)
            parts.append(mix(h + np.uint64(salt)) >> shift)
            rows.append(row)
            if salt == 1:
                again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
                parts.append(np.full(len(again), 3, np.uint64))
                rows.append(row[1:][again])
        keys = (np.concatenate(rows).astype(np.uint64) << np.uint64(self.bits)) | np.concatenate(parts)
        keys, counts = np.unique(keys, return_counts=True)
        row = (keys >> np.uint64(self.bits)).astype(np.int64)
        total = np.bincount(row, weights=counts, minlength=len(texts))
        values = np.sqrt(counts / total[row]) if len(row) else counts.astype(float)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        return bounds, (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64), values


def row_sums(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights and ordered thresholds; ``grades`` counts the grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, bounds, numbers, values) -> np.ndarray:
        return row_sums(bounds, self.weights[numbers] * values)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= g)`` for g = 1.. as columns."""
        return 1.0 - sigmoid(self.thresholds[None, :] - scores[:, None])

    @classmethod
    def fit(cls, bounds, numbers, values, grade: np.ndarray, grades: int = GRADES,
            bits: int = BITS, steps: int = STEPS) -> "Ordinal":
        """Maximum likelihood with a small ridge, by full-batch Adam.  The
        gaps between thresholds are exponentials, so they stay ordered."""
        below = [np.clip((np.sum(grade <= g) + 1.0) / (len(grade) + 1.0 * grades), 0.01, 0.99)
                 if len(grade) else (g + 1) / grades for g in range(grades - 1)]
        first = np.log(np.array(below) / (1 - np.array(below)))
        shape = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        w = np.zeros(1 << bits)
        if not len(grade):
            return cls(w, first)
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(shape), np.zeros_like(shape)]
        lengths, n = np.diff(bounds), len(grade)
        for t in range(1, steps + 1):
            cuts = np.concatenate([[-np.inf], shape[0] + np.concatenate([[0], np.cumsum(np.exp(shape[1:]))]),
                                   [np.inf]])
            s = row_sums(bounds, w[numbers] * values)
            up, down = sigmoid(cuts[grade + 1] - s), sigmoid(cuts[grade] - s)
            p = np.maximum(up - down, 1e-9)
            d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
            g_s = (d_up - d_down) / n
            g_w = np.bincount(numbers, np.repeat(g_s, lengths) * values, minlength=len(w)) + DECAY * w
            g_cut = (np.bincount(grade, -d_up, minlength=grades)[:-1]
                     + np.bincount(grade, d_down, minlength=grades)[1:]) / n
            g_shape = np.cumsum(g_cut[::-1])[::-1]
            g_shape[1:] *= np.exp(shape[1:])
            rate = RATE * min(1.0, 2.0 * (1 - t / (steps + 1)))
            for x, g, m, v, r in ((w, g_w, state[0], state[1], rate),
                                  (shape, g_shape, state[2], state[3], rate / 10)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= r * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-7)
        return cls(w, shape[0] + np.concatenate([[0], np.cumsum(np.exp(shape[1:]))]))


def featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch, texts in chunks(batches, "text"):
            bounds, numbers, values = features.of(texts)
            yield pa.RecordBatch.from_pydict({
                "grade": batch.column("grade"),
                "numbers": pa.array([numbers[a:b].astype("<i4").tobytes()
                                     for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                "value": pa.array([values[a:b].astype("<f4").tobytes()
                                   for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})

    return run


def fit(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text",
        grade: str = "grade", grades: int = GRADES, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` rated rows; the driver holds their sparse
    features."""
    small_batches(docs.sparkSession)
    chosen = ratings.select(F.col(key).cast("bigint").alias("rated"),
                            F.col(grade).cast("int").alias("grade")) \
        .where("rated is not null and grade is not null") \
        .orderBy(F.xxhash64("rated"), "rated", "grade").limit(sample)
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("binary").alias("text")) \
        .join(F.broadcast(chosen), F.col("doc") == F.col("rated")) \
        .select("grade", "text") \
        .mapInArrow(featured(BITS), "grade int, numbers binary, value binary").collect()
    lengths = np.array([len(r.numbers) // 4 for r in rows], np.int64)
    numbers = np.frombuffer(b"".join(bytes(r.numbers) for r in rows), "<i4").astype(np.int64)
    values = np.frombuffer(b"".join(bytes(r.value) for r in rows), "<f4").astype(float)
    return Ordinal.fit(starts_of(lengths), numbers, values,
                       np.array([r.grade for r in rows], np.int64), grades)


def scored(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(int(len(model.weights)).bit_length() - 1)
        for batch, texts in chunks(batches, "text"):
            tails = model.tails(model.scores(*features.of(texts)))
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"),
                "expected_grade": pa.array(tails.sum(axis=1), pa.float64()),
                "p_tail": pa.array(tails[:, -1], pa.float64())})

    return run


def score(docs: DataFrame, model: Ordinal, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``expected_grade`` and ``p_tail``, the probability
    of the best grade."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(scored(model), "key bigint, expected_grade double, p_tail double") \
        .withColumnRenamed("key", key)


def filtered(model: Ordinal, least: float, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(int(len(model.weights)).bit_length() - 1)
        for batch, texts in chunks(batches, body):
            tails = model.tails(model.scores(*features.of(texts)))
            rows = batch.select([c for c in batch.schema.names if c != body])
            yield rows.filter(pa.array(tails[:, -1] >= least))

    return run


def keep(docs: DataFrame, model: Ordinal, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The whole rows whose best grade has at least probability ``least``."""
    small_batches(docs.sparkSession)
    body = unused(docs, "_body")
    return docs.withColumn(body, F.col(text).cast("binary")) \
        .mapInArrow(filtered(model, least, body), docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))


SELECT = 0.5  # a document is kept when the best grade is at least this likely


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    return score(docs, model).withColumn("keep", F.col("p_tail") >= SELECT)


ship_by_value(__name__)
