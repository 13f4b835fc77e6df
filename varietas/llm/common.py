"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from varietas.session import ensure_checkpoint_dir

# Rows and bytes of one Arrow batch between the JVM and a Python worker, and
# the text bytes a task vectorises over at once.  They bound a task's memory
# whatever the lengths of the texts (one very long text is its own chunk).
ARROW_ROWS = 1000
ARROW_BYTES = "8m"
CHUNK_BYTES = 1 << 21


def ship_by_value(module: str) -> None:
    """Send a module's functions with the job instead of by name, so that
    executors need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: the
    lineage is cut, and a lost executor costs a re-read only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], column: str,
           most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes in the binary
    ``column`` (or one row), and that column's values; null is ``b""``."""
    for batch in batches:
        values = batch.column(column).to_pylist()
        first, size = 0, 0
        for i, v in enumerate(values):
            n = len(v) if v is not None else 0
            if i > first and size + n > most:
                yield batch.slice(first, i - first), [x or b"" for x in values[first:i]]
                first, size = i, 0
            size += n
        if first < len(values):
            yield batch.slice(first), [x or b"" for x in values[first:]]


class Words:
    """Word hashes of whole texts by array arithmetic: no word ever becomes a
    Python object.  ``inside`` says which byte values belong to words; A-Z
    count as a-z.  A word's 64-bit hash is a polynomial in its bytes, taken
    as a difference of running sums and finalised with the word's length."""

    SEGMENT = 1 << 20

    def __init__(self, inside: np.ndarray):
        draw = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
        lower = np.arange(256)
        lower[65:91] += 32
        self.inside, self.value = inside, draw[lower]
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.empty(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, self.SEGMENT)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse)]))

    def segment(self, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start places of the words of a segment that ends
        outside of words."""
        self.grow(len(data))
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.value[data] * self.powers[:len(data)])])
        raw = (sums[last] - sums[first]) * self.inverses[first]
        return mix(raw + (last - first).astype(np.uint64)), first

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes of all words in order, number of words of each text)``."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = self.inside[data]
        outside = np.flatnonzero(~inside)
        found, places, at = [], [], 0
        while at < len(data):
            k = np.searchsorted(outside, at + self.SEGMENT, "right") - 1
            if outside[k] < at:  # one word longer than a segment
                k += 1
            end = int(outside[k]) + 1
            h, first = self.segment(data[at:end], inside[at:end])
            found.append(h)
            places.append(first + at)
            at = end
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        places = np.concatenate(places) if places else np.empty(0, np.int64)
        upto = np.searchsorted(places, ends)
        return (np.concatenate(found) if found else np.empty(0, np.uint64),
                np.diff(upto, prepend=0))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive codes (ordered)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n]
    return mix(out)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Exclusive running sum with the total as the last entry."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


ship_by_value(__name__)
