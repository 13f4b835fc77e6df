"""Sum-of-squares packing of token sequences.

A document's ids fill whole windows of ``capacity`` by themselves; what
remains is placed online.  ``levels[h]`` counts the open windows filled to
``h``; a remainder goes to the level (an open window's, or 0 for a new one)
after which the sum of the squared counts is least.  This keeps the counts
even, so that most later remainders find a window they fill exactly.

After every ``group`` documents the windows still open are closed: the
emptiest are cut up to fill the fullest, and the last one's ids are cut into
sequences of power-of-two lengths, which need no padding.  A task holds the
remainders of one group at most, and packs its rows as they come; nothing is
shuffled.  Give it a scan or another deterministic plan: a task that runs
again must see its rows in the same order.

Defined results: a null or empty text is the end id alone; a text of any
length is cut into windows; repeated rows are packed each; a null key stays
null; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import chunks, ship_by_value, small_batches, table
from varietas.llm.tokens import encoder, tokenizer_path

CAPACITY, GROUP = 2048, 4096
PIECES = ("key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class SumOfSquares:
    """Open windows by fill level, and the pieces in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.full: list[list] = []

    def place(self, piece, size: int) -> None:
        """Put ``size`` (< capacity) at the level that leaves the least sum
        of squares; among equals at the fullest."""
        top = self.capacity - size
        after = 2 * self.levels[size:].copy() + 1
        after[top] = 0  # a window that becomes full is counted no more
        change = after - 2 * self.levels[:top + 1] + 1
        change[0] = after[0]
        usable = self.levels[:top + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        level = top - int(np.argmin(change[::-1]))
        window = self.open[level].pop() if level else []
        self.levels[level] -= level > 0
        window.append((piece, 0, size))
        if level + size == self.capacity:
            self.full.append(window)
        else:
            self.open[level + size].append(window)
            self.levels[level + size] += 1

    def close(self) -> Iterator[list]:
        """All windows; no open one is left."""
        yield from self.full
        left = [w for level in self.open[::-1] for w in level]  # fullest first
        at, spare = 0, []
        while at < len(left):
            window = left[at]
            gap = self.capacity - sum(n for _, _, n in window)
            while gap and (spare or at + 1 < len(left)):
                spare = spare or left.pop()
                piece, first, n = spare.pop()
                used = min(gap, n)
                window.append((piece, first, used))
                gap -= used
                if used < n:
                    spare.append((piece, first + used, n - used))
            at += 1
            if gap:
                yield from powers(window)
            else:
                yield window
        if spare:
            yield from powers(spare)
        self.__init__(self.capacity)


def powers(window: list) -> Iterator[list]:
    """A window cut into power-of-two lengths, the longest first."""
    left = sum(n for _, _, n in window)
    rest = window[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out = []
        while want:
            piece, first, n = rest.pop()
            used = min(want, n)
            out.append((piece, first, used))
            want -= used
            if used < n:
                rest.append((piece, first + used, n - used))
        yield out


def packer(path: str, last: int, capacity: int, group: int):
    """The ``mapInArrow`` function: rows of (key, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 40
        made = 0
        packing = SumOfSquares(capacity)
        waiting = 0
        names = [f.split()[0] for f in PIECES.split(", ")]

        def emit(windows) -> pa.RecordBatch:
            nonlocal made
            out = []
            for window in windows:
                offset = 0
                for (key, start, ids, total), first, n in window:
                    out.append((key, start + first, n, crc(ids[first:first + n]), total,
                                base + made, offset))
                    offset += n
                made += 1
            columns = zip(*out) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch, texts in chunks(batches, "text"):
            ids, counts = encode(texts, last)
            at = 0
            whole = []
            for key, n in zip(batch.column("key").to_pylist(), counts.tolist()):
                own = ids[at:at + n]
                at += n
                rest = n % capacity
                whole += [[((key, s, own[s:s + capacity], n), 0, capacity)]
                          for s in range(0, n - rest, capacity)]
                if rest:
                    packing.place((key, n - rest, own[n - rest:].copy(), n), rest)
                waiting += 1
                if waiting == group:
                    yield emit(packing.close())
                    waiting = 0
            if whole:
                yield emit(whole)
        yield emit(packing.close())

    return run


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
         tokenizer: str | None = None, last: int = 1, capacity: int = CAPACITY,
         group: int = GROUP) -> DataFrame:
    """One row per piece: ``key``, ``start`` (the document's ids before it),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``
    in that sequence."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("key"),
                       F.col(text).cast("binary").alias("text"))
    out = rows.mapInArrow(packer(tokenizer or tokenizer_path(), last, capacity, group), PIECES)
    return out.withColumnRenamed("key", key)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


ship_by_value(__name__)
