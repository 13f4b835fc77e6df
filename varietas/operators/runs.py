"""Distinct runs of words, counted in Arrow batches.

A task numbers the words of some batches, leaves each run once and deals the
runs to buckets by a hash of their words, all runs of a bucket as one
compressed value with the words they use.  A bucket then numbers the words of
its values anew and counts its distinct runs.  Runs are compared by their
words, so counts are exact; hashes only say where a run is counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa

from varietas.operators.blobs import keyed_slices, packed, smallest, unpacked, words_of_arrays, words_to_arrays

# Runs of a bucket, before equal ones are left out, and tokens that a task
# gathers before it deals out their runs.
BUCKET_RUNS = 1 << 21
GATHERED = 1 << 21


def lengths_dealt(n: int) -> list[tuple[int, int]]:
    """``(m, d)``: runs of ``m`` words are dealt by their first ``d`` and
    counted for the lengths ``d`` to ``m``.  The first word alone never deals
    longer runs, as a frequent word's would all meet."""
    longest = [(n, n - 1 if n > 2 else n)]
    return longest + [(m, m) for m in range(longest[0][1] - 1, 0, -1)]


def distinct_rows(columns: Sequence[np.ndarray], bits: int) -> list[np.ndarray]:
    """The distinct rows, in order, of columns of numbers below ``2 ** bits``."""
    def one(cols: Sequence[np.ndarray]) -> np.ndarray:
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            key = key << bits | c
        return key

    def apart(key: np.ndarray, n: int) -> list[np.ndarray]:
        return [key >> bits * (n - 1 - i) & (1 << bits) - 1 for i in range(n)]

    fit = 62 // bits
    if len(columns) <= fit:
        return apart(np.unique(one(columns)), len(columns))
    # the first columns of a row become the place of their values in order
    values, place = np.unique(one(columns[:fit]), return_inverse=True)
    rest = distinct_rows([place, *columns[fit:]], max(bits, len(values).bit_length()))
    return [*apart(values[rest[0]], fit), *rest[1:]]


def _changes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return changed


def _runs(codes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """Distinct runs of rows of ``codes``; 0 stands after a row's end."""
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(codes))
    left = end - place
    at = np.flatnonzero(left > np.repeat(sizes - starts, sizes))
    padded = np.concatenate([codes, np.zeros(n, codes.dtype)])
    return distinct_rows([np.where(left[at] > i, padded[at + i], 0) for i in range(n)], bits)


def _dealt(runs: list[np.ndarray], words: pa.Array, hashes: np.ndarray, n: int,
           buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for m, d in lengths_dealt(n):
        first = runs[:m]
        kept = np.flatnonzero(_changes(first) & (first[d - 1] > 0))
        first = [c[kept] for c in first]
        count = buckets if m == n else buckets // 4 + 1
        h = np.zeros(len(kept), np.uint64)
        if count > 1:
            for c in first[:d]:
                h = (h ^ hashes[c]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        bucket = (h % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=count))
        for b, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if end > begin:
                yield m, b, _value([c[order[begin:end]] for c in first], words)


def _value(runs: list[np.ndarray], words: pa.Array) -> bytes:
    used = np.zeros(len(words) + 1, bool)
    for c in runs:
        used[c] = True
    used[0] = True
    number = np.cumsum(used) - 1
    own = words.take(pa.array(np.flatnonzero(used[1:])))
    columns = [smallest(number[c]) for c in runs]
    columns[0] = smallest(np.diff(number[runs[0]], prepend=0))  # in order
    return packed([*words_to_arrays(own), *columns])


def deal_runs(n: int, n_keys: int):
    """The ``mapInArrow`` function that deals out the runs of the rows of
    ``ngrams.token_rows``, with the number of ``_buckets`` of their group."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        gathered = 0
        for batch in batches:
            waiting.append(batch)
            gathered += len(batch.column("_t").flatten())
            if gathered >= GATHERED:
                yield from _deal(waiting, n, n_keys)
                waiting, gathered = [], 0
        if waiting:
            yield from _deal(waiting, n, n_keys)

    return deal


def _deal(batches: list[pa.RecordBatch], n: int, n_keys: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    schema, table = table.schema, table.to_batches()[0] if table.num_rows else None
    if table is None:
        return
    lists = table.column("_t")
    coded = lists.flatten().dictionary_encode()
    codes, sizes = np.asarray(coded.indices), np.asarray(lists.value_lengths(), np.int64)
    begin, starts = np.cumsum(sizes) - sizes, np.asarray(table.column("_starts"), np.int64)
    hashes = np.array([0, *[crc32(w.encode()) + 1 for w in coded.dictionary.to_pylist()]], np.uint64)
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[c.to_pylist() for c in table.columns[:n_keys + 1]])):
        places.setdefault(key, []).append(i)
    for key, at in places.items():
        size = sizes[at]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine = codes[np.repeat(begin[at], size) + within]
        used = np.zeros(len(coded.dictionary), bool)
        used[mine] = True
        own = np.flatnonzero(used)
        number = np.cumsum(used)  # from 1
        runs = _runs(number[mine], size, starts[at], n, max(1, len(own).bit_length()))
        words = coded.dictionary.take(pa.array(own))
        out = list(_dealt(runs, words, np.concatenate([hashes[:1], hashes[1:][own]]), n, int(key[-1])))
        m, b, v = zip(*out)
        columns = [pa.array([k] * len(out), t) for k, t in zip(key[:-1], schema.types)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(m, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.binary())],
            [*schema.names[:n_keys], "_m", "_b", "_v"])


def _counted(values: list[bytes], m: int, d: int) -> list[tuple[int, int]]:
    """``(k, distinct runs of k words)`` of a bucket."""
    parts = [unpacked(v) for v in values]
    coded = pa.concat_arrays([words_of_arrays(*p[:2]) for p in parts]).dictionary_encode()
    codes = np.concatenate([np.asarray(coded.indices).astype(np.int64) + 1])
    columns: list[list[np.ndarray]] = [[] for _ in range(m)]
    at = 0
    for p in parts:
        number = np.concatenate([[0], codes[at:at + len(p[0])]])
        at += len(p[0])
        for i, c in enumerate(p[2:]):
            columns[i].append(number[np.cumsum(c, dtype=np.int64) if i == 0 else c])
    runs = distinct_rows([np.concatenate(c) for c in columns], max(1, len(coded.dictionary).bit_length()))
    return [(k, int((_changes(runs[:k]) & (runs[k - 1] > 0)).sum())) for k in range(d, m + 1)]


def count_runs(n: int, n_keys: int):
    """The ``mapInArrow`` function that counts the distinct runs of each
    bucket, whose rows come together."""
    counted_from = dict(lengths_dealt(n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, values, out, schema = None, [], [], None

        def done() -> None:
            m = mine[n_keys]
            out.extend((*mine[:n_keys], *x) for x in _counted(values, m, counted_from[m]))

        for batch in batches:
            schema = batch.schema
            for key, rows in keyed_slices(batch, n_keys + 2):
                if key != mine:
                    if mine is not None:
                        done()
                    mine, values = key, []
                values.extend(rows.column("_v").to_pylist())
        if mine is not None:
            done()
            types = [*schema.types[:n_keys], pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             [*schema.names[:n_keys], "n", "_d"])

    return count
