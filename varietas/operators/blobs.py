"""Numbers and words of many rows as one compressed value, for shuffles that
would else carry each of them as a row of its own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

CODEC = "zstd"


def packed(parts: Sequence[np.ndarray]) -> bytes:
    """Arrays of numbers as one compressed value: the first bytes of all
    numbers of an array stand together, then the second ones and so on."""
    raw = b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, parts))
    head = np.array([len(parts), *[x for a in parts for x in (a.itemsize, len(a))], len(raw)], np.int64)
    return head.tobytes() + pa.compress(raw, codec=CODEC, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays of :func:`packed`, as unsigned numbers."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n + 2)
    raw = np.frombuffer(pa.decompress(data[head.nbytes:], int(head[-1]), codec=CODEC), np.uint8)
    out, at = [], 0
    for width, size in head[1:-1].reshape(-1, 2).tolist():
        planes = raw[at:at + width * size].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(-1))
        at += width * size
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the least width of 1, 2, 4 or 8 bytes that holds them."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def words_to_arrays(words: pa.Array) -> list[np.ndarray]:
    """``words`` (no null) as their lengths and their bytes."""
    if not len(words):
        return [np.empty(0, np.uint8), np.empty(0, np.uint8)]
    _, ends, text = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1]
    return [smallest(np.diff(ends)), np.frombuffer(text, np.uint8)[ends[0]:ends[-1]]]


def words_of_arrays(lengths: np.ndarray, text: np.ndarray) -> pa.Array:
    """The words of :func:`words_to_arrays`."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(text)))


def keyed_slices(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each stretch of rows with equal first ``n_keys`` columns, with these."""
    keys = list(zip(*[c.to_pylist() for c in batch.columns[:n_keys]]))
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield keys[begin], batch.slice(begin, i - begin)
            begin = i
