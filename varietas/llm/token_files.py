"""Token ids in files, entropy-coded with a static range asymmetric numeral
system.

One frequency table, counted over the whole corpus and scaled to ``2^SCALE``,
serves every block.  A block holds whole documents, about ``block`` ids, as
``lanes`` interleaved streams: id ``t * lanes + j`` is step ``t`` of lane
``j``, so that one array operation codes a step of all lanes.  Blocks are
independent.  Inside a block, a checkpoint every ``CHECK`` steps holds the
lanes' states and the place in the words, so that decoding can begin there.
Payload and ids each carry a CRC-32.

The file format is a Parquet folder: ``blocks`` (a row per block: ``file``,
``block``, ``n_tokens``, ``lanes``, ``keys``, ``lengths``, ``states``,
``words``, ``checkpoints``, ``payload_crc32``, ``ids_crc32``) and ``table``
(``id``, ``frequency``).  File and block number give the order of ids.

Documents are range-partitioned on the key, so no task sorts more than its
range.  Defined results: a null or empty text is the end id alone; a null
key comes first; rows with equal keys are ordered by their ids and keep a row
each; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varietas.llm.common import (chunks, shared_folder, ship_by_value, small_batches, starts_of,
                                 table)
from varietas.llm.tokens import encoder, tokenizer_path

SCALE, BLOCK, LANES, CHECK = 20, 1 << 18, 1024, 128
# Ids are kept in 16 bits between the passes; a larger vocabulary is refused.
IDS = 1 << 16
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
TOKENS = "key bigint, n_tokens int, ids binary"
BLOCKS = ("file int, block int, n_tokens bigint, lanes int, keys array<bigint>, "
          "lengths array<int>, states binary, words binary, checkpoints binary, "
          "payload_crc32 bigint, ids_crc32 bigint")
DOCS = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of ids with a count: at least 1, in sum ``2^scale``."""
    total, goal = int(counts.sum()), 1 << scale
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * goal // max(total, 1)), 0)
    freq = freq.astype(np.int64)
    while (over := int(freq.sum()) - goal) != 0 and total:
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        else:  # take from the most frequent, leaving each at least half
            spare = freq[order] // 2
            taken = np.minimum(spare, np.maximum(0, over - (np.cumsum(spare) - spare)))
            freq[order] -= taken
    return freq


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(np.argmax(freq))

    def encode(self, ids: np.ndarray, lanes: int, check: int = CHECK):
        """``(states, words, checkpoints)``; a checkpoint before step ``t``
        is the number of words read so far and the lanes' states."""
        steps = -(-len(ids) // lanes)
        grid = np.full(steps * lanes, self.filler, np.int64)
        grid[:len(ids)] = ids
        freqs, cums = (a[grid].reshape(steps, lanes) for a in (self.freq, self.cum))
        x = np.full(lanes, LOW)
        words, marks = [], []
        for t in range(steps - 1, -1, -1):
            f = freqs[t]
            big = x >= (f << (np.uint64(63) - self.scale))
            words.append(x[big].astype(np.uint32))
            x[big] >>= WORD
            q = x // f
            x = (q << self.scale) + (x - q * f) + cums[t]
            if t and t % check == 0:
                marks.append((len(words), x.copy()))
        flat = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        sizes = starts_of(np.fromiter(map(len, words[::-1]), np.int64, len(words)))
        points = [np.uint64(sizes[len(words) - done]).tobytes() + s.astype("<u8").tobytes()
                  for done, s in reversed(marks)]
        return x.astype("<u8").tobytes(), flat.astype("<u4").tobytes(), b"".join(points)

    def decode(self, states: bytes, words: bytes, n: int, lanes: int, checkpoints: bytes = b"",
               first: int = 0, check: int = CHECK) -> np.ndarray:
        """Ids from checkpoint ``first`` (0: the block's start) to its end."""
        x = np.frombuffer(states, "<u8").astype(np.uint64)
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        at = 0
        if first:
            size = 8 * (lanes + 1)
            mark = np.frombuffer(checkpoints[(first - 1) * size:first * size], "<u8")
            at, x = int(mark[0]), mark[1:].astype(np.uint64)
        steps = -(-n // lanes) - first * check
        out = np.empty((max(steps, 0), lanes), np.uint32)
        mask = np.uint64((1 << int(self.scale)) - 1)
        for t in range(steps):
            slot = x & mask
            s = self.symbol[slot]
            out[t] = s
            x = self.freq[s] * (x >> self.scale) + slot - self.cum[s]
            low = x < LOW
            k = int(np.count_nonzero(low))
            x[low] = (x[low] << WORD) | stream[at:at + k]
            at += k
        return out.reshape(-1)[:n - first * check * lanes]


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values())


def tokenized(path: str, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch, texts in chunks(batches, "text"):
            ids, counts = encode(texts, last)
            # one buffer for all documents, cut by offsets
            offsets = pa.py_buffer((2 * starts_of(counts)).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "n_tokens": pa.array(counts, pa.int32()),
                "ids": pa.Array.from_buffers(pa.binary(), len(counts), [
                    None, offsets, pa.py_buffer(ids.astype("<u2"))])})

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of each id in a task's rows."""
    total = np.zeros(IDS, np.int64)
    for _, rows in chunks(batches, "ids"):
        total += np.bincount(np.frombuffer(b"".join(rows), "<u2"), minlength=IDS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int32()),
                                      "n": pa.array(total[found], pa.int64())})


def blocks_of(freq: np.ndarray, block: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, made = Coder(freq), TaskContext.get().partitionId(), 0
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()),
                            ("lanes", pa.int32()), ("keys", pa.list_(pa.int64())),
                            ("lengths", pa.list_(pa.int32())), ("states", pa.binary()),
                            ("words", pa.binary()), ("checkpoints", pa.binary()),
                            ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64())])

        def flush(keys: list, parts: list[bytes]) -> pa.RecordBatch:
            nonlocal made
            ids = np.frombuffer(b"".join(parts), "<u2")
            wide = max(1, min(lanes, 1 << max(0, (len(ids) // 64).bit_length() - 1)))
            states, words, marks = coder.encode(ids, wide)
            row = (file, made, len(ids), wide, keys, [len(p) // 2 for p in parts], states, words,
                   marks, zlib.crc32(states + words), zlib.crc32(ids.astype("<u4").tobytes()))
            made += 1
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, row)}, schema)

        keys, parts, size = [], [], 0
        for batch, rows in chunks(batches, "ids"):
            for key, ids in zip(batch.column("key").to_pylist(), rows):
                keys.append(key)
                parts.append(ids)
                size += len(ids) // 2
                if size >= block:
                    yield flush(keys, parts)
                    keys, parts, size = [], [], 0
        if keys:
            yield flush(keys, parts)

    return run


def decoded(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["states"] + r["words"]) != r["payload_crc32"]:
                    raise ValueError(f"file {r['file']}, block {r['block']}: damaged payload")
                ids = coder.decode(r["states"], r["words"], r["n_tokens"], r["lanes"])
                data = ids.astype("<u4").tobytes()
                if zlib.crc32(data) != r["ids_crc32"]:
                    raise ValueError(f"file {r['file']}, block {r['block']}: wrong ids")
                at = starts_of(np.asarray(r["lengths"], np.int64))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(r["keys"], pa.int64()),
                    "start": pa.array(at[:-1] + r["start"], pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(data[4 * a:4 * b])
                                           for a, b in zip(at[:-1], at[1:])], pa.int64())})

    return run


def write_token_files(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text",
                      tokenizer: str | None = None, last: int = 2, block: int = BLOCK,
                      lanes: int = LANES) -> None:
    """Write ``blocks`` and ``table`` below ``folder``, ids in ascending
    order of ``key``."""
    spark = docs.sparkSession
    small_batches(spark)
    largest = max(last, largest_id(tokenizer or tokenizer_path()))
    if largest >= IDS:
        raise ValueError(f"ids up to {largest}; the files hold ids below {IDS}")
    rows = docs.select(F.col(key).cast("bigint").alias("key"),
                       F.col(text).cast("binary").alias("text"))
    ids_path = f"{folder}/ids"
    rows.mapInArrow(tokenized(tokenizer or tokenizer_path(), last), TOKENS) \
        .write.parquet(ids_path)
    ids = spark.read.parquet(ids_path)
    counts = ids.select("ids").mapInArrow(counted, "id int, n bigint") \
        .groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most IDS rows
    total = np.zeros(IDS, np.int64)
    for r in counts:
        total[r.id] = r.n
    freq = scaled(total)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)],
                          "id int, frequency int").coalesce(1).write.parquet(f"{folder}/table")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids.repartitionByRange(parts, F.col("key").asc_nulls_first()) \
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "ids") \
        .mapInArrow(blocks_of(freq, block, lanes), BLOCKS) \
        .write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document: ``key``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``, decoded block by block in parallel."""
    freq = np.zeros(IDS, np.int64)
    for r in spark.read.schema("id int, frequency int").parquet(f"{folder}/table").collect():
        freq[r.id] = r.frequency
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = sizes.withColumn("of_file", F.coalesce(F.sum("n").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "n_tokens") \
        .withColumn("of_block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))) \
        .join(before.select("file", "of_file"), "file") \
        .select("file", "block", (F.col("of_file") + F.col("of_block")).alias("start"))
    return blocks.join(starts, ["file", "block"]) \
        .mapInArrow(decoded(freq), DOCS).withColumnRenamed("key", key)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)


ship_by_value(__name__)
