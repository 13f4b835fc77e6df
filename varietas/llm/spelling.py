"""Grouping of spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  Every word's edits are generated and probed against Bloom
filters of the vocabulary; what a filter lets pass is shuffled to an exact
join with the vocabulary, which takes the false positives out.  An insertion
into one word is a deletion from the other and a replacement goes both ways,
so deletions and replacements by a larger code point generate each near pair
exactly once.

There is one filter for each word length, since an edit's length says which
filter to ask.  A filter is blocked: a word sets a few bits of one 64-bit
block, so a probe reads one number.  Filters take ``FILTER_BYTES`` a word and
go to the executors in passes of at most ``pass_bytes``; a length with more
words than that is split by hash over several passes.  The vocabulary's size
therefore sets the number of passes, never the size of a broadcast.

A word's form is its near word with most occurrences if that has at least
``ratio`` times as many as the word itself.  Forms are followed to the last;
as each step multiplies the count by ``ratio``, the number of steps is known
from the largest count.

Defined results: words are maximal runs of letters (A-Z count as a-z; U+00C0
to U+00FF count as letters) of whole texts; a null or empty text has none; a
text or word of any length is read whole; a row with a null id keeps its runs
as they are; repeated rows count again; ties between near words go to the
smaller in code-point order; an empty table gives no rows.  Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm.common import chunks, mix, ship_by_value, small_batches, table, written

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
DROP = 31  # the query's law: one run in so many loses a code point
# Words counted in a task before it hands its counts on.
TASK_WORDS = 200_000
# Filters: bytes a word, bits a word sets in its block, different bit sets,
# blocks a filter is built from at once, and bytes of a pass.
FILTER_BYTES, SET_BITS, MASKS, SEGMENT = 4, 5, 1 << 14, 8192
PASS_BYTES = 64 << 20
# Code points edited at once, and edits hashed at once.
CELLS, EDITS = 1 << 16, 1 << 18


# ---------------------------------------------------------------- vocabulary
def counted(least: int, drop: int):
    """The ``mapInArrow`` function that counts words of at least ``least``
    code points; every ``drop``-th run by checksum loses a code point."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def emit(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()),
                                           "n": pa.array(words.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Counter()
        for batch, texts in chunks(batches, "text"):
            for ident, text in zip(batch.column("ident").to_pylist(), texts):
                # bytes.lower() changes A-Z alone
                mine = Counter(run.findall(text.lower().decode("utf-8", "replace")))
                if drop and ident is not None:
                    mine = dropped(mine, zlib.crc32(f"{ident}:".encode()), drop, least)
                words.update(mine)
                if len(words) > TASK_WORDS:
                    yield emit(words)
                    words = Counter()
        yield emit(words)

    return count


def dropped(words: Counter, before: int, drop: int, least: int) -> Counter:
    """The counts with one code point less in words whose checksum (carried
    on from ``before``) is divisible by ``drop``."""
    out = Counter()
    for word, n in words.items():
        h = zlib.crc32(word.encode(), before)
        if h % drop == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, ident: str, text: str, least: int, count: int, drop: int) -> DataFrame:
    """Words with their length and number of occurrences."""
    rows = docs.select(F.col(ident).cast("string").alias("ident"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(counted(least, drop), "word string, n bigint") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count) \
        .withColumn("length", F.char_length("word"))


# -------------------------------------------------------------------- hashes
class Spelling:
    """Hashes of words and of their edits: a polynomial in the code points,
    so that an edit's hash follows from the word's by a few operations."""

    def __init__(self):
        rng = np.random.default_rng(20240717)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = np.ones(1, np.uint64)
        bits = rng.permuted(np.tile(np.arange(64, dtype=np.uint64), (MASKS, 1)), axis=1)[:, :SET_BITS]
        self.masks = np.bitwise_or.reduce(np.uint64(1) << bits, axis=1)

    def terms(self, codes: np.ndarray) -> np.ndarray:
        """What each code point (rows are words of one length) adds."""
        n = codes.shape[1]
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]))
        return self.value[codes] * self.powers[:n]

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return mix(self.terms(codes).sum(1, dtype=np.uint64))

    def mask(self, h: np.ndarray) -> np.ndarray:
        return self.masks[h & np.uint64(MASKS - 1)]


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(14)) & np.uint64(0x3FFFF)) % np.uint64(parts)


def by_length(batches: Iterator[pa.RecordBatch], cells: int = CELLS):
    """``(length, words, counts, code points)`` of words of one length, in
    lots of about ``cells`` code points."""
    held: dict[int, list] = {}
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            lot = held.setdefault(len(word), [])
            lot.append((word, n))
            if len(lot) * len(word) >= cells:
                yield lot_of(held.pop(len(word)))
    for lot in held.values():
        yield lot_of(lot)


def lot_of(lot: list) -> tuple[int, list[str], list[int], np.ndarray]:
    words = [w for w, _ in lot]
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return codes.shape[1], words, [n for _, n in lot], codes


# ------------------------------------------------------------------- filters
class Filter:
    """The part of one length's filter that holds the words whose hash falls
    to ``part`` of ``parts``; ``at`` is its place in the pass's array."""

    def __init__(self, length: int, part: int, parts: int, blocks: int, at: int = 0):
        self.length, self.part, self.parts, self.blocks, self.at = length, part, parts, blocks, at


def passes_of(counts: dict[int, int], pass_bytes: int) -> list[list[Filter]]:
    """Filters for so many words of each length, in passes of at most
    ``pass_bytes`` (one block at least)."""
    out, size = [[]], 0
    for length, n in sorted(counts.items()):
        parts = -(-n * FILTER_BYTES // pass_bytes)
        blocks = max(1, -(-n * FILTER_BYTES // (8 * parts)))
        for part in range(parts):
            if out[-1] and size + 8 * blocks > pass_bytes:
                out.append([])
                size = 0
            out[-1].append(Filter(length, part, parts, blocks, size // 8))
            size += 8 * blocks
    return out


def addressed(filters: list[Filter]):
    """The ``mapInArrow`` function that gives each word of the filters its
    block in the pass's array and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling()
        for length, _, _, codes in by_length(batches):
            h = spelling.hashes(codes)
            for f in filters:
                if f.length == length:
                    mine = h[part_of(h, f.parts) == f.part]
                    place = block_of(mine, f.blocks).astype(np.int64) + f.at
                    yield pa.RecordBatch.from_pydict({
                        "segment": pa.array(place // SEGMENT, pa.int64()),
                        "place": pa.array(place % SEGMENT, pa.int64()),
                        "bits": pa.array(spelling.mask(mine).view(np.int64), pa.int64())})

    return run


def segment(rows: pa.Table) -> pa.Table:
    """The blocks of one segment; hashing bounds its words."""
    blocks = np.zeros(SEGMENT, np.int64)
    np.bitwise_or.at(blocks, np.asarray(rows["place"]), np.asarray(rows["bits"]))
    return pa.table({"segment": rows["segment"].slice(0, 1), "blocks": pa.array([blocks.tobytes()], pa.binary())})


def filter_array(words: DataFrame, filters: list[Filter]) -> np.ndarray:
    """The pass's filters as one array of blocks."""
    size = filters[-1].at + filters[-1].blocks
    lengths = sorted({f.length for f in filters})
    found = words.where(F.col("length").isin(lengths)) \
        .mapInArrow(addressed(filters), "segment bigint, place bigint, bits bigint") \
        .groupBy("segment").applyInArrow(segment, "segment bigint, blocks binary").toArrow()
    out = np.zeros(-(-size // SEGMENT) * SEGMENT, np.uint64)
    for at, blocks in zip(found["segment"].to_pylist(), found["blocks"].to_pylist()):
        out[at * SEGMENT:(at + 1) * SEGMENT] = np.frombuffer(blocks, np.uint64)
    return out[:size]


def passed(spelling: Spelling, array: np.ndarray, filters: list[Filter], h: np.ndarray) -> np.ndarray:
    """Which hashes the filters (of one length) let pass."""
    out = np.zeros(len(h), bool)
    bits = spelling.mask(h)
    for f in filters:
        hit = (array[block_of(h, f.blocks) + np.uint64(f.at)] & bits) == bits
        out |= hit if f.parts == 1 else hit & (part_of(h, f.parts) == np.uint64(f.part))
    return out


def probed(shipped, filters: list[Filter], alphabet: list[int]):
    """The ``mapInArrow`` function for the edits that the filters let pass."""
    letters = np.array(sorted(alphabet), np.uint8)
    known: dict[int, list[Filter]] = {}
    for f in filters:
        known.setdefault(f.length, []).append(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, array = Spelling(), shipped.value
        for length, words, counts, codes in by_length(batches):
            terms = spelling.terms(codes)
            total = terms.sum(1, dtype=np.uint64)[:, None]
            if length - 1 in known:
                before = np.cumsum(terms, 1, dtype=np.uint64) - terms
                h = mix((before + (total - before - terms) * spelling.inverse).ravel())
                # of equal neighbours only the first is deleted
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                cells = np.flatnonzero(passed(spelling, array, known[length - 1], h) & first.ravel())
                yield candidates(words, counts, [(c // length, c % length, "") for c in cells.tolist()])
            if length in known:
                rest, old = (total - terms).ravel(), codes.ravel()
                step = max(1, EDITS // max(1, len(letters)))
                for a in range(0, len(rest), step):
                    power = spelling.powers[np.arange(a, min(a + step, len(rest))) % length]
                    edited = rest[a:a + step, None] + spelling.value[letters] * power[:, None]
                    larger = np.flatnonzero((letters > old[a:a + step, None]).ravel())
                    hits = larger[passed(spelling, array, known[length], mix(edited.ravel()[larger]))]
                    cells, new = a + hits // len(letters), letters[hits % len(letters)]
                    yield candidates(words, counts, [(c // length, c % length, chr(x))
                                                     for c, x in zip(cells.tolist(), new.tolist())])

    return run


def candidates(words: list[str], counts: list[int], edits: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[r] for r, _, _ in edits], pa.string()),
        "n": pa.array([counts[r] for r, _, _ in edits], pa.int64()),
        "other": pa.array([words[r][:i] + new + words[r][i + 1:] for r, i, new in edits], pa.string())})


# ---------------------------------------------------------------------- near
def near_pairs(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word, n, other, other_n``: each near pair of the vocabulary once.

    ``words`` is a written table of ``word, n, length``."""
    spark: SparkSession = words.sparkSession
    counts = {r.length: r.n for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most as many rows as there are letters
    alphabet = [ord(r.c) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
                .where(F.col("c") != "").distinct().collect()]
    found = None
    for filters in passes_of(counts, pass_bytes):
        if not filters:
            continue
        shipped = spark.sparkContext.broadcast(filter_array(words, filters))
        lengths = {f.length for f in filters}
        edits = words.where(F.col("length").isin(sorted(lengths | {n + 1 for n in lengths}))) \
            .mapInArrow(probed(shipped, filters, alphabet), "word string, n bigint, other string")
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        return spark.createDataFrame([], "word string, n bigint, other string, other_n bigint")
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(exact, "other").select("word", "n", "other", "other_n")


def spelling_variants(docs: DataFrame, *, ident: str = "doc_id", text: str = "text",
                      least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      ratio: int = RATIO, drop: int = 0, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per word of the vocabulary: ``word, form, root, n, n_near, form_n``."""
    small_batches(docs.sparkSession)
    words = written(vocabulary(docs, ident, text, least_length, least_count, drop), "vocabulary")
    pairs = near_pairs(words, pass_bytes)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("near")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), "word").alias("near")))).alias("p"))
    best = both.groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("p.near").alias("best"))
    larger = -F.col("best.n") >= ratio * F.col("n")
    near = written(words.join(best, "word", "left").select(
        "word", F.when(larger, F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(larger, -F.col("best.n")).alias("form_n")), "forms")
    return with_roots(near, ratio)


def with_roots(near: DataFrame, ratio: int) -> DataFrame:
    """The rows with ``root``, the last word that forms lead to."""
    forms = near.where(F.col("form").isNotNull()).select("word", "form")
    most = near.agg(F.max("form_n")).first()[0] or 0
    least, steps = 1, 0
    while least * ratio <= most:
        least, steps = least * ratio, steps + 1
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps - 1):
        following = forms.select(F.col("word").alias("root"), "form")
        roots = roots.join(following, "root", "left").select("word", F.coalesce("form", "root").alias("root"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs, drop=DROP)


ship_by_value(__name__)
