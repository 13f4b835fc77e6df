"""Benchmark decontamination by winnowed fingerprints.

Both sides keep the rightmost minimum of every window of consecutive k-gram
hashes.  A span of ``span`` words holds ``span - k + 1`` consecutive k-grams,
so with that many k-grams a window, any span of ``span`` words that a
document shares with a benchmark item gives one fingerprint kept on both
sides.  Documents meet the benchmark on fingerprints; each hit is extended to
the windows of ``span`` words around it, which are compared as a whole.

Items shorter than ``span`` words are one window each.  Too short for a
fingerprint guarantee, they are compared as whole windows of their length.

The benchmark is the query set: it goes to the executors in blocks of at most
``block_bytes`` of text.  A document row passes the blocks one after another
and carries what it has hit so far, so any benchmark size gives the same
result and no group of documents ever meets in one task.

Defined results: a null text has no words and no hits; a text of any length
is read whole; repeated rows give a row each; an item without words matches
nothing; an item whose id is null marks words but is not listed; items with
equal ids are listed once; empty tables give no rows or no hits.  Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varietas.llm.common import (Words, chunks, gram_hashes, ship_by_value, small_batches,
                                 starts_of, table, written)

SPAN, GRAM = 13, 8
BLOCK_BYTES = 32 << 20
STATE = "n_words bigint, starts array<int>, lengths array<int>, items array<string>"


def item_words() -> Words:
    """Words are runs of a-z, 0-9 and everything beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return Words(inside)


def same_text(h: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of ``k`` words lie in one text."""
    ends = np.repeat(np.cumsum(counts), counts)
    n = max(0, len(h) - k + 1)
    return np.arange(n) + k <= ends[:n]


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the rightmost minimum of every window of ``width`` valid
    k-grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    inside = valid[:n].copy()
    for j in range(1, width):
        lower = grams[j:j + n] <= least
        least[lower] = grams[j:j + n][lower]
        place[lower] = j
        inside &= valid[j:j + n]
    return np.unique((place + np.arange(n))[inside])


class Block:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], span: int, gram: int):
        self.span, self.gram = span, gram
        h, counts = item_words().hashes([t for _, t in items]) if items else (
            np.empty(0, np.uint64), np.empty(0, np.int64))
        bounds = starts_of(counts)
        self.names = [i for i, _ in items]
        self.windows: dict[int, tuple] = {}
        of_length: dict[int, tuple[list, list]] = {}
        prints = []
        for i, n in enumerate(counts.tolist()):
            own = h[bounds[i]:bounds[i + 1]]
            size = min(n, span)
            if size:
                grams = gram_hashes(own, size)
                hs, who = of_length.setdefault(size, ([], []))
                hs.append(grams)
                who.append(np.full(len(grams), i))
            if n >= span:
                g = gram_hashes(own, gram)
                prints.append(g[winnow(g, np.ones(len(g), bool), span - gram + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        for size, (hs, who) in of_length.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate(hs), np.concatenate(who)]))
            hashes, first = np.unique(pairs.f0, return_index=True)
            self.windows[size] = hashes, np.append(first, len(pairs)), pairs.f1.copy()

    def candidates(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Starts of the windows of ``span`` words that hold a document
        fingerprint which is also a benchmark fingerprint."""
        grams = gram_hashes(h, self.gram)
        kept = winnow(grams, same_text(h, counts, self.gram), self.span - self.gram + 1)
        hit = kept[among(self.prints, grams[kept])[0]]
        around = hit[:, None] - np.arange(self.span - self.gram + 1)[None, :]
        starts = np.unique(around)
        return starts[(starts >= 0) & (starts <= len(h) - self.span)]

    def match(self, h: np.ndarray, counts: np.ndarray):
        """``(starts, lengths, item numbers)`` of all matched windows, a row
        for each item of a window."""
        found = []
        for size, (hashes, first, who) in self.windows.items():
            if len(h) < size:
                continue
            fits = same_text(h, counts, size)
            starts = self.candidates(h, counts) if size == self.span else np.arange(len(fits))
            starts = starts[fits[starts]]
            grams = gram_hashes(h, size)[starts]
            is_in, at = among(hashes, grams)
            starts, at = starts[is_in], at[is_in]
            many = first[at + 1] - first[at]
            take = np.repeat(first[at] - starts_of(many)[:-1], many) + np.arange(many.sum())
            found.append((np.repeat(starts, many), np.full(len(take), size), who[take]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def among(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted array, and where."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked, at


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of intervals as ``(starts, lengths)``."""
    if not len(starts):
        return [], []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    firsts = s[new]
    lasts = e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
    return firsts.tolist(), (lasts - firsts).tolist()


def hit_by(block: Block, last: bool):
    """The ``mapInArrow`` function that takes rows past one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = item_words()
        for batch, texts in chunks(batches, "text"):
            h, counts = words.hashes(texts)
            bounds = starts_of(counts)
            starts, sizes, who = block.match(h, counts)
            doc = np.searchsorted(bounds, starts, "right") - 1
            order = np.argsort(doc, kind="stable")
            starts, sizes, who, doc = starts[order], sizes[order], who[order], doc[order]
            upto = np.searchsorted(doc, np.arange(len(texts) + 1))
            before = zip(*(batch.column(c).to_pylist() for c in ("starts", "lengths", "items")))
            out_s, out_l, out_i = [], [], []
            for i, (s0, l0, names) in enumerate(before):
                a, b = upto[i], upto[i + 1]
                if a < b:
                    s = np.concatenate([np.asarray(s0, np.int64), starts[a:b] - bounds[i]])
                    n = np.concatenate([np.asarray(l0, np.int64), sizes[a:b]])
                    s0, l0 = merged(s, s + n)
                    names = sorted({*names, *(block.names[j] for j in np.unique(who[a:b])
                                              if block.names[j] is not None)})
                out_s.append(s0)
                out_l.append(l0)
                out_i.append(names)
            columns = {"row": batch.column("row"), "n_words": pa.array(counts, pa.int64()),
                       "starts": pa.array(out_s, pa.list_(pa.int32())),
                       "lengths": pa.array(out_l, pa.list_(pa.int32())),
                       "items": pa.array(out_i, pa.list_(pa.string()))}
            if not last:
                columns["text"] = batch.column("text")
            yield pa.RecordBatch.from_pydict(columns)

    return run


def item_blocks(benchmark: DataFrame, item: str, text: str,
                block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of about ``block_bytes`` of text; one block at
    a time reaches the driver."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"),
                            F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * total // block_bytes if total > block_bytes else 1
    for b in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r.item, bytes(r.text)) for r in mine.collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text",
              item: str = "item_id", item_text: str = "text", span: int = SPAN,
              gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: the ``row`` itself, ``n_words``, ``n_hit``, the
    merged word spans ``hits`` (start, length) and the ids ``items`` whose
    windows occur, sorted as strings."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"),
                       F.col(text).cast("binary").alias("text"),
                       F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast("array<int>").alias("starts"),
                       F.array().cast("array<int>").alias("lengths"),
                       F.array().cast("array<string>").alias("items"))
    state = T.StructType.fromDDL(STATE).fields
    schema = T.StructType([T.StructField("row", docs.schema), *state])
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        f = hit_by(Block(block, span, gram), following is None)
        if following is None:
            rows = rows.mapInArrow(f, schema)
        else:
            more = T.StructType([*schema.fields, T.StructField("text", T.BinaryType())])
            rows = written(rows.mapInArrow(f, more), "decontaminate")
        block = following
    return rows.select(
        "row", "n_words",
        F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_hit"),
        F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length")).alias("hits"),
        "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows that are not contaminated."""
    return with_hits(docs, benchmark, **names).where(~contaminated()).select("row.*")


def contaminated() -> F.Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
                       F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       contaminated().alias("contaminated"))


SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP10_SQL = f"""
with d as (select doc_id, {SQL_WORDS} w from documents),
b as (select item_id, {SQL_WORDS} w from benchmark),
bw as (select distinct item_id, least(len(w), 13) n,
       array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g
       from b, unnest(range(1, len(w) - least(len(w), 13) + 2)) t(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g
       from d, sizes, unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n),
m as (select doc_id, i, n, item_id from dw join bw using (n, g)),
h as (select doc_id, count(distinct i + j) n_hit
      from (select distinct doc_id, i, n from m), unnest(range(n)) t(j) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
       from (select distinct doc_id, item_id::varchar item from m) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
       coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (doc_id) left join it using (doc_id)
"""

ship_by_value(__name__)
