"""Bracketed trees: subtree decomposition and the subtree-overlap kernel.

A tree string ``(S (NP (DT the) (NN box)))`` is read once from left to
right with a stack of open nodes.  When a node closes, its hash follows from
its words and its children's hashes, so equal subtrees have equal 64-bit
hashes wherever they stand, and a tree becomes one array of numbers.  The
kernel of a pair is the clipped overlap of two such arrays.  All of this is
work on one row: nothing is shuffled by tree.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TREE_TOKEN = re.compile(r"[()]|[^\s()]+")
# Distinct trees whose hashes a task keeps at hand.
KEPT_TREES = 10_000


def subtree_spans(tokens: Sequence[str]) -> list[tuple[int, int]]:
    """``(start, stop)`` of each closed node in the tokens of a tree, in
    order of their ends; brackets without a partner are no nodes."""
    open_at, spans = [], []
    for i, token in enumerate(tokens):
        if token == "(":
            open_at.append(i)
        elif token == ")" and open_at:
            spans.append((open_at.pop(), i + 1))
    return spans


def subtree_hashes(tree: str) -> list[int]:
    """64-bit hashes of all subtrees, bottom-up, in one pass."""
    stack, out = [], []
    for token in TREE_TOKEN.findall(tree):
        if token == "(":
            stack.append(hashlib.blake2b(digest_size=8))
        elif token == ")":
            if stack:
                digest = stack.pop().digest()
                out.append(int.from_bytes(digest, "big", signed=True))
                if stack:
                    stack[-1].update(b"(" + digest)
        elif stack:
            # a word ends in a blank and holds none, so parts cannot run together
            stack[-1].update(b"w" + token.encode() + b" ")
    return out


def _cut_all(trees: Sequence[str | None]) -> pa.ListArray:
    """The strings of all closed nodes of each tree, as :func:`subtree_spans`
    finds them, cut out of one text of the whole batch.

    Brackets get the depth they stand at; at one depth of a tree an opening
    bracket and the next closing one are partners."""
    plain = pa.array([" ".join((t or "").replace("(", " ( ").replace(")", " ) ").split()) for t in trees], pa.string())
    if not len(plain):
        return pa.array([], pa.list_(pa.string()))
    ends, text = np.frombuffer(plain.buffers()[1], np.int32)[:len(plain) + 1], plain.buffers()[2]
    text = text.to_pybytes()[:ends[-1]] if text else b""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((data == ord("(")) | (data == ord(")")))
    tree = np.searchsorted(ends, at, "right") - 1
    opens = data[at] == ord("(")
    total = np.cumsum(np.where(opens, 1, -1))
    first = np.searchsorted(at, ends[:-1])
    depth = total - np.concatenate([[0], total])[first][tree]
    # closing brackets beyond the opened ones lower the ground; each tree
    # begins below all that came before, so the ground starts anew
    below = tree * (2 * len(at) + 2)
    ground = np.minimum(np.minimum.accumulate(depth - below) + below, 0)
    lone = ~opens & (depth == ground) & (np.concatenate([[0], ground[:-1]]) * (at != at[first[tree]]) > ground)
    level = depth - ground + ~opens
    kept = np.flatnonzero(~lone)
    kept = kept[np.lexsort((level[kept], tree[kept]))]
    a, b = kept[:-1], kept[1:]
    pair = opens[a] & ~opens[b] & (tree[a] == tree[b]) & (level[a] == level[b])
    a, b = a[pair], b[pair]
    order = np.argsort(b)
    nodes = [text[i:j] for i, j in zip(at[a[order]].tolist(), (at[b[order]] + 1).tolist())]
    sizes = np.bincount(tree[b], minlength=len(plain))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                    pa.array(nodes, pa.binary()).cast(pa.string()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _cut_all(batch.column("_tree").to_pylist())],
                                         [*batch.schema.names[:-1], "_subtrees"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Counter] = {}

    def bag(tree: str | None) -> Counter:
        if tree not in known:
            if len(known) >= KEPT_TREES:
                known.clear()
            known[tree] = Counter(subtree_hashes(tree or ""))
        return known[tree]

    for batch in batches:
        out = []
        for a, b in zip(batch.column("_qt").to_pylist(), batch.column("_rt").to_pylist()):
            x, y = bag(a), bag(b)
            total = x.total() + y.total()
            out.append(100.0 * (x & y).total() / total if total else 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.float64())],
                                         [*batch.schema.names[:-2], "score"])


def subtrees(trees: DataFrame, tree_col: str, keys: Sequence[str]) -> DataFrame:
    """One row per internal node: ``keys, subtree`` (the node's full
    subtree as a canonical space-separated string; leaves excluded)."""
    rows = trees.select(*keys, F.col(tree_col).alias("_tree"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_subtrees", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_cut, schema).select(*keys, F.explode("_subtrees").alias("subtree"))


def treekernel_pairs(pairs: DataFrame, q_tree: str, r_tree: str) -> DataFrame:
    """``100 * |bag(q) ∩ bag(r)| / (|bag(q)| + |bag(r)|)`` per pair, as
    ``score`` in place of the two trees.  A tree compared with itself scores
    50; a null tree has no subtrees, and two trees without any score 0."""
    rest = [c for c in pairs.columns if c not in (q_tree, r_tree)]
    rows = pairs.select(*rest, F.col(q_tree).alias("_qt"), F.col(r_tree).alias("_rt"))
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_compare, schema)


def treekernel_summary(pairs_scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trial means of the kernel, then average and population std."""
    means = pairs_scored.groupBy(*by, "trial").agg(F.avg("score").alias("trial_mean"))
    return means.groupBy(*by).agg(F.avg("trial_mean").alias("avg"),
                                  F.stddev_pop("trial_mean").alias("std"))
