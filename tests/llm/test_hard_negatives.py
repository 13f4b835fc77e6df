"""Hard-negative mining against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varietas.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, key string, score string, `copy` string"


def usable(rows, scale=256):
    return [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]


def brute(rows, positives=5, negatives=10, low=30, high=90):
    most = 2 ** 63 - 1
    data = usable(rows)
    out = []
    for at, (anchor, label, q) in enumerate(data):
        if anchor % 100:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(q, v)), -most - 1), most), i, l)
                  for k, (i, l, v) in enumerate(data) if k != at]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for ps, pid in [(s, i) for s, i, l in scored if l == label][:positives]:
            hits = [(s, i) for s, i, l in scored if l != label and low * ps <= 100 * s <= high * ps]
            out += [(anchor, pid, r, i, ps, s) for r, (s, i) in enumerate(hits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    out = H.hard_negatives(df, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def vectors(seed, n, dim=8, labels=3, size=1.0):
    rng = random.Random(seed)
    return [(i * 10, [rng.gauss(0.3, size) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def test_equal_to_brute_force_with_ties_repeats_and_nulls(spark):
    rows = vectors(1, 150)
    rows += [(7, rows[3][1], 1), (8, rows[3][1], 2), rows[10], rows[10], rows[20],  # ties, repeated anchors
             (None, rows[0][1], 1), (900, None, 1), (1000, rows[1][1], None),
             (1100, [0.1] * 7 + [None], 1), (1200, [float("nan")] + [0.1] * 7, 1),
             (1300, [float("inf")] + [0.1] * 7, 1), (1400, [], 1), (1500, [0.5, 0.5], 2), (-300, [0.2] * 8, 0)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert len(got) > 100


def test_anchors_in_many_blocks_give_the_same_rows(spark):
    rows = vectors(2, 120)
    assert mined(spark, rows, block_bytes=900, positives=2, negatives=3) == brute(rows, 2, 3)


def test_wide_fields_and_scores_beyond_64_bits(spark):
    rows = [(i, [x * 1e7 for x in v], label) for i, v, label in vectors(3, 60, labels=2)]
    assert not H.Packing(8, -256e7, 256e7).narrow
    assert mined(spark, rows) == brute(rows)
    rows.append((5, [3e15] * 8, 0))
    rows.append((100, [2e15] * 8, 0))
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("least, most, fields", [(-160, 160, 2), (0, 10, 4), (-3000000, 5, 1)])
def test_packed_products_are_exact(least, most, fields):
    rng = np.random.default_rng(4)
    rows, anchors = (rng.integers(least, most + 1, (n, 16)).astype(float) for n in (37, 5))
    packing = H.Packing(16, least, most)
    assert packing.fields == fields
    assert (packing.scores(rows, anchors) == rows.astype(np.int64) @ anchors.astype(np.int64).T).all()


def test_no_anchor_or_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []  # no positive


def test_plan_gathers_no_key_and_crosses_nothing(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in vectors(5, 40)], SCHEMA)
    plan = H.hard_negatives(df)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "collect_list" not in plan


def test_label_rule_of_the_query(spark, tmp_path):
    rows = [(i, [float(x) for x in v], label) for i, v, label in vectors(6, 80)]
    rows = [(i // 10 * 7, v, label) for i, v, label in rows] + [(700 * i, v, 9) for i, v, _ in rows[:4]]
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA) \
        .select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label") \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    single = [(i, [float(np.float32(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
              for i, v, label in rows]
    got = sorted(tuple(r) for r in H.op11_hard_negatives(spark, str(tmp_path)).collect())
    assert got == brute(single)
