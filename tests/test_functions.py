"""Hand-computed literal fixtures for the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from varietas.functions import (bleu, clean_text, jaccard, lcs_length, levenshtein,
                                lower_tokens, rouge_l_f, rouge_n_f, rouge_tokens,
                                split_sentences, tokenize)


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,expected", [
    ("Pick up the block.  Place it!  Done? yes", ["Pick up the block", "Place it", "Done", "yes"]),
    ("a - b", ["a  b"]),
    ("- -", [" "]),
    ("...", []),
    ("no break. x\x0by", ["no break", "x y"]),
    ("e.g. 3.5 is ok", ["eg", "35 is ok"]),
    ("wait!!\nnext", ["wait", "next"]),
    ("café “quoted”. Next", ["café “quoted”", "Next"]),
    ("tab\x1cbreak. y", ["tab break", "y"]),
])
def test_split_sentences(spark, text, expected):
    assert _one(spark, split_sentences(F.lit(text))) == expected


def test_split_null(spark):
    assert _one(spark, split_sentences(F.lit(None).cast("string"))) is None


def test_clean_text(spark):
    assert _one(spark, clean_text(F.lit("  hello,   world!  "))) == "hello world"
    assert _one(spark, clean_text(F.lit("!!!"))) is None


def test_tokenize_drops_empty(spark):
    assert _one(spark, tokenize(F.lit(" a  b "))) == ["a", "b"]
    assert _one(spark, rouge_tokens(F.lit("Café, OK-2x"))) == ["caf", "ok", "2x"]


PAIRS = [
    # query, reference, bleu, rougeL, rouge1, lev, jaccard
    ("pick up the pink block", "pick up the pink block", 1.0, 1.0, 1.0, 0, 1.0),
    ("pick up the block", "place the block", 0.0, 0.571429, 0.571429, 6, 0.4),
    ("pick up the pink block and place it", "pick up the pink block", 0.516973, 0.769231, 0.769231, 13, 0.625),
    ("pick up the pink block", "pick up the pink block and place it", 0.548812, 0.769231, 0.769231, 13, 0.625),
    ("open drawer", "open drawer", 0.0, 1.0, 1.0, 0, 1.0),
    ("the block the box", "box the block", 0.0, 0.571429, 0.857143, 10, 1.0),
]


@pytest.mark.parametrize("q,r,b,rl,r1,lev,jac", PAIRS)
def test_pair_scores(spark, q, r, b, rl, r1, lev, jac):
    df = spark.createDataFrame([(q, r)], "q string, r string")
    row = df.select(
        bleu(tokenize("q"), tokenize("r")).alias("bleu"),
        rouge_l_f(rouge_tokens("q"), rouge_tokens("r")).alias("rl"),
        rouge_n_f(rouge_tokens("q"), rouge_tokens("r")).alias("r1"),
        levenshtein("q", "r").alias("lev"),
        jaccard(F.array_distinct(lower_tokens("q")), F.array_distinct(lower_tokens("r"))).alias("jac"),
    ).first()
    assert row.bleu == pytest.approx(b, abs=1e-6)
    assert row.rl == pytest.approx(rl, abs=1e-6)
    assert row.r1 == pytest.approx(r1, abs=1e-6)
    assert row.lev == lev
    assert row.jac == pytest.approx(jac, abs=1e-6)


def _lcs_py(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_lcs_matches_dp_both_paths(spark):
    import random
    rng = random.Random(7)
    rows = []
    for n_a, n_b in [(0, 3), (3, 0), (5, 9), (40, 62), (62, 62), (70, 63), (100, 90), (5, 200),
                     (124, 124), (125, 300), (400, 187)]:
        a = [rng.choice("abcde") for _ in range(n_a)]
        b = [rng.choice("abcde") for _ in range(n_b)]
        rows.append((a, b, _lcs_py(a, b)))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want int")
    got = df.select(lcs_length("a", "b").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_empty_sides_score_zero(spark):
    df = spark.createDataFrame([([], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    rows = df.select(bleu("a", "b").alias("s_bleu"), rouge_l_f("a", "b").alias("s_rl"),
                     rouge_n_f("a", "b").alias("s_r1"), jaccard("a", "b").alias("s_j")).collect()
    for r in rows:
        assert (r.s_bleu, r.s_rl, r.s_r1, r.s_j) == (0.0, 0.0, 0.0, 0.0)
    assert not any(math.isnan(v) for r in rows for v in r)
