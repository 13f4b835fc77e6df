"""Rows that are shuffled once, or as one value for many."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varietas.operators import blobs, diversity, patterns, runs
from varietas.operators.clean import clean_and_standardize
from varietas.plans import report
from varietas.session import DROP_SHUFFLES, shuffles_dropped


def corpus(spark, n, words=30, seed=1):
    rng = random.Random(seed)
    rows = [("ab"[i % 3 // 2], i, ". ".join(" ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(
        rng.randrange(1, 9))) for _ in range(3))) for i in range(n)]
    return clean_and_standardize(spark.createDataFrame(rows, "ds_name string, doc_id long, nl_instructions string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_come_back_from_their_bytes():
    parts = [np.arange(300, dtype=np.uint16), np.array([], np.uint8), np.array([1 << 40, 3], np.uint64)]
    back = blobs.unpacked(blobs.packed(parts))
    assert [x.tolist() for x in back] == [x.tolist() for x in parts]
    words = pa.array(["", "né", "x", "long" * 90])
    assert blobs.words_of_arrays(*blobs.words_to_arrays(words.slice(1))) == words.slice(1)
    assert len(blobs.words_of_arrays(*blobs.words_to_arrays(words.slice(4)))) == 0


def test_shares_of_a_group_add_up_to_the_whole(spark, monkeypatch):
    """homogenization_minhash (F3): a text is dealt to one share, not to a slice
    of the hashes each."""
    S = corpus(spark, 60).cache()
    whole = {tuple(r) for r in diversity.homogenization_minhash(S).collect()}
    assert " explode(" not in plan(diversity.homogenization_minhash(S))
    for name, value in {"SHARE_ROWS": (7, 7), "FOLDED_ROWS": 3, "HELD_FOLDS": 2, "HELD_VALUES": 300}.items():
        monkeypatch.setattr(diversity, name, value)
    assert {tuple(r) for r in diversity.homogenization_minhash(S).collect()} == whole
    assert len(whole) == 2


def test_distinct_rows_of_any_width():
    rng = np.random.default_rng(5)
    for n, most in ((1, 9), (4, 3), (4, 1 << 17), (7, 1 << 20), (3, 1 << 30)):
        columns = [rng.choice(rng.integers(0, most, 4), 500) for _ in range(n)]
        got = runs.distinct_rows(columns, most.bit_length())
        assert list(zip(*[c.tolist() for c in got])) == sorted(set(zip(*[c.tolist() for c in columns])))


def test_runs_are_dealt_as_bytes_and_texts_once(spark, monkeypatch):
    """ngram_diversity, ngram_diversity_all (F5, F6): no shuffle carries a
    position's words, and one carries the texts."""
    S = corpus(spark, 60)
    for by in (["ds_name"], []):
        out = diversity.ngram_diversity(S, 4, by)
        groups = {}
        for r in S.orderBy("ds_name", "doc_id", "pos").collect():
            groups.setdefault(r.ds_name if by else None, []).extend(r.nl_instructions.split())
        want = sorted((sum(len({tuple(t[i:i + k]) for i in range(len(t) - k + 1)}) / (len(t) - k + 1)
                           for k in range(1, 5)), len(t)) for t in groups.values())
        for buckets, gathered in ((1 << 21, 1 << 21), (40, 100)):
            monkeypatch.setattr(diversity, "BUCKET_RUNS", buckets)
            monkeypatch.setattr(runs, "GATHERED", gathered)
            out = diversity.ngram_diversity(S, 4, by)
            got = sorted((r.ngram_diversity, r.n_tokens) for r in out.collect())
            assert np.allclose(got, want, rtol=1e-12)
            final = plan(out).split("== Initial Plan ==")[0]
            assert "token_0#" not in "".join(x for x in final.splitlines() if "hashpartitioning" in x)
            assert final.count("partial_collect_list") == 1


def test_runs_of_each_length(spark):
    S = corpus(spark, 12)
    tokens = [t for r in S.orderBy("doc_id", "pos").collect() for t in r.nl_instructions.split()]
    one = S.withColumn("ds_name", F.lit("x"))
    for n in (1, 2, 3, 5, 6):
        want = sum(len({tuple(tokens[i:i + k]) for i in range(len(tokens) - k + 1)}) / (len(tokens) - k + 1)
                   for k in range(1, n + 1))
        assert abs(diversity.ngram_diversity(one, n).first().ngram_diversity - want) < 1e-12


def test_metrics_of_a_report_leave_no_shuffles(spark):
    """report, report_full (F1, F2): metrics are written one after the other,
    and the shuffle files of each go."""
    S = corpus(spark, 30)
    before = spark.conf.get(DROP_SHUFFLES, None)
    out = report.build_report(S, ("unique_commands", "rouge_l", "homogenization_minhash", "ngram_diversity"), n_samples=9)
    assert "Exchange" not in plan(out) and spark.conf.get(DROP_SHUFFLES, None) == before
    assert sorted((r.ds_name, r.metric) for r in out.collect()) == sorted(
        (d, m) for d in "ab" for m in ("unique_commands", "rouge_l", "homogenization_minhash", "ngram_diversity"))
    with shuffles_dropped(spark):
        assert spark.conf.get(DROP_SHUFFLES) == "true"


def test_texts_of_the_best_patterns(spark, monkeypatch):
    """common_patterns_full (F4): texts are formed where their documents are, for
    the best patterns only, and the tagged documents are shuffled once for them."""
    rng = random.Random(8)
    rows = [("ab"[d % 2], d // 2, p, [rng.choice(["x", "y", "né"]) for _ in range(k)], [rng.choice("NVD") for _ in range(k)])
            for d in range(24) for p in range(3) for k in [rng.randrange(5)]]
    T = spark.createDataFrame(rows, "ds_name string, doc_id long, pos int, tokens array<string>, tags array<string>")
    for n, most in ((1, 4), (3, 1 << 20), (3, 4)):
        monkeypatch.setattr(patterns, "MOST_RUNS", most)
        want = set()
        for g in "ab":
            mine = [r for r in sorted(rows, key=lambda r: r[:3]) if r[0] == g]
            tokens, tags = ([x for r in mine for x in r[c]] for c in (3, 4))
            at = range(len(tags) - n + 1)
            counts = Counter(" ".join(tags[i:i + n]) for i in at)
            best = {p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]}
            want |= {(g, p, " ".join(tokens[i:i + n])) for i in at if (p := " ".join(tags[i:i + n])) in best}
        out = patterns.common_patterns_full(T, n, 2)
        got = [tuple(r) for r in out.collect()]
        assert set(got) == want and len(got) == len(want)
        final = plan(out).split("== Initial Plan ==")[0]
        assert "MapInArrow" in final and final.count("partial_collect_list") <= 2
