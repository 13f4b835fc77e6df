"""Word clouds and report rules against fixtures written from the definition."""

import pytest

from varietas.operators import stats
from varietas.plans import report


def corpus(spark, texts):
    return spark.createDataFrame([(ds, i, 0, t) for i, (ds, t) in enumerate(texts)],
                                 "ds_name string, doc_id bigint, pos int, nl_instructions string")


def test_no_bigram_bridges_a_stop_word(spark):
    out = stats.bigram_frequency(corpus(spark, [
        ("a", "pick up the block"), ("b", "Red block red block"), ("b", "red 42 block's edge"), ("b", "one"),
        ("b", None), ("b", "")]))
    got = {(r.ds_name, r.bigram): r.n for r in out.collect()}
    assert got == {("b", "red block"): 3, ("b", "block red"): 1, ("b", "block edge"): 1}


def test_plurals_fold_into_their_singular(spark):
    out = stats.word_frequency(corpus(spark, [
        ("a", "block blocks Blocks grass glass boxes"), ("b", "blocks"), (None, "cup cups")]))
    got = {(r.ds_name, r.word): r.n for r in out.collect()}
    assert got == {("a", "block"): 3, ("a", "grass"): 1, ("a", "glass"): 1, ("a", "boxes"): 1,
                   ("b", "blocks"): 1, (None, "cup"): 2}


def test_words_of_an_array_column(spark):
    df = spark.createDataFrame([("a", ["cup", "cups"]), ("a", []), ("a", None)],
                               "ds_name string, nouns array<string>")
    assert [(r.word, r.n) for r in stats.word_frequency(df, "nouns").collect()] == [("cup", 2)]


def test_groups_without_tokens_count_zero(spark):
    out = stats.unique_unigrams(corpus(spark, [("a", "x y x"), ("b", " "), ("c", None)]))
    assert {(r.ds_name, r.n_unigrams) for r in out.collect()} == {("a", 2), ("b", 0), ("c", 0)}
    assert stats.unique_unigrams(corpus(spark, [("a", "x y"), ("b", "y")]), by=[]).first()[0] == 2


def test_report_values_are_rounded_once(spark):
    df = spark.createDataFrame([(0.12344951,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(report.fmt4(df.v)).collect()] == ["0.1234", "2.0000", None]


def test_report_refuses_what_it_cannot_fill(spark):
    S = corpus(spark, [("a", "x y")])
    with pytest.raises(ValueError, match="unknown"):
        report.build_report(S, ["no such metric"])
    with pytest.raises(ValueError, match="scored_vectors"):
        report.build_report(S, ["bertscore"])


def test_report_takes_bertscore_from_scored_pairs(spark):
    scored = spark.createDataFrame([("a", t, s, f) for t, s, f in ((0, 0, 0.5), (0, 1, 0.7), (1, 0, 0.8))],
                                   "ds_name string, trial int, sid int, f1 double")
    out = report.build_report(corpus(spark, [("a", "x y")]), ["unique_unigrams", "bertscore"],
                              scored_vectors=scored).collect()
    assert {r.metric: r.line for r in out}["bertscore"] == \
        "Average bertscore pairwise scores: 0.7000. Stddev: 0.1000."
