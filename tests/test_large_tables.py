"""Steps whose cost a row or a shuffle made too large for large tables."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from varietas.functions.text import clean_text, split_sentences, tokenize
from varietas.operators import collocations, diversity, patterns, stats
from varietas.operators.annotate import LEXICON, pos_tag, shallow_tree, dependency_struct, dep_tree_string, upos_tags
from varietas.operators.clean import clean_and_standardize

TEXTS = ["The old box.  Pick it up! To lamp, must Lamp 12 running", "a - b c\x1cd\te \n f", "   ", "",
         None, "Ünder État been Boxes glass us. should glow; is Having", "x\n\ny. z\r\n?", "the the the the"]


def sentences(spark):
    rows = [(d, i, t) for d in ("x", "y") for i, t in enumerate(TEXTS)]
    return clean_and_standardize(spark.createDataFrame(rows, "ds_name string, doc_id long, nl_instructions string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sentence_is_cleaned_once(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    out = df.select(split_sentences("t").alias("s"))
    assert plan(out).count("translate(") == 1
    ws = r"(?U)[\s\x1c-\x1f]+"
    pieces = F.split("t", r"(?U)(?<=[.!?])[\s\x1c-\x1f]+")
    old = F.filter(F.transform(pieces, lambda p: F.translate(F.trim(F.regexp_replace(
        p, ws, " ")), r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", "")), lambda s: s != "")
    words = F.filter(F.split("t", ws), lambda w: w != "")
    for r in df.select(split_sentences("t"), old, tokenize("t"), words, clean_text("t")).collect():
        assert r[0] == r[1] and r[2] == r[3]


def plain_tags(tokens):
    def tag(i, word):
        t, n = word.lower(), len(word)
        if t in LEXICON:
            return LEXICON[t]
        if word.isdigit():
            return "CD"
        if i and word[0].isupper():
            return "NNP"
        for least, ends, found in ((5, ("ing",), "VBG"), (4, ("ed",), "VBD"), (4, ("ly",), "RB"), (
                5, ("able", "ible", "ful", "ous", "ive", "less", "ical", "ish"), "JJ")):
            if n >= least and t.endswith(ends):
                return found
        return "NNS" if n > 3 and t.endswith("s") and not t.endswith("ss") else "NN"

    base = [tag(i, w) for i, w in enumerate(tokens)]
    return ["VB" if i and base[i - 1] in ("TO", "MD") and t == "NN" and w.lower() not in LEXICON else t
            for i, (w, t) in enumerate(zip(tokens, base))]


def test_batches_are_tagged_like_single_sentences(spark):
    T = pos_tag(sentences(spark)).withColumn("plain", upos_tags(F.col("tokens"), F.col("tags")))
    assert "element_at" not in plan(pos_tag(sentences(spark)))  # no lookup through a map for each token
    rows = T.collect()
    assert len(rows) == 2 * len({(r.doc_id, r.pos) for r in rows}) > 10
    for r in rows:
        assert r.tags == plain_tags(r.tokens) and r.upos == r.plain


def test_trees_of_a_batch_keep_to_their_sentences(spark):
    rows = [(0, [], []), (1, None, None), (2, ["red", "box"], ["JJ", "NN"]), (3, ["the", "box", "a", "b", "go"],
            ["DT", "NN", "DT", "NN", "VB"]), (4, ["old"], ["JJ"]), (5, ["box"], ["NN"])]
    df = spark.createDataFrame(rows, "i int, k array<string>, t array<string>").coalesce(1)
    out = df.select("i", shallow_tree(F.col("k"), F.col("t")).alias("tree"),
                    dep_tree_string(dependency_struct(F.col("k"), F.col("t"))).alias("dep"))
    assert "lambda" not in plan(out.select("tree"))
    got = {r.i: (r.tree, r.dep) for r in out.collect()}
    assert got == {
        0: ("(S )", ""), 1: (None, None), 2: ("(S (NP (JJ red) (NN box)))", "head: red dep: ROOT; head: red dep: obj"),
        3: ("(S (NP (DT the) (NN box)) (NP (DT a) (NN b)) (VB go))", "head: box dep: det; head: go dep: nsubj; "
            "head: b dep: det; head: go dep: nsubj; head: go dep: ROOT"),
        4: ("(S (JJ old))", "head: old dep: ROOT"), 5: ("(S (NP (NN box)))", "head: box dep: ROOT")}


def test_words_of_a_text_are_formed_once(spark):
    S = spark.createDataFrame([("x", "red box's lid and lid 12 ab"), ("x", "one"), ("x", None), ("y", "")],
                              "ds_name string, nl_instructions string")
    out = stats.bigram_frequency(S)
    assert plan(out).count("regexp_extract_all") == 1
    assert {(r.bigram, r.n) for r in out.collect()} == {("red box", 1), ("box lid", 1), ("lid ab", 1)}


def test_collocations_read_the_texts_for_two_counts_only(spark):
    out = collocations.collocations(sentences(spark))
    assert "regexp_extract_all" not in plan(out)


def test_a_run_is_dealt_out_once_for_all_lengths(spark):
    S = sentences(spark)
    out = diversity.ngram_diversity(S, 4)
    assert "concat_ws" not in plan(out)
    for r in out.collect():
        words = [w for s in S.where(F.col("ds_name") == r.ds_name).orderBy("doc_id", "pos").collect()
                 for w in s.nl_instructions.split()]
        runs = [[tuple(words[i:i + k]) for i in range(len(words) - k + 1)] for k in range(1, 5)]
        assert r.n_tokens == len(words)
        assert abs(r.ngram_diversity - sum(len(set(x)) / len(x) for x in runs)) < 1e-12


def test_patterns_are_counted_without_their_texts(spark):
    out = patterns.common_patterns_full(pos_tag(sentences(spark)), n=2, top_k=2)
    assert any("ExistingRDD" in line and "pattern" in line for line in plan(out).splitlines())
    assert out.count() > 0


def test_folded_counts_equal_whole_counts(monkeypatch):
    monkeypatch.setattr(diversity, "FOLDED_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 9, (3, k)).astype(np.int32) for k in (1, 5, 2, 9, 1)]
    counts = diversity._Counts(3)
    for r in rows:
        counts.add(r)
    whole = [Counter(row.tolist()) for row in np.concatenate(rows, axis=1)]
    assert counts.collisions() == [sum(c * (c - 1) for c in w.values()) for w in whole]
