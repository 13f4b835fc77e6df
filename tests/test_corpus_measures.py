"""All-pairs homogenisation, collocations, token runs, draws and blocks
against brute force, grouped and ungrouped."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varietas.functions.text import tokenize
from varietas.operators import (annotate, collocations, diversity, joins, ngrams, ordering,
                                patterns, sampling, stats, trees)
from varietas.operators.clean import clean_and_standardize
from varietas.plans import report


def corpus(spark, rows):
    return spark.createDataFrame(rows, "ds_name string, doc_id long, nl_instructions string")


def random_rows(seed, n, words="abcdefgh", most=9):
    rng = random.Random(seed)
    # both datasets use the ids 0, 1, ...
    return [(f"d{i % 2}", i // 2, " ".join(rng.choice(words) for _ in range(rng.randrange(most))) + ".")
            for i in range(n)]


def in_order(S, by):
    groups = defaultdict(list)
    for r in S.orderBy("ds_name", "doc_id", "pos").collect():
        groups[r.ds_name if by else None].append(r.nl_instructions)
    return groups


# ---------------------------------------------------------- homogenisation
def mean_jaccard(texts):
    sets = [set(t.lower().split()) for t in texts]
    scores = [len(a & b) / len(a | b) if a | b else 0.0
              for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j]
    return sum(scores) / len(scores)


@pytest.mark.parametrize("by", [["ds_name"], []])
def test_collisions_estimate_the_mean_over_all_pairs(spark, by):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    S = corpus(spark, [(f"d{i % 2}", i, " ".join(rng.sample(words, rng.randrange(1, 12)))) for i in range(120)]) \
        .withColumn("pos", F.lit(0))
    got = diversity.homogenization_minhash(S, by).collect()
    texts = in_order(S, by)
    assert len(got) == len(texts)
    for row in got:
        mine = texts[row.ds_name if by else None]
        assert row.n_rows == len(mine) and row.n_pairs == len(mine) * (len(mine) - 1)
        assert 0 < row.std_error < 0.02
        assert abs(row.homogenization - mean_jaccard(mine)) <= 3 * row.std_error


def test_collisions_are_within_three_errors_on_the_smallest_data(spark, sf_dir):
    from varietas.plans.queries import sentences
    S = sentences(spark, sf_dir).cache()
    texts = in_order(S, True)
    rows = {r.ds_name: r for r in diversity.homogenization_minhash(S).collect()}
    assert set(rows) == set(texts)
    for g, mine in texts.items():
        assert abs(rows[g].homogenization - mean_jaccard(mine)) <= 3 * rows[g].std_error


def test_collisions_of_few_or_empty_rows(spark):
    S = spark.createDataFrame([("one", "a b"), ("none", " "), ("none", " "), ("same", "a B"), ("same", "b A a"),
                               ("same", None)], "ds_name string, nl_instructions string")
    got = {r.ds_name: (r.n_rows, r.homogenization, r.std_error) for r in diversity.homogenization_minhash(S).collect()}
    assert got == {"one": (1, None, None), "none": (2, 0.0, 0.0), "same": (2, 1.0, 0.0)}
    assert diversity.homogenization_minhash(S.limit(0)).collect() == []


# ------------------------------------------------------------ collocations
def ratio(both, first, second, total):
    def log(x):
        return math.log(max(x, 1e-10))

    def likelihood(k, n, x):
        return log(x) * k + log(1 - x) * (n - k)

    if total <= first or total <= second:
        return 0.0
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    return -2 * (likelihood(both, first, p) + likelihood(second - both, total - first, p)
                 - likelihood(both, first, p1) - likelihood(second - both, total - first, p2))


def test_accepted_pairs_take_their_words_along(spark):
    texts = ["red block moves"] * 30 + ["green block"] * 3 + ["red door"] * 2 + ["tall tree stands"] * 40 + ["trees fall"]
    S = spark.createDataFrame([("d", t) for t in texts], "ds_name string, nl_instructions string")
    pairs, _ = collocations.scored_pairs(S, "nl_instructions", ["ds_name"])
    scores = {r.bigram: r.score for r in pairs.collect()}
    words = Counter(w for t in texts for w in t.split())
    words["tree"] += words.pop("trees")
    total = sum(words.values())
    assert scores["red block"] == pytest.approx(ratio(30, words["red"], words["block"], total), rel=1e-9)
    assert scores["green block"] == pytest.approx(ratio(3, 3, words["block"], total), rel=1e-9)
    assert scores["trees fall"] == pytest.approx(ratio(1, words["tree"], 1, total), rel=1e-9)
    got = {r.term: r.n for r in collocations.collocations(S).collect()}
    assert scores["red block"] > 30 > scores["green block"]
    # blocks: 33, of which 30 in "red block" and 30 in "block moves" are taken off
    assert got["red block"] == 30 and got["red"] == 2 and got["block"] == 33 - 30 - 30
    assert got["tree"] == 41 - 40 - 40 and got["green"] == 3 and "green block" not in got


def test_threshold_is_a_parameter(spark):
    S = spark.createDataFrame([("d", "blue box")] * 5 + [("d", "old chair")] * 5, "ds_name string, nl_instructions string")
    assert [r.term for r in collocations.collocations(S, by=[], threshold=1e9).collect()
            if " " in r.term] == []
    assert {r.term for r in collocations.collocations(S, by=[], threshold=1.0).collect()
            if " " in r.term} == {"blue box", "old chair"}


def test_counts_without_pairs_equal_the_word_frequencies(spark, sf_dir):
    from varietas.plans.queries import sentences
    S = sentences(spark, sf_dir)
    a = {(r.ds_name, r.term): r.n for r in collocations.collocations(S, max_words=30, threshold=1e18).collect()}
    b = {(r.ds_name, r.word): r.n for r in stats.word_frequency(S, max_words=30).collect()}
    assert a == b


# -------------------------------------------------------------- token runs
def runs_of(tokens, n):
    return Counter(" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


@pytest.mark.parametrize("by", [["ds_name"], []])
@pytest.mark.parametrize("bucket", [4, 7, 1 << 20])
def test_every_run_of_the_corpus_counts_once(spark, by, bucket):
    S = clean_and_standardize(corpus(spark, random_rows(11, 160, most=5)))
    grouped, keys = ordering.with_group(S, by)
    runs, totals = ngrams.token_runs(grouped, {"token": tokenize("nl_instructions")}, 4, keys, bucket)
    texts = in_order(S, by)
    sizes = {r[keys[0]]: r.total for r in totals.collect()}
    for m in range(1, 5):
        rows = runs.select(*keys, ngrams.gram("token", m).alias("g")).where("g is not null").collect()
        for g, mine in texts.items():
            tokens = " ".join(mine).split()
            assert Counter(r.g for r in rows if r[keys[0]] == (g if by else 0)) == runs_of(tokens, m)
            assert sizes[g if by else 0] == len(tokens)


def test_ngram_diversity_without_groups(spark):
    S = clean_and_standardize(corpus(spark, random_rows(12, 100)))
    tokens = " ".join(in_order(S, [])[None]).split()
    want = sum(len(runs_of(tokens, n)) / (len(tokens) - n + 1) for n in range(1, 5))
    got = diversity.ngram_diversity(S, 4, by=[]).collect()
    assert [r.ngram_diversity for r in got] == [pytest.approx(want, abs=1e-12)]
    assert got[0].asDict().keys() == {"ngram_diversity", "n_tokens"}


def test_no_token_is_checkpointed_or_range_partitioned(spark, sf_dir):
    from varietas.plans.queries import annotated, sentences
    for df in (diversity.ngram_diversity(sentences(spark, sf_dir)),
               patterns.common_patterns_full(annotated(spark, sf_dir)),
               diversity.compression_ratio(sentences(spark, sf_dir))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
        kept = [line for line in plan.splitlines() if "Scan ExistingRDD" in line]
        assert kept and not any(c in line for line in kept for c in ("token", "nl_instructions", "_text", "_s#"))


# ------------------------------------------------------------------- draws
def test_equal_ids_of_two_datasets_stay_apart(spark):
    S = clean_and_standardize(corpus(spark, [(d, i, f"{d} text {i}. more") for d in ("x", "y") for i in range(5)]))
    out = sampling.sample_pairs(S, 300, 2, by=[]).collect()
    assert len(out) == 600
    order = {i: r for i, r in enumerate(S.orderBy("ds_name", "doc_id", "pos").collect())}
    for r in out:
        for side in "qr":
            want = order[r[f"{side}_idx"]]
            assert (r[f"{side}_ds_name"], r[f"{side}_doc_id"], r[f"{side}_pos"], r[f"{side}_nl_instructions"]) == \
                (want.ds_name, want.doc_id, want.pos, want.nl_instructions)


def test_payload_is_never_broadcast(spark, sf_dir):
    from varietas.plans.queries import annotated, sentences
    for df in (sampling.sample_pairs(sentences(spark, sf_dir), 50, 1),
               sampling.sample_with_replacement(annotated(spark, sf_dir), 50, payload=("tokens", "tags"))):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        broadcast = [lines[i + 1] for i, line in enumerate(lines) if "BroadcastExchange" in line]
        assert broadcast
        assert not any(c in line for line in broadcast for c in ("nl_instructions", "tokens", "tags"))


def test_shuffle_gives_dense_places_in_key_order(spark):
    S = clean_and_standardize(corpus(spark, random_rows(13, 120)))
    out = sampling.shuffle_rows(S, 3)
    rows = out.collect()
    for g in {r.ds_name for r in rows}:
        mine = sorted((r for r in rows if r.ds_name == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [r.shuffle_key for r in mine] == sorted(r.shuffle_key for r in mine)
    # the rows come back in that order, partition after partition
    assert [(r.ds_name, r.position) for r in rows] == sorted((r.ds_name, r.position) for r in rows)
    assert {(r.ds_name, r.doc_id, r.pos, r.position) for r in rows} != \
        {(r.ds_name, r.doc_id, r.pos, r.position) for r in sampling.shuffle_rows(S, 4).collect()}


# ------------------------------------------------------------------ blocks
@pytest.mark.parametrize("by", [["ds_name"], []])
def test_blocks_cut_the_joined_corpus(spark, by):
    S = clean_and_standardize(corpus(spark, random_rows(14, 150)))
    got = {(r.ds_name if by else None, r.block): (r.n_texts, r.n_bytes, r.md5)
           for r in diversity.compression_blocks(S, by, block_bytes=64).collect()}
    want, texts = defaultdict(list), in_order(S, by)
    for g, mine in texts.items():
        at = 0
        for t in mine:
            want[g, at // 64].append(t)
            at += len(t) + 1
    assert got == {k: (len(v), len(" ".join(v)), hashlib.md5(" ".join(v).encode()).hexdigest())
                   for k, v in want.items()}
    ratio_rows = diversity.compression_ratio(S, by).collect()
    assert {r.ds_name if by else None: r.raw_bytes for r in ratio_rows} == \
        {g: len(" ".join(mine)) for g, mine in texts.items()}


# ---------------------------------------------------------------- patterns
def test_patterns_json_has_the_layout_of_an_indented_dump(spark):
    rows = [("d", "DT NN", "the bo\"x"), ("d", "DT NN", "a é"), ("d", "NN", "b\\c")]
    df = spark.createDataFrame(rows, "ds_name string, pattern string, text string")
    want = {"DT NN": ["a é", "the bo\"x"], "NN": ["b\\c"]}
    assert patterns.patterns_json(df).first().patterns_json == json.dumps(want, indent=4, ensure_ascii=False)


def test_patterns_of_a_sample_equal_a_plain_count(spark):
    S = clean_and_standardize(corpus(spark, random_rows(15, 60)))
    T = annotate.pos_tag(S)
    got = {(r.ds_name, r.pattern, r.text) for r in patterns.common_patterns(
        T, n=3, top_k=2, n_samples=40, batches=2, trials=2, seed=5).collect()}
    drawn = defaultdict(list)
    for r in sampling.sample_with_replacement(T, 20, 2, 2, 5, payload=("tokens", "tags")).collect():
        drawn[r.ds_name, r.trial, r.batch].append((r.sid, r.tokens, r.tags))
    want = set()
    for (ds, _, _), rows in drawn.items():
        tokens = [t for _, x, _ in sorted(rows) for t in x]
        tags = [t for _, _, x in sorted(rows) for t in x]
        grams = [(" ".join(tags[i:i + 3]), " ".join(tokens[i:i + 3])) for i in range(len(tags) - 2)]
        counts = Counter(p for p, _ in grams)
        top = sorted(counts, key=lambda p: (-counts[p], p))[:2]
        want |= {(ds, p, t) for p, t in grams if p in top}
    assert got == want


@pytest.mark.parametrize("limit", [0, 16_000, 64 << 20])
def test_only_drawn_sentences_are_tagged(spark, monkeypatch, limit):
    S = clean_and_standardize(corpus(spark, random_rows(16, 60)))
    kept = dict(n=3, top_k=2, n_samples=40, batches=2, trials=2, seed=5)
    want = {tuple(r) for r in patterns.common_patterns(annotate.pos_tag(S), **kept).collect()}
    drawn = sampling.sample_with_replacement(S, 20, 2, 2, 5).select("ds_name", "s_doc_id", "s_pos")
    drawn = {(r.ds_name, r.s_doc_id, r.s_pos) for r in drawn.collect()}
    monkeypatch.setattr(sampling, "BROADCAST_MAX_BYTES", limit)
    seen = []

    def tag(rows):
        seen.extend((r.ds_name, r.doc_id, r.pos) for r in rows.collect())
        return annotate.pos_tag(rows)

    assert {tuple(r) for r in patterns.common_patterns(S, tag=tag, **kept).collect()} == want
    assert len(seen) == len(drawn) < S.count() and set(seen) == drawn


# ------------------------------------------------------------------- trees
def test_hashes_follow_the_subtrees():
    tree = "(S (NP (DT the) (NN box)) (VP (VB move) (NP (DT the)  (NN box))))"
    tokens = trees.TREE_TOKEN.findall(tree)
    strings = [" ".join(tokens[a:b]) for a, b in trees.subtree_spans(tokens)]
    hashes = trees.subtree_hashes(tree)
    assert len(strings) == len(hashes) == 9
    assert len(set(hashes)) == len(set(strings))
    assert {s: h for s, h in zip(strings, hashes)} == {s: h for s, h in reversed(list(zip(strings, hashes)))}
    assert trees.subtree_hashes("(a (b c))") != trees.subtree_hashes("(a b (c))")
    assert trees.subtree_hashes("") == [] and trees.subtree_hashes("x ) (") == []
    deep = "(a " * 50_000 + ")" * 50_000
    assert len(trees.subtree_hashes(deep)) == 50_000


def test_kernel_shuffles_nothing(spark):
    pairs = spark.createDataFrame([(1, "(A b)", None), (2, None, None), (3, "(A b)", "(A b)")], "id int, q string, r string")
    df = trees.treekernel_pairs(pairs, "q", "r")
    assert {r.id: r.score for r in df.collect()} == {1: 0.0, 2: 0.0, 3: 50.0}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------ joins, report
def test_lookup_join_is_the_same_salted(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left"):
        a = joins.lookup_join(rows, table, ["k"], "i", how)
        b = joins.lookup_join(rows, table, ["k"], "i", how, max_bytes=0)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert joins.measured_bytes(spark.createDataFrame([("x" * 1000,)], "t string")) >= 1000


def test_learned_lexicon_has_one_tag_for_all_cases(spark):
    S = clean_and_standardize(corpus(spark, [("d", 1, "Box the box BOX")]))
    lexicon = spark.createDataFrame([("box", "VB", 2), ("Box", "NN", 3), ("BOX", "VB", 2)], "token string, tag string, n int")
    row = annotate.pos_tag(S, lexicon=lexicon).first()
    assert row.tokens == ["Box", "the", "box", "BOX"] and row.tags == ["VB", "DT", "VB", "VB"]


def test_report_rounds_values_once(spark):
    df = spark.createDataFrame([("a", 0.00805008602, 0.01424977773)], "ds_name string, v double, s double")
    line = report._rows(df, ["ds_name"], "jaccard", "v", "s").first().line
    assert line == "Average Jaccard pairwise distances: 0.0081. Stddev: 0.0142."


def test_report_names_the_estimate_and_holds_every_metric(spark):
    rows = [("d", i, f"pick the {w} block. place it on the table") for i, w in enumerate("red blue green".split() * 4)]
    S = clean_and_standardize(corpus(spark, rows))
    vectors = spark.createDataFrame([("d", 0, i, 0.5) for i in range(4)], "ds_name string, trial int, sid int, f1 double")
    out = report.build_report(S, report.ALL_METRICS, n_samples=20, scored_vectors=vectors).collect()
    assert sorted(r.metric for r in out) == sorted(report.LINES)
    lines = {r.metric: r.line for r in out}
    assert "estimated from drawn pairs" in lines["homogenization"]
    assert "over all pairs" in lines["homogenization_minhash"] and "Standard error" in lines["homogenization_minhash"]
    assert lines["bertscore"] == "Average bertscore pairwise scores: 0.5000. Stddev: 0.0000."
