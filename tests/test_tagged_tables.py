"""Steps behind the tag, tree and parse queries, on rows of their own."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from varietas.operators import annotate, stats, trees
from varietas.plans import queries
from varietas.sources import corpus

ROWS = [("x", 1, "To lift the Old box's lid, the BOX'S 123 ٣٣ 9lives glass boxes. Must lamp it!"),
        ("x", 1, "To lift the Old box's lid, the BOX'S 123 ٣٣ 9lives glass boxes. Must lamp it!"),
        ("x", 2, "Pick up the lamp. Pick up the lamp. Ünder's _a ǅabc Étagère"), ("y", 1, "Pick up the lamp."),
        ("y", None, "Pick up the lamp."), ("y", 3, None), (None, 4, "Pick it up.")]


def table(spark):
    return spark.createDataFrame(ROWS, "ds_name string, doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_a_batch_are_those_of_each_tree():
    draw = random.Random(3)
    for _ in range(300):
        batch = [None if draw.random() < .1 else "".join(draw.choices(["(", ")", " ", "a", "é b", "\x1c", "　"], k=draw.randint(0, 14)))
                 for _ in range(draw.randint(0, 6))]
        words = [trees.TREE_TOKEN.findall(t or "") for t in batch]
        assert trees._cut_all(batch).to_pylist() == [
            [" ".join(w[a:b]) for a, b in trees.subtree_spans(w)] for w in words]


def test_words_keep_their_rules(spark):
    out = stats.word_tokens(table(spark), "text", ["ds_name"])
    assert plan(out).count("RLIKE") == 1 and "EndsWith(lower(" not in plan(out)
    found = Counter()
    for ds, _, text in ROWS:
        for w in re.findall(r"\w[\w']+", text or ""):
            w = w[:-2] if w.lower().endswith("'s") else w
            if not re.fullmatch(r"\d+", w) and w.lower() not in stats.STOPWORDS:
                found[ds, w] += 1
    assert Counter(map(tuple, out.collect())) == found and ("x", "9lives") in found


def test_chosen_words_without_a_second_array(spark):
    T = annotate.pos_tag(table(spark), "text")
    out = T.select("tokens", "upos", annotate.select_by_upos(F.col("tokens"), F.col("upos"), "NOUN").alias("n"))
    assert "arrays_zip" not in plan(out)
    for r in out.collect():
        assert r.n == (r.tokens and [t for t, u in zip(r.tokens, r.upos) if u == "NOUN"])


def test_lexicon_is_learned_without_universal_tags(spark, monkeypatch):
    monkeypatch.setattr(corpus, "read_table", lambda spark, *_: table(spark).withColumnRenamed("ds_name", "source"))
    out = queries.QUERIES["learn_lexicon"](spark, "")
    assert "_tags_of" in plan(out) and "_upos_of" not in plan(out)
    assert queries.QUERIES["pos_tag"](spark, "").columns == ["ds_name", "doc_id", "pos", "k", "token", "tag", "upos"]
    tokens = Counter((r.token.lower(), r.tag) for r in queries.QUERIES["pos_tag"](spark, "").collect())
    best = {w: min((-n, t) for (v, t), n in tokens.items() if v == w) for w, _ in tokens}
    assert {r.token: (-r.n, r.tag) for r in out.collect()} == best


def test_parses_stay_behind_when_places_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(corpus, "read_table", lambda spark, *_: table(spark).withColumnRenamed("ds_name", "source"))
    ordered, index = [], stats.dense_index
    monkeypatch.setattr(stats, "dense_index", lambda df, *a, **k: ordered.append(df.columns) or index(df, *a, **k))
    parses = queries.parses(spark, "").collect()
    got = {(r.ds_name, r.parse): r for r in queries.QUERIES["common_parses"](spark, "").collect()}
    histogram = queries.QUERIES["dep_parse_histogram"](spark, "").collect()
    assert ordered and not any({"parse", "exemplar", "dep_parse_tree"} & set(c) for c in ordered)
    for ds in ("x", "y"):
        mine = [r for r in parses if r.ds_name == ds]
        n = Counter(r.parse for r in mine)
        first = {p: min((r.doc_id is not None, r.doc_id or 0, r.pos) for r in mine if r.parse == p) for p in n}
        assert {p: (r.n, r["rank"], r.code) for (d, p), r in got.items() if d == ds} == {
            p: (n[p], 1 + sorted(n, key=lambda q: (-n[q], q)).index(p), sorted(n, key=first.get).index(p)) for p in n}
        assert all(got[ds, p].exemplar in {r.nl_instructions for r in mine if r.parse == p} for p in n)
    # a null dataset has no codes
    assert len(got) == len({(r.ds_name, r.parse) for r in parses if r.ds_name is not None})
    trees_ = Counter((r.ds_name, r.dep_parse_tree) for r in queries.dep_parses(spark, "").collect() if r.ds_name is not None)
    assert Counter((r.ds_name, r.n) for r in histogram) == Counter((d, n) for (d, _), n in trees_.items())
