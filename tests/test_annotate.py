"""Tagger, features, shallow trees and dependency strings."""

from pyspark.sql import functions as F

from varietas.operators.annotate import (dep_tree_string, dependency_struct, pos_tag,
                                         select_by_upos, shallow_tree)

N8_TOKENS = "lift the pink block the box and red and old wooden drawer handle fast".split()
N8_TAGS = "VB DT JJ NN DT NN CC JJ CC JJ JJ NN NN JJ".split()
N8_TREE = ("(S (VB lift) (NP (DT the) (JJ pink) (NN block)) (NP (DT the) (NN box)) (CC and) "
           "(JJ red) (CC and) (NP (JJ old) (JJ wooden) (NN drawer) (NN handle)) (JJ fast))")


def test_shallow_tree_fixture(spark):
    df = spark.createDataFrame([(N8_TOKENS, N8_TAGS)], "tokens array<string>, tags array<string>")
    assert df.select(shallow_tree(F.col("tokens"), F.col("tags")).alias("t")).first().t == N8_TREE


def test_shallow_tree_empty(spark):
    df = spark.createDataFrame([([], [])], "tokens array<string>, tags array<string>")
    assert df.select(shallow_tree(F.col("tokens"), F.col("tags")).alias("t")).first().t == "(S )"


def test_dep_tree_string_fixture(spark):
    df = spark.createDataFrame([([("move", "ROOT"), ("box", "det")],)],
                               "d array<struct<head:string, dep:string>>")
    got = df.select(dep_tree_string(F.struct(F.col("d").alias("tokens"))).alias("s")).first().s
    assert got == "head: move dep: ROOT; head: box dep: det"


def test_tagger_and_features(spark):
    S = spark.createDataFrame([("d", 1, 0, "Pick up the pink blocks and place them quickly"),
                               ("d", 1, 1, "I want to stack 3 boxes on Mary"),
                               ("d", 1, 2, "is the box running")],
                              "ds_name string, doc_id long, pos int, nl_instructions string")
    rows = pos_tag(S).orderBy("pos").collect()
    assert rows[0].tags == ["VB", "RB", "DT", "JJ", "NNS", "CC", "VB", "PRP", "RB"]
    assert rows[1].tags == ["PRP", "NN", "TO", "VB", "CD", "NNS", "IN", "NNP"]
    assert rows[2].upos == ["AUX", "DET", "NOUN", "VERB"]
    T = pos_tag(S).select("pos", select_by_upos(F.col("tokens"), F.col("upos"), "NOUN").alias("n"),
                          select_by_upos(F.col("tokens"), F.col("upos"), "VERB").alias("v"))
    got = {r.pos: (r.n, r.v) for r in T.collect()}
    assert got[0] == (["blocks"], ["Pick", "place"])
    assert got[1] == (["want", "boxes"], ["stack"])


def test_dependency_struct(spark):
    df = spark.createDataFrame([(["move", "the", "red", "box"], ["VB", "DT", "JJ", "NN"])],
                               "tokens array<string>, tags array<string>")
    s = df.select(dep_tree_string(dependency_struct(F.col("tokens"), F.col("tags"))).alias("s")).first().s
    assert s == "head: move dep: ROOT; head: box dep: det; head: box dep: amod; head: move dep: obj"
