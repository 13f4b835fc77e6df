"""Sources and sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from varietas.plans.features import build_features
from varietas.plans.report import build_report
from varietas.sources import corpus, io as vio


def _tmp():
    return tempfile.mkdtemp(prefix="varietas-io-", dir="/tmp")


def test_csv_catalog_and_ds_name(spark):
    d = _tmp()
    os.makedirs(f"{d}/a"); os.makedirs(f"{d}/b")
    with open(f"{d}/a/a.csv", "w") as f:
        f.write('nl_instructions,extra\n"pick up the block. place it",1\n"multi\nline, quoted ""x""",2\n')
    with open(f"{d}/b/b.csv", "w") as f:
        f.write("nl_instructions,extra\nopen drawer,3\n")
    with open(f"{d}/metadata.json", "w") as f:
        json.dump({"alpha": "a/a.csv", "beta": "b/b.csv", "gamma": "c/c.csv"}, f)
    df = vio.read_catalog(spark, f"{d}/metadata.json", base_dir=d, names=["alpha", "beta"],
                          schema="nl_instructions string, extra int", multi_line=True)
    got = sorted((r.ds_name, r.nl_instructions) for r in df.collect())
    assert got == [("alpha", 'multi\nline, quoted "x"'), ("alpha", "pick up the block. place it"),
                   ("beta", "open drawer")]


def test_catalog_of_folders_blanks_and_globs(spark):
    d = _tmp()
    for name in ("folder", "with blank", "parts"):
        os.makedirs(f"{d}/{name}")
    for i, path in enumerate(["folder/x.csv", "folder/y.csv", "with blank/my file.csv", "parts/p1.csv",
                              "parts/p2.csv", "parts/q.csv"]):
        with open(f"{d}/{path}", "w") as f:
            f.write(f"nl_instructions\ntext {i}\n")
    entries = {"all": "folder", "blank": "with blank/my file.csv", "some": "parts/p*.csv", "none": "parts/z*.csv"}
    with open(f"{d}/catalogue.json", "w") as f:
        json.dump(entries, f)
    df = vio.read_catalog(spark, f"{d}/catalogue.json", d, ["all", "blank", "some"], schema="nl_instructions string")
    assert sorted((r.ds_name, r.nl_instructions) for r in df.collect()) == [
        ("all", "text 0"), ("all", "text 1"), ("blank", "text 2"), ("some", "text 3"), ("some", "text 4")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        vio.read_catalog(spark, f"{d}/catalogue.json", d, ["none"])
    with pytest.raises(ValueError, match="not in the catalogue: other"):
        vio.read_catalog(spark, f"{d}/catalogue.json", d, ["all", "other"])


def test_large_csv_is_split_unless_lines_are_joined(spark):
    d = _tmp()
    with open(f"{d}/big.csv", "w") as f:
        f.write("nl_instructions\n" + "".join(f"row {i} of the file\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = vio.read_corpus(spark, f"{d}/big.csv", "csv")
        whole = vio.read_corpus(spark, f"{d}/big.csv", "csv", multi_line=True)
        assert split.count() == whole.count() == 20000
        assert split.rdd.getNumPartitions() > 1 == whole.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ds_name_from_path(spark):
    df = spark.createDataFrame([("x/results/rt1/rt1_results.csv",)], "p string")
    assert df.select(vio.ds_name_from_path("p").alias("n")).first().n == "rt1"
    bad = spark.createDataFrame([("nowhere.csv",)], "p string")
    with pytest.raises(Exception):
        bad.select(vio.ds_name_from_path("p")).collect()
    assert bad.select(vio.ds_name_from_path("p", fail=False).alias("n")).first().n is None


def test_write_features_roundtrip(spark, sf_dir):
    feats = build_features(corpus.documents_corpus(spark, sf_dir))
    d = _tmp()
    vio.write_features(feats, f"{d}/pq")
    back = spark.read.parquet(f"{d}/pq")
    assert back.count() == feats.count()
    assert dict(back.dtypes)["nouns"] == "array<string>"
    vio.write_features(feats, f"{d}/csv", fmt="csv")
    csv = vio.read_corpus(spark, f"{d}/csv", fmt="csv")
    first = csv.filter(F.col("nouns") != "[]").select("nouns").first().nouns
    assert json.loads(first)


def test_report_writer(spark, sf_dir):
    S = corpus.documents_corpus(spark, sf_dir)
    from varietas.operators.clean import clean_and_standardize
    rep = build_report(clean_and_standardize(S), ["unique_commands", "ngram_diversity"],
                       n_samples=50, trials=2)
    d = _tmp()
    vio.write_report(rep, d)
    lines = spark.read.text(f"{d}/text").collect()
    assert len(lines) == rep.count() > 0
    assert any(line.value.startswith("Number of unique commands in dataset: ") for line in lines)
    assert {line.ds_name for line in lines} == {r.ds_name for r in rep.collect()}
    assert build_report(S, []) is None
