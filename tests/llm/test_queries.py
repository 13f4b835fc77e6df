"""The registered queries against their SQL, and the pipeline's stages."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varietas.llm import queries
from varietas.llm.common import table

TABLES = ("documents", "benchmark", "labels", "conversations", "embeddings")


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    out = queries.QUERIES[name](spark, sf_dir)
    assert sorted(out.columns) == sorted(columns)
    assert sorted_rows(out.columns, [tuple(r) for r in out.collect()]) == sorted_rows(columns, result.fetchall())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def test_one_document_of_each_near_group_stays(spark, documents):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    near = base[:79] + ["changed"]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (4, " ".join(base[::-1])), (1, None),
            (2, ""), (6, ""), (7, "twice here"), (7, "twice here")]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) > 70
    kept = corpus_pipeline.near_duplicate_stage(spark, documents(rows), "")
    assert kept.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_pipeline_stages_take_effect_in_order(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join",
                     "benchmark decontamination", "packing"]
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        if name != "packing":
            assert docs.columns == columns
            assert docs.count() <= before
            before = docs.count()
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            sets = [s for s in (shingles(r["text"]) for r in docs.select("text").collect()) if s]
            assert not any(100 * len(a & b) >= 80 * len(a | b)
                           for i, a in enumerate(sets) for b in sets[:i])
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    # which sequence holds a piece depends on the partitions; what is packed does not
    def packed(df):
        return sorted((r["doc_id"], r["doc_tokens"], r["n"]) for r in df.groupBy(
            "doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect())

    assert packed(corpus_pipeline.run(spark, sf_dir)) == packed(docs)
    assert all(r[1] == r[2] for r in packed(docs))


def test_line_stage_keeps_clashing_columns_and_drops_emptied_documents(spark, documents):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, passage + "\nown line"), (3, passage), (4, None), (5, ""), (6, "own\n\nother")]
    docs = documents(rows).withColumn("_removed", F.lit("mine")).withColumn("_LINES", F.lit("too")) \
        .withColumn("n_chars", F.length("text").cast("bigint"))
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in got.items()} == {
        1: (passage, len(passage)), 2: ("own line", 8), 4: (None, None), 5: ("", 0), 6: ("own\n\nother", 10)}
    assert all(r["_removed"] == "mine" and r["_LINES"] == "too" for r in got.values())
