"""The feature job over a file stream gives the same rows as the batch job."""

import tempfile

from varietas.plans.features import build_features
from varietas.sources import corpus
from varietas.streaming.features import stream_features


def test_stream_matches_batch(spark, sf_dir):
    sink = tempfile.mkdtemp(prefix="varietas-sink-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="varietas-sckpt-", dir="/tmp")
    q = stream_features(spark, sf_dir, sink, glob="documents.parquet", checkpoint_dir=ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = build_features(corpus.documents_corpus(spark, sf_dir))
    cols = ["ds_name", "doc_id", "pos", "nl_instructions", "seq_len", "constituency_parse_tree"]
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_restart_goes_on_where_it_stopped(spark, sf_dir):
    sink = tempfile.mkdtemp(prefix="varietas-sink-", dir="/tmp")
    counts = []
    for _ in range(2):
        stream_features(spark, sf_dir, sink, glob="documents.parquet").awaitTermination(300)
        counts.append(spark.read.parquet(sink).count())
    assert counts[0] == counts[1] > 0
