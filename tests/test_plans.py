"""Plan shape: row-scale operators never funnel the corpus into one task."""

from varietas.operators import diversity, sampling
from varietas.operators.clean import clean_and_standardize
from varietas.sources import corpus


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_exchange_over_rows(spark, sf_dir):
    S = clean_and_standardize(corpus.documents_corpus(spark, sf_dir))
    for df in (sampling.sample_pairs(S, 20, 1), diversity.ngram_diversity(S, 4)):
        plan = _plan(df)
        assert "SinglePartition" not in plan, plan


def test_scan_prunes_columns(spark, sf_dir):
    S = clean_and_standardize(corpus.documents_corpus(spark, sf_dir))
    plan = _plan(S.select("ds_name", "doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan or \
        "lang" not in plan.split("ReadSchema")[1].split("\n")[0]
