"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads whole tables from ``sf_dir`` and
returns a DataFrame.  Doubles are rounded to 6 places and lists are joined
to strings only at this edge so results compare across engines.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.functions.text import clean_text, split_sentences, tokenize
from varietas.operators import clean, collocations, pairwise, sampling, stats
from varietas.session import ensure_checkpoint_dir
from varietas.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Pair-sampling protocol of the reference: 1000 pairs, 3 trials.
N_SAMPLES = 1000
TRIALS = 3
SEED = 0
LIST_SEP = " | "  # '|' is deleted by cleaning, so it never occurs inside a sentence


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: cleaned sentence table of ``documents`` (dataset = source)."""
    return clean.clean_and_standardize(corpus.documents_corpus(spark, sf_dir))


def multi_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S of ``documents`` plus all turns of ``conversations``."""
    return clean.clean_and_standardize(
        corpus.documents_corpus(spark, sf_dir).unionByName(
            corpus.conversations_corpus(spark, sf_dir)))


# ---------------------------------------------------------------- P: rows
@query("clean_and_standardize")
def q_clean_and_standardize(spark, sf_dir):
    return sentences(spark, sf_dir)


@query("clean_text")
def q_clean_text(spark, sf_dir):
    d = corpus.documents_corpus(spark, sf_dir)
    return d.select("ds_name", "doc_id", clean_text("nl_instructions").alias("cleaned"))


@query("split_sentences")
def q_split_sentences(spark, sf_dir):
    d = corpus.documents_corpus(spark, sf_dir)
    arr = split_sentences("nl_instructions")
    return d.select("ds_name", "doc_id", F.size(arr).alias("n_sentences"),
                    F.array_join(arr, LIST_SEP).alias("sentences"))


@query("explode_sentences")
def q_explode_sentences(spark, sf_dir):
    d = clean.split_column(corpus.conversations_corpus(spark, sf_dir))
    return clean.explode_sentences(d.drop("nl_instructions"))


@query("drop_blank")
def q_drop_blank(spark, sf_dir):
    d = clean.clean_column(corpus.conversations_corpus(spark, sf_dir))
    return clean.drop_blank(d)


@query("drop_na")
def q_drop_na(spark, sf_dir):
    d = clean.clean_column(corpus.documents_corpus(spark, sf_dir))
    return clean.drop_na(d)


@query("tokenize")
def q_tokenize(spark, sf_dir):
    s = sentences(spark, sf_dir)
    return s.select("ds_name", "doc_id", "pos",
                    F.posexplode(tokenize("nl_instructions")).alias("k", "token"))


@query("seq_len")
def q_seq_len(spark, sf_dir):
    return stats.with_seq_len(sentences(spark, sf_dir)).drop("nl_instructions")


# ---------------------------------------------------------------- A: stats
@query("total_instructions")
def q_total_instructions(spark, sf_dir):
    return stats.total_instructions(sentences(spark, sf_dir))


@query("unique_commands")
def q_unique_commands(spark, sf_dir):
    return stats.unique_commands(sentences(spark, sf_dir))


@query("nunique")
def q_nunique(spark, sf_dir):
    return stats.nunique(stats.with_seq_len(sentences(spark, sf_dir)), "seq_len")


@query("unique_unigrams")
def q_unique_unigrams(spark, sf_dir):
    return stats.unique_unigrams(sentences(spark, sf_dir))


@query("length_histogram")
def q_length_histogram(spark, sf_dir):
    return stats.length_histogram(stats.with_seq_len(sentences(spark, sf_dir)))


@query("length_histogram_summary")
def q_length_histogram_summary(spark, sf_dir):
    s = stats.with_seq_len(multi_sentences(spark, sf_dir))
    out = stats.length_histogram_summary(s, truncation_limit=30)
    return out.select("ds_name", "bin", r6("share"))


@query("word_frequency")
def q_word_frequency(spark, sf_dir):
    out = stats.word_frequency(sentences(spark, sf_dir), max_words=100)
    return out.select("ds_name", "word", "n", "rank", r6("rel"))


@query("bigram_frequency")
def q_bigram_frequency(spark, sf_dir):
    return stats.bigram_frequency(sentences(spark, sf_dir), top=100)


@query("collocations")
def q_collocations(spark, sf_dir):
    out = collocations.collocations(sentences(spark, sf_dir), max_words=100)
    return out.select("ds_name", "term", "n", "rank", r6("rel"), F.round("score", 3).alias("score"))


@query("collocations_all")
def q_collocations_all(spark, sf_dir):
    """Ungrouped: one word list over documents and conversations."""
    out = collocations.collocations(multi_sentences(spark, sf_dir), by=[], max_words=1000)
    return out.select("term", "n", "rank", r6("rel"), F.round("score", 3).alias("score"))


# ---------------------------------------------------------------- R: sampling
def _pairs(spark, sf_dir, distinct=False):
    return sampling.sample_pairs(sentences(spark, sf_dir), N_SAMPLES, TRIALS, SEED,
                                 distinct=distinct)


PAIR_KEYS = ["ds_name", "trial", "sid", "q_doc_id", "q_pos", "r_doc_id", "r_pos"]


@query("sample_pairs")
def q_sample_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*PAIR_KEYS, "q_idx", "r_idx",
                                        "q_nl_instructions", "r_nl_instructions")


@query("sample_pairs_all")
def q_sample_pairs_all(spark, sf_dir):
    """Ungrouped pairs over two datasets that use the same ids."""
    out = sampling.sample_pairs(multi_sentences(spark, sf_dir), N_SAMPLES, TRIALS, SEED, by=[])
    return out.select("trial", "sid", *[f"{s}_{c}" for s in ("q", "r") for c in (
        "ds_name", "doc_id", "pos", "idx", "nl_instructions")])


@query("shuffle")
def q_shuffle(spark, sf_dir):
    return sampling.shuffle_rows(sentences(spark, sf_dir), SEED)


@query("sample_with_replacement")
def q_sample_with_replacement(spark, sf_dir):
    out = sampling.sample_with_replacement(sentences(spark, sf_dir), 2500, trials=3,
                                           batches=4, seed=SEED)
    return out.select("ds_name", "trial", "batch", "sid", "s_idx", "s_doc_id", "s_pos",
                      "nl_instructions")


@query("trial_means")
def q_trial_means(spark, sf_dir):
    scored = pairwise.metric_pairs(sentences(spark, sf_dir), "jaccard", N_SAMPLES, TRIALS, SEED)
    return sampling.trial_means(scored).select("ds_name", "trial", r6("trial_mean"))


@query("trial_summary")
def q_trial_summary(spark, sf_dir):
    out = pairwise.pairwise_summaries(sentences(spark, sf_dir),
                                      ["bleu", "rouge_l", "rouge_1", "levenshtein", "jaccard"],
                                      N_SAMPLES, TRIALS, SEED)
    return out.select("ds_name", "metric", r6("avg"), r6("std"))


def _metric_queries(metric: str):
    def pairs_q(spark, sf_dir):
        out = pairwise.metric_pairs(sentences(spark, sf_dir), metric, N_SAMPLES, TRIALS, SEED)
        return out.select(*PAIR_KEYS, r6("score"))

    def summary_q(spark, sf_dir):
        out = pairwise.pairwise_summary(sentences(spark, sf_dir), metric, N_SAMPLES, TRIALS, SEED)
        return out.select("ds_name", r6("avg"), r6("std"))

    QUERIES[f"{metric}_pairs"] = pairs_q
    QUERIES[f"{metric}_summary"] = summary_q


for _m in ("bleu", "rouge_l", "rouge_1", "levenshtein", "jaccard"):
    _metric_queries(_m)


# ---------------------------------------------------------------- D: diversity
from varietas.operators import diversity  # noqa: E402


@query("ngram_diversity")
def q_ngram_diversity(spark, sf_dir):
    out = diversity.ngram_diversity(sentences(spark, sf_dir), n=4)
    return out.select("ds_name", r6("ngram_diversity"), "n_tokens")


@query("ngram_diversity_all")
def q_ngram_diversity_all(spark, sf_dir):
    out = diversity.ngram_diversity(multi_sentences(spark, sf_dir), n=4, by=[])
    return out.select(r6("ngram_diversity"), "n_tokens")


@query("compression_blocks")
def q_compression_blocks(spark, sf_dir):
    return diversity.compression_blocks(sentences(spark, sf_dir), block_bytes=1 << 14)


@query("compression_blocks_all")
def q_compression_blocks_all(spark, sf_dir):
    return diversity.compression_blocks(multi_sentences(spark, sf_dir), by=[])


@query("compression_ratio_all")
def q_compression_ratio_all(spark, sf_dir):
    out = diversity.compression_ratio(multi_sentences(spark, sf_dir), by=[])
    return out.select("raw_bytes", "gz_bytes", "n_blocks", r6("compression_ratio"))


@query("compression_ratio")
def q_compression_ratio(spark, sf_dir):
    out = diversity.compression_ratio(sentences(spark, sf_dir))
    return out.select("ds_name", "raw_bytes", "gz_bytes", "n_blocks", r6("compression_ratio"))


def _homogenization(measure):
    def q(spark, sf_dir):
        out = diversity.homogenization(sentences(spark, sf_dir), measure, N_SAMPLES, TRIALS, SEED)
        return out.select("ds_name", r6("homogenization"), r6("std"))
    return q


QUERIES["homogenization_rougel"] = _homogenization("rouge_l")
QUERIES["homogenization_jaccard"] = _homogenization("jaccard")


def _homogenization_estimate(measure):
    def q(spark, sf_dir):
        out = diversity.homogenization_estimate(sentences(spark, sf_dir), measure, N_SAMPLES, TRIALS, SEED)
        return out.select("ds_name", "n_rows", "n_pairs", r6("estimate"), r6("std_error"))
    return q


QUERIES["homogenization_rougel_estimate"] = _homogenization_estimate("rouge_l")
QUERIES["homogenization_jaccard_estimate"] = _homogenization_estimate("jaccard")


@query("homogenization_minhash")
def q_homogenization_minhash(spark, sf_dir):
    out = diversity.homogenization_minhash(sentences(spark, sf_dir))
    return out.select("ds_name", "n_rows", "n_pairs", r6("homogenization"), r6("std_error"))


@query("homogenization_cosine")
def q_homogenization_cosine(spark, sf_dir):
    out = diversity.homogenization_cosine(sentences(spark, sf_dir))
    return out.select("ds_name", "n_rows", "n_pairs", r6("homogenization"))


# ---------------------------------------------------------------- N: annotation
from varietas.operators import annotate  # noqa: E402

SKEYS = ["ds_name", "doc_id", "pos"]


def annotated(spark, sf_dir):
    return annotate.pos_tag(sentences(spark, sf_dir))


@query("pos_tag")
def q_pos_tag(spark, sf_dir):
    return annotate.tagged_tokens(annotated(spark, sf_dir))


@query("pos_tag_learned")
def q_pos_tag_learned(spark, sf_dir):
    """Conversations tagged with the lexicon that documents teach."""
    lexicon = annotate.learn_lexicon(annotate.tagged_tokens(annotated(spark, sf_dir).drop("upos")))
    S = clean.clean_and_standardize(corpus.conversations_corpus(spark, sf_dir))
    return annotate.tagged_tokens(annotate.pos_tag(S, lexicon=lexicon))


@query("learn_lexicon")
def q_learn_lexicon(spark, sf_dir):
    return annotate.learn_lexicon(annotate.tagged_tokens(annotated(spark, sf_dir).drop("upos")))


@query("extract_nouns")
def q_extract_nouns(spark, sf_dir):
    T = annotated(spark, sf_dir)
    n = annotate.select_by_upos(F.col("tokens"), F.col("upos"), "NOUN")
    return T.select(*SKEYS, F.array_join(n, " ").alias("nouns"), F.size(n).alias("n_nouns"))


@query("extract_verbs")
def q_extract_verbs(spark, sf_dir):
    T = annotated(spark, sf_dir)
    v = annotate.select_by_upos(F.col("tokens"), F.col("upos"), "VERB")
    return T.select(*SKEYS, F.array_join(v, " ").alias("verbs"), F.size(v).alias("n_verbs"))


def _upos_frequency(spark, sf_dir, upos):
    T = annotated(spark, sf_dir)
    words = T.select("ds_name", annotate.select_by_upos(F.col("tokens"), F.col("upos"), upos).alias("words"))
    return stats.word_frequency(words, "words", max_words=100) \
        .select("ds_name", "word", "n", "rank", r6("rel"))


@query("noun_frequency")
def q_noun_frequency(spark, sf_dir):
    return _upos_frequency(spark, sf_dir, "NOUN")


@query("verb_frequency")
def q_verb_frequency(spark, sf_dir):
    return _upos_frequency(spark, sf_dir, "VERB")


@query("add_features")
def q_add_features(spark, sf_dir):
    out = annotate.add_features(sentences(spark, sf_dir))
    return out.select(*SKEYS, "nl_instructions", "spacy_parse",
                      F.array_join("nouns", " ").alias("nouns"),
                      F.array_join("verbs", " ").alias("verbs"), "seq_len")


@query("tag_vocabulary")
def q_tag_vocabulary(spark, sf_dir):
    return annotate.tag_vocabulary(annotated(spark, sf_dir))


def dependencies(spark, sf_dir):
    T = annotated(spark, sf_dir)
    return T.select(*SKEYS, "nl_instructions",
                    annotate.dependency_struct(F.col("tokens"), F.col("tags")).alias("dep"))


def dep_parses(spark, sf_dir):
    D = dependencies(spark, sf_dir)
    return D.select(*SKEYS, "nl_instructions", annotate.dep_tree_string(F.col("dep")).alias("dep_parse_tree"))


@query("dep_tree_string")
def q_dep_tree_string(spark, sf_dir):
    return dep_parses(spark, sf_dir).drop("nl_instructions")


@query("dep_vocabulary")
def q_dep_vocabulary(spark, sf_dir):
    D = dependencies(spark, sf_dir).select(F.transform("dep.tokens", lambda t: t["dep"]).alias("labels"))
    return annotate.tag_vocabulary(D, "labels").withColumnRenamed("tag", "label")


@query("common_dep_parses")
def q_common_dep_parses(spark, sf_dir):
    return stats.common_parses(dep_parses(spark, sf_dir), "dep_parse_tree", "nl_instructions", k=25)


@query("dep_parse_histogram")
def q_dep_parse_histogram(spark, sf_dir):
    codes = stats.value_codes(dep_parses(spark, sf_dir), "dep_parse_tree", ["doc_id", "pos"],
                              extra_aggs=[F.count(F.lit(1)).alias("n")], keep_value=False)
    return codes.select("ds_name", "code", "n")


@query("shallow_tree")
def q_shallow_tree(spark, sf_dir):
    T = annotated(spark, sf_dir)
    return T.select(*SKEYS, annotate.shallow_tree(F.col("tokens"), F.col("tags"))
                    .alias("constituency_parse_tree"))


# ------------------------------------------------- A8: common parses (tag sequences)
def parses(spark, sf_dir):
    T = annotated(spark, sf_dir)
    return T.select(*SKEYS, "nl_instructions", F.array_join("tags", " ").alias("parse"))


@query("dictionary_encode")
def q_dictionary_encode(spark, sf_dir):
    return stats.dictionary_encode(parses(spark, sf_dir), "parse", ["doc_id", "pos"]) \
        .select(*SKEYS, "parse", "code")


@query("top_parses")
def q_top_parses(spark, sf_dir):
    return stats.top_values(parses(spark, sf_dir), "parse", k=25)


@query("top_parse_exemplar")
def q_top_parse_exemplar(spark, sf_dir):
    return stats.top_values(parses(spark, sf_dir), "parse", k=25,
                            exemplar_col="nl_instructions")


@query("parse_histogram")
def q_parse_histogram(spark, sf_dir):
    enc = stats.dictionary_encode(parses(spark, sf_dir), "parse", ["doc_id", "pos"])
    return stats.value_counts(enc, "code")


@query("common_parses")
def q_common_parses(spark, sf_dir):
    return stats.common_parses(parses(spark, sf_dir), "parse", "nl_instructions", k=25)


# ---------------------------------------------------------------- D4/D5: patterns, maps
from varietas.operators import patterns  # noqa: E402


@query("common_patterns")
def q_common_patterns(spark, sf_dir):
    return patterns.common_patterns(sentences(spark, sf_dir), n=4, top_k=5, n_samples=10000,
                                    batches=4, trials=3, seed=SEED, tag=annotate.pos_tag)


@query("common_patterns_full")
def q_common_patterns_full(spark, sf_dir):
    return patterns.common_patterns_full(annotated(spark, sf_dir), n=4, top_k=5)


@query("patterns_json")
def q_patterns_json(spark, sf_dir):
    return patterns.patterns_json(q_common_patterns(spark, sf_dir))


@query("merge_maps")
def q_merge_maps(spark, sf_dir):
    ev = corpus.read_table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,int>")
    return patterns.merge_maps(ev.select("event_type", m.alias("props")), "props", ["event_type"])


@query("flatten_nested")
def q_flatten_nested(spark, sf_dir):
    d = corpus.documents_corpus(spark, sf_dir)
    nested = F.transform(split_sentences("nl_instructions"), lambda s: tokenize(s))
    flat = patterns.flatten_nested(nested, 2)
    return d.select("ds_name", "doc_id", F.size(flat).alias("n_tokens"),
                    F.array_join(flat, " ").alias("tokens"))


# ---------------------------------------------------------------- M7 / M5: trees, vectors
from varietas.operators import embeddings, trees  # noqa: E402

TREE = "constituency_parse_tree"
ITEM_SIZE = 8  # token vectors per item: vec_id div 8 (bounded items)


def tree_table(spark, sf_dir):
    T = annotated(spark, sf_dir)
    return T.select(*SKEYS, annotate.shallow_tree(F.col("tokens"), F.col("tags")).alias(TREE))


@query("subtrees")
def q_subtrees(spark, sf_dir):
    return trees.subtrees(tree_table(spark, sf_dir), TREE, SKEYS)


def _tree_pairs(spark, sf_dir):
    # draw from the plain sentence table and parse only the drawn sentences:
    # the draws are the same (same keys, same order) as drawing from the
    # tree table, but tagging/bracketing runs on the sample, not the corpus
    pairs = sampling.sample_pairs(sentences(spark, sf_dir), N_SAMPLES, TRIALS, SEED)
    pairs = pairs.select(*PAIR_KEYS, *[annotate.shallow_tree_of_text(F.col(f"{s}_nl_instructions"))
                                       .alias(f"{s}_{TREE}") for s in ("q", "r")])
    return trees.treekernel_pairs(pairs, f"q_{TREE}", f"r_{TREE}")


@query("treekernel_pairs")
def q_treekernel_pairs(spark, sf_dir):
    return _tree_pairs(spark, sf_dir).select(*PAIR_KEYS, r6("score"))


@query("treekernel_summary")
def q_treekernel_summary(spark, sf_dir):
    return trees.treekernel_summary(_tree_pairs(spark, sf_dir), ["ds_name"]) \
        .select("ds_name", r6("avg"), r6("std"))


def _vector_pairs(spark, sf_dir):
    emb = corpus.read_table(spark, sf_dir, "embeddings")
    item = (F.col("vec_id") / ITEM_SIZE).cast("bigint")
    items = emb.select(F.lit("embeddings").alias("ds_name"), item.alias("doc_id"),
                       F.lit(0).alias("pos")).distinct()
    pairs = sampling.sample_pairs(items, N_SAMPLES, TRIALS, SEED, payload=())
    vecs = emb.select(item.alias("item"), "vec_id", "embedding")
    return embeddings.greedy_match_pairs(pairs, vecs, ["ds_name", "trial", "sid"],
                                         "q_doc_id", "r_doc_id")


@query("bertscore_pairs")
def q_bertscore_pairs(spark, sf_dir):
    return _vector_pairs(spark, sf_dir).select("ds_name", "trial", "sid", "q_doc_id", "r_doc_id",
                                               r6("precision"), r6("recall"), r6("f1"))


@query("bertscore_summary")
def q_bertscore_summary(spark, sf_dir):
    scored = _vector_pairs(spark, sf_dir).withColumnRenamed("f1", "score")
    return sampling.trial_summary(sampling.trial_means(scored)).select("ds_name", r6("avg"), r6("std"))


# ---------------------------------------------------------------- S / J: io and jobs
from varietas.plans import features as feature_job  # noqa: E402
from varietas.plans import report as report_job  # noqa: E402
from varietas.sources import io as vio  # noqa: E402


@query("scan_corpus")
def q_scan_corpus(spark, sf_dir):
    d = vio.read_corpus(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return d.select(F.col("source").alias("ds_name"), "doc_id", F.col("text").alias("nl_instructions"))


@query("read_catalog")
def q_read_catalog(spark, sf_dir):
    """Datasets of a catalogue that is written beside the checkpoints."""
    folder = f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    entries = {"documents": "documents.parquet", "items": "benchmark.parquet", "unused": "part.parquet"}
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(folder)
    d = vio.read_catalog(spark, folder, sf_dir, ["documents", "items"], fmt="parquet")
    return d.select("ds_name", F.coalesce("doc_id", "item_id").alias("doc_id"), F.col("text").alias("nl_instructions"))


@query("features_written")
def q_features_written(spark, sf_dir):
    """The feature table as it is read back from its files."""
    folder = f"{ensure_checkpoint_dir(spark)}/features-{uuid.uuid4().hex}"
    vio.write_features(feature_job.build_features(corpus.documents_corpus(spark, sf_dir)), folder)
    return vio.read_corpus(spark, folder).select(
        *SKEYS, "nl_instructions", "spacy_parse", F.array_join("nouns", " ").alias("nouns"),
        F.array_join("verbs", " ").alias("verbs"), "seq_len", "constituency_parse_tree")


@query("ds_name_from_path")
def q_ds_name_from_path(spark, sf_dir):
    pages = corpus.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url",
                        vio.ds_name_from_path("url", r"^[a-z]+://([^/?#]+)").alias("ds_name"))


@query("feature_table")
def q_feature_table(spark, sf_dir):
    out = feature_job.build_features(corpus.documents_corpus(spark, sf_dir))
    return out.select(*SKEYS, "nl_instructions", "spacy_parse",
                      F.array_join("nouns", " ").alias("nouns"),
                      F.array_join("verbs", " ").alias("verbs"), "seq_len",
                      "constituency_parse_tree")


@query("report")
def q_report(spark, sf_dir):
    return report_job.build_report(sentences(spark, sf_dir), report_job.SQL_METRICS,
                                   n_samples=N_SAMPLES, trials=TRIALS, seed=SEED)


@query("report_full")
def q_report_full(spark, sf_dir):
    return report_job.build_report(sentences(spark, sf_dir), report_job.ALL_METRICS,
                                   n_samples=N_SAMPLES, trials=TRIALS, seed=SEED,
                                   scored_vectors=_vector_pairs(spark, sf_dir))
