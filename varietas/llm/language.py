"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language:

* text: naive Bayes over hashed byte trigrams of the visible text, counted
  over all documents whose language is known, smoothed, and tempered to
  ``TEMPER`` of its length since neighbouring trigrams are not independent;
* markup: the ``lang`` attribute of ``<html>``;
* address: the host's suffix, and a language code as first path segment;
* host: the share of languages on the host.

The likelihood of a declaration given the language, and the host prior, are
not assumed but counted by grouped aggregation over all pages, with the text's
posterior as soft count.  The host prior is smoothed through a hierarchy: all
pages, suffix, domain (the host's last two labels, also under ``co.uk`` and
the like), host; each level adds ``KAPPA`` pages' worth of its parent.  A page
is left out of its own prior's counts, so its text does not count twice.  A
host with any share of the pages is a pre-aggregated key, and the pages meet
the hosts' counts in a join that salts the hosts.

Defined results: a page without text, markup or usable address has the prior
of what is known of it; null or malformed html or url count as missing; a
page of any length is read whole; repeated rows have a row each; with no
documents of known language the result is empty, as is that of an empty table.
Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import chunks, ship_by_value, small_batches, table, written

BUCKETS, TEMPER, KAPPA, MOST_LANGUAGES = 1 << 16, 0.05, 5.0, 256
SALTS = 16
GATHERED = 1 << 18  # trigram probabilities looked up at once
MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
HTML_TAG = re.compile(rb"(?i)<html\b[^>]*")
LANG = re.compile(rb"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})")


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, ASCII letters lowered."""
    a = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    h = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's documents, by language."""
    total: dict[str, np.ndarray] = {}
    for batch, texts in chunks(batches, "text"):
        grams: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            grams.setdefault(lang, []).append(trigrams(text))
        for lang, own in grams.items():
            n = np.bincount(np.concatenate(own), minlength=BUCKETS)
            total[lang] = total[lang] + n if lang in total else n
    for lang, n in total.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(used), pa.string()),
            "bucket": pa.array(used, pa.int32()), "n": pa.array(n[used], pa.int64())})


def text_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, a table of at most
    ``MOST_LANGUAGES`` x ``BUCKETS``, from all documents."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(counted, "lang string, bucket int, n bigint") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MOST_LANGUAGES} are expected")
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    n = np.full((len(langs), BUCKETS), 0.5)
    if langs:
        n[place[np.asarray(names.indices)], np.asarray(counts["bucket"])] += np.asarray(counts["n"])
    return langs, np.log(n / n.sum(axis=1, keepdims=True)) if langs else n


def visible(html: bytes) -> bytes:
    return MARKUP.sub(b" ", html)


def declared_of(html: bytes) -> str:
    """The primary code of the ``lang`` attribute of ``<html>``, or nothing."""
    tag = HTML_TAG.search(html)
    found = LANG.search(tag[0]) if tag else None
    return found[1].decode().lower() if found else ""


def likelihoods(log_p: np.ndarray, temper: float):
    """Declared language of a page, and the tempered log likelihood of each
    language for its text."""
    step = max(1, GATHERED // len(log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in chunks(batches, "html"):
            others = [c for c in batch.schema.names if c != "html"]
            out = []
            for html in pages:
                g = trigrams(visible(html))
                parts = [log_p[:, g[a:a + step]].sum(axis=1) for a in range(0, len(g), step)]
                out.append((np.sum(parts, axis=0) * temper if parts else np.zeros(len(log_p))).tolist())
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, others), pa.array(map(declared_of, pages), pa.string()),
                 pa.array(out, pa.list_(pa.float64()))], [*others, "declared", "loglik"])

    return run


def softmax(x: Column) -> Column:
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def added(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def page_evidence(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Host, domain, suffix and path language of pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][\w+.-]*://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return pages.select(
        F.col(key).alias("key"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
        path.alias("path"), F.col(html).cast("binary").alias("html"))


def sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Soft counts of the languages per key, pre-aggregated."""
    cols = [F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in range(n)]
    return rows.groupBy(*by).agg(*cols).select(*by, F.array(*(f"s{i}" for i in range(n))).alias("soft"))


def host_counts(rows: DataFrame, n: int) -> DataFrame:
    """Per host its own soft counts and those of its domain and suffix."""
    hosts = sums(rows, ["suffix", "domain", "host"], n)
    domains = sums(hosts, ["suffix", "domain"], n).withColumnRenamed("soft", "of_domain")
    suffixes = sums(hosts, ["suffix"], n).withColumnRenamed("soft", "of_suffix")
    return hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix") \
        .select("host", F.col("soft").alias("of_host"), "of_domain", "of_suffix")


def prior_without(own: Column, levels: list[Column], n: int, kappa: float) -> Column:
    """Prior from nested counts, widest first, each without the page's
    ``own`` and with ``kappa`` pages of the level above."""
    prior = F.array_repeat(F.lit(1.0 / n), n)
    for counts in levels:
        # what is left of a sum of doubles may fall below 0 by a rounding error
        rest = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(float(kappa)), lambda a, v: a + v)
        prior = F.zip_with(rest, prior, lambda c, p: (c + kappa * p) / total)
    return prior


def with_host_counts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with their host's counts; a host's rows go to ``SALTS`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "loglik"), F.lit(SALTS)).cast("int"))
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["host", "salt"]).drop("salt")


def declared_likelihood(rows: DataFrame, column: str, n: int) -> DataFrame:
    """``log P(value | language)`` of a declaration, a row for each value;
    add-one smoothed."""
    counts = sums(rows, [column], n)
    total = counts.agg(*(F.sum(F.get("soft", F.lit(i))).alias(f"t{i}") for i in range(n)),
                       F.count(F.lit(1)).alias("values"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        column, F.array(*(F.log((F.get("soft", F.lit(i)) + 1) / (F.col(f"t{i}") + F.col("values")))
                          for i in range(n))).alias(f"{column}_log"))


def identify(pages: DataFrame, docs: DataFrame, *, key: str = "page_id", url: str = "url",
             html: str = "html", doc_text: str = "text", doc_lang: str = "lang",
             temper: float = TEMPER, kappa: float = KAPPA) -> DataFrame:
    """Per page: ``key``, ``lang``, its probability ``p``, the language by
    text alone ``text_lang``, and ``declared``."""
    spark = pages.sparkSession
    small_batches(spark)
    langs, log_p = text_model(docs, doc_text, doc_lang)
    n = len(langs)
    evidence = page_evidence(pages, key, url, html)
    kind = dict(evidence.dtypes)["key"]
    if not n:
        return evidence.where("false").select(
            F.col("key").alias(key), F.lit("").alias("lang"), F.lit(0.0).alias("p"),
            F.lit("").alias("text_lang"), F.lit("").alias("declared"))
    rows = evidence.mapInArrow(likelihoods(log_p, temper), (
        f"key {kind}, host string, domain string, suffix string, path string, declared string, "
        "loglik array<double>"))
    rows = written(rows.withColumn("soft", softmax(F.col("loglik"))), "page-evidence")
    everything = rows.agg(*(F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in range(n))).first()
    of_all = F.array(*(F.lit(x or 0.0) for x in everything))
    joined = with_host_counts(rows, host_counts(rows, n))
    prior = prior_without(F.col("soft"), [of_all, F.col("of_suffix"), F.col("of_domain"), F.col("of_host")], n, kappa)
    joined = joined.withColumn("host_log", F.transform(prior, lambda p: F.log(p))) \
        .drop("of_host", "of_domain", "of_suffix")
    for column in ("declared", "path"):
        joined = joined.join(declared_likelihood(rows, column, n), column)
    fused = joined.withColumn("posterior", softmax(added(
        F.col("loglik"), F.col("host_log"), F.col("declared_log"), F.col("path_log"))))
    names = F.array(*(F.lit(x) for x in langs))

    def best(p: str) -> Column:  # the first of equals
        return F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    return fused.select(F.col("key").alias(key), best("posterior").alias("lang"),
                        F.array_max("posterior").alias("p"), best("soft").alias("text_lang"), "declared")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


ship_by_value(__name__)
