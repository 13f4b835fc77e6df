"""Cross-site line removal by distinct-site spread.

A line's spread is the number of different sites it stands on.  For lines of
fewer than ``passage_words`` words a site is the row's ``source``, and a line
spread over ``min_sites`` of them is boilerplate.  A longer passage hardly
arises twice by chance: there each document is a site of its own, and a spread
of ``passage_sites`` counts.

Lines become hashes; a HyperLogLog sketch of the sites per line is merged by
aggregation, partly before the shuffle.  Where the estimate is clear of the
threshold (beyond ``margin``, relative) it decides; lines nearer to it get an
exact distinct count, by grouping on (line, site) first, so that no line's
sites meet in one task.  Every line over its threshold is removed from all
documents but the one with the smallest (key, hash), which keeps its copies;
no passage is lost from the corpus.

Defined results: a null text has one empty line; blank lines are never
removed; a null source is one site; a line that only one document repeats
stays; rows equal in key and text count as one document and are treated
alike; a null key comes last; an empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import table, unused, written

MIN_SITES, PASSAGE_WORDS, PASSAGE_SITES = 10, 50, 2
MARGIN, LOG_K = 0.25, 9  # relative standard error of 2^9 registers: 4.6 %


def line_list(text: Column) -> Column:
    return F.split(text, "\n", -1)


def word_count(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[ \t\x0b\f\r]+"), lambda w: w != ""))


def line_table(docs: DataFrame, key: str, text: str, source: str, passage_words: int) -> DataFrame:
    """``doc`` (hash of key and text), ``key``, ``at``, ``line`` (hash),
    ``check``, ``site`` and ``long`` of every line that is not blank."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("bigint").alias("key"), F.xxhash64(F.col(key), body).alias("doc"),
        F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("source"),
        F.posexplode(line_list(body)).alias("at", "text")) \
        .where(~F.col("text").rlike(r"^\s*$")) \
        .withColumn("long", word_count(F.col("text")) >= passage_words) \
        .select("key", "doc", "at", F.xxhash64("text").alias("line"),
                F.crc32(F.col("text").cast("binary")).alias("check"), "long",
                F.when(F.col("long"), F.col("doc")).otherwise(F.col("source")).alias("site"))


def spread_lines(lines: DataFrame, min_sites: int, passage_sites: int, margin: float) -> DataFrame:
    """``line``, ``check`` of all lines at or over their threshold, and
    ``holder``, the first document that has the line: found by the same
    pre-aggregated pass as the sketch, so a frequent line never meets in one
    task."""
    limit = F.when(F.col("long"), passage_sites).otherwise(min_sites)
    estimated = lines.groupBy("line", "check", "long").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("doc"))).alias("first"),
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("spread")) \
        .where(F.col("copies") >= limit).withColumn("holder", F.col("first.doc")).drop("first")
    # fewer copies cannot reach the threshold
    estimated = written(estimated, "spread")
    clear = estimated.where(F.col("spread") > limit * (1 + margin)).select("line", "check", "holder")
    near = estimated.where(F.col("spread").between(limit * (1 - margin), limit * (1 + margin)))
    exact = lines.join(near.select("line", "check"), ["line", "check"], "left_semi") \
        .select("line", "check", "long", "site").distinct() \
        .groupBy("line", "check", "long").agg(F.count(F.lit(1)).alias("sites")) \
        .where(F.col("sites") >= limit).select("line", "check")
    return clear.unionByName(near.join(exact, ["line", "check"]).select("line", "check", "holder"))


def remove_spread_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                        source: str = "source", min_sites: int = MIN_SITES,
                        passage_words: int = PASSAGE_WORDS, passage_sites: int = PASSAGE_SITES,
                        margin: float = MARGIN, n_lines: str = "_lines",
                        n_removed: str = "_removed") -> DataFrame:
    """All columns of ``docs`` with the cleaned ``text``, and the line counts
    in columns ``n_lines`` and ``n_removed`` (in place of columns of these
    names; choose others to keep those)."""
    lines = written(line_table(docs, key, text, source, passage_words), "lines")
    holders = written(spread_lines(lines, min_sites, passage_sites, margin), "holders")
    mark, gone = unused(docs, "_doc"), unused(docs, "_taken")
    taken = lines.join(holders, ["line", "check"]).where("doc <> holder") \
        .groupBy(F.col("doc").alias(mark)).agg(F.collect_set("at").alias(gone))  # a document's own lines
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(mark, F.xxhash64(F.col(key), body)).join(taken, mark, "left")
    split = line_list(F.coalesce(F.col(text), F.lit("")))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone)))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(
        F.transform(kept, lambda i: F.get(split, i)), "\n"))
    return rows.withColumn(n_lines, F.size(split)) \
        .withColumn(n_removed, F.coalesce(F.size(gone), F.lit(0))) \
        .withColumn(text, cleaned).drop(mark, gone)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_spread_lines(docs).select(
        "doc_id", F.col("_lines").cast("bigint").alias("n_lines"),
        F.col("_removed").cast("bigint").alias("n_removed"), "text")


OP6_SQL = r"""
with d as (select distinct doc_id, source, coalesce(text, '') text from documents),
l as (select doc_id, coalesce(source, '') source, text, i, ls[i] line,
  len(list_filter(regexp_split_to_array(ls[i], '[ \t\x0b\f\r]+'), lambda w: w <> '')) >= 50 long
  from (select *, string_split(text, chr(10)) ls from d), unnest(range(1, len(ls) + 1)) t(i)
  where not regexp_full_match(ls[i], '[ \t\n\x0b\f\r]*')),
s as (select line, min(doc_id) holder from l group by line, long
  having case when long then count(distinct doc_id) >= 2 else count(distinct source) >= 10 end),
k as (select l.doc_id, list(i) taken from l join s using (line)
  where doc_id <> holder group by l.doc_id)
select doc_id, len(ls)::bigint n_lines, coalesce(len(taken), 0)::bigint n_removed,
  case when taken is null then text else array_to_string(
    list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(taken, i)),
    lambda i: ls[i]), chr(10)) end text
from (select doc_id, text, string_split(coalesce(text, ''), chr(10)) ls from documents)
left join k using (doc_id)
"""
