"""Document fingerprints that tell what differs: invertible Bloom lookup
sketches of paragraph digests, in DataFrame functions alone.

A text's paragraphs are its lines; a line of more than ``PIECE`` characters
is cut after the sentence that reaches that length.  Its set of 64-bit
paragraph digests goes into a sketch of three subtables of ``2^k`` cells: a
digest enters one cell of each, adding 1 to its count and XORing the digest
and a check hash into it.  Sketches of one size subtract cell by cell, which
leaves the sketch of the digests that only one side has.  Peeling reads them
off: a cell of count +1 or -1 whose check fits holds one digest, which is
then taken out of its other two cells, and so on.  The subtables take turns,
so a digest is read once.  If cells are left, the pair is retried with twice
the cells and other hashes, until everything is recovered.

``fingerprint`` writes out the sketch at the base size.  Two texts are
compared from the size that holds all their digests on, since a small sketch
cannot tell texts that differ in most paragraphs.  Their likeness is the
Jaccard index of the two digest sets, computed from the set sizes and the
recovered digests; two empty sets are alike (1).

The neighbour of a document is the next one in descending key.  Documents are
hash-distributed by ranges of the key, sorted inside a range, and the last of
a range meets the first of the next range by a join on at most ``RANGES``
rows; all later steps stay in the partitions of their document.

Defined results: a null text is empty; keys are ordered null last, equal keys
by text; repeated rows have a row each; a single document is its own
neighbour; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varietas.llm.common import table, written
from varietas.llm.sharding import quantiles, range_of

PIECE, BASE, RANGES, TURNS, ATTEMPTS = 200, 3, 4096, 12, 12
SUBTABLES = 3


def paragraph_digests(text: Column, piece: int = PIECE) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{{piece}}}[^\n.!?]*[.!?]*|[^\n]+"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7919))


def cell_of(digest: Column, subtable: int, k: Column, attempt: int) -> Column:
    """Cell number of a digest in a subtable of ``2^k`` cells."""
    bits = F.shiftrightunsigned(F.xxhash64(digest, F.lit(attempt)), 21 * subtable)
    one = F.lit(1).cast("bigint")
    size = F.call_function("shiftleft", one, k)
    return size * subtable + bits.bitwiseAND(size - 1)


def fingerprint(digests: Column, k: int = BASE) -> Column:
    """The sketch of one set, written out: count, digests and checks of every
    cell."""
    def cell(c: Column) -> Column:
        own = F.filter(digests, lambda d: (cell_of(d, 0, F.lit(k), 0) == c)
                       | (cell_of(d, 1, F.lit(k), 0) == c) | (cell_of(d, 2, F.lit(k), 0) == c))
        xor = F.aggregate(own, F.struct(F.lit(0).cast("bigint").alias("d"),
                                        F.lit(0).cast("bigint").alias("h")),
                          lambda a, d: F.struct(a["d"].bitwiseXOR(d).alias("d"),
                                                a["h"].bitwiseXOR(check_of(d)).alias("h")))
        return F.concat_ws(".", F.hex(F.size(own).cast("bigint")), F.hex(xor["d"]),
                           F.hex(F.shiftrightunsigned(xor["h"], 32)))
    return F.array_join(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit((SUBTABLES << k) - 1).cast("bigint")), cell), "-")


def with_next(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """``key``, ``text``, ``place`` (range, number in it) and ``following``:
    the text of the next document in descending key, round to the first."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = [i / ranges for i in range(1, ranges)]
    at = rows.agg(F.percentile_approx("id", F.lit(asked), 4 * ranges).alias("cuts")).first()
    cuts = sorted(set(at.cuts or ()))
    ranged = rows.withColumn("key", F.col("id")) \
        .withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(range_of(cuts))).drop("key")
    # the first document of every range: at most `ranges` + 1 keys
    heads = ranged.groupBy("range").agg(F.max("id").alias("head")).collect()
    order = sorted(heads, key=lambda r: -r.range)
    needed = [(a.range, b.head, b.range) for a, b in zip(order, order[1:] + order[:1])]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(needed, "before int, head bigint, range int")
    first = ranged.join(F.broadcast(wanted), (ranged["range"] == wanted["range"])
                        & ranged["id"].eqNullSafe(wanted["head"])) \
        .groupBy("before").agg(F.min("text").alias("head_text"))
    w = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), "text")
    placed = ranged.withColumn("place", F.row_number().over(w)) \
        .withColumn("own_next", F.lead("text").over(w))
    joined = placed.join(first, (F.col("range") == F.col("before")) & F.col("own_next").isNull(),
                         "left")
    return joined.select("range", "place", "id", "text",
                         F.coalesce("own_next", "head_text").alias("following"))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the start of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def cells_of(pairs: DataFrame, attempt: int) -> DataFrame:
    """Nonzero cells of the difference sketches, one row per cell.  ``pairs``
    has ``range, place, pair, left, right``; all grouping stays inside their
    partitions."""
    total = F.size("left") + F.size("right")
    # smallest k with 3 * 2^k >= 2 * total, and twice the cells an attempt
    k = F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), total) * (2.0 / SUBTABLES)))) + attempt
    signed = pairs.withColumn("k", k.cast("int")).withColumn("item", F.explode(F.concat(
        F.transform("left", lambda d: F.struct(d.alias("d"), F.lit(1).alias("sign"))),
        F.transform("right", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("sign")))))) \
        .select("range", "place", "pair", "k", F.col("item.d").alias("d"),
                F.col("item.sign").alias("sign"))
    spread = signed.withColumn("cell", F.explode(F.array(
        *(cell_of(F.col("d"), j, F.col("k"), attempt) for j in range(SUBTABLES)))))
    return spread.groupBy("range", "place", "pair", "k", "cell").agg(
        F.sum("sign").alias("count"), F.bit_xor("d").alias("digest"),
        F.bit_xor(check_of(F.col("d"))).alias("check"),
        F.sum(F.lit(0)).alias("plus"), F.sum(F.lit(0)).alias("minus"))


def peel(cells: DataFrame, subtable: int, attempt: int) -> DataFrame:
    """One turn: the digests alone in a cell of ``subtable`` are counted in
    the row of cell -1 and taken out of their other cells."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k"))
    alone = (F.col("cell") >= size * subtable) & (F.col("cell") < size * (subtable + 1)) \
        & (F.abs("count") == 1) & (F.col("check") == check_of(F.col("digest"))) \
        & (F.col("cell") == cell_of(F.col("digest"), subtable, F.col("k"), attempt))
    zero = F.lit(0).cast("bigint")

    def row(cell, count, digest, check, plus, minus) -> Column:
        return F.struct(cell.alias("cell"), count.alias("count"), digest.alias("digest"),
                        check.alias("check"), plus.alias("plus"), minus.alias("minus"))

    out = [row(zero - 1, zero, zero, zero, (F.col("count") > 0).cast("bigint"),
               (F.col("count") < 0).cast("bigint"))]
    out += [row(cell_of(F.col("digest"), j, F.col("k"), attempt), -F.col("count"),
                F.col("digest"), F.col("check"), zero, zero)
            for j in range(SUBTABLES) if j != subtable]
    same = row(*(F.col(c) for c in ("cell", "count", "digest", "check", "plus", "minus")))
    live = cells.where("cell = -1 or count <> 0 or digest <> 0 or check <> 0")
    moved = live.select("range", "place", "pair", "k", F.explode(
        F.when(alone, F.array(*out)).otherwise(F.array(same))).alias("c")) \
        .select("range", "place", "pair", "k", "c.*")
    return moved.groupBy("range", "place", "pair", "k", "cell").agg(
        F.sum("count").alias("count"), F.bit_xor("digest").alias("digest"),
        F.bit_xor("check").alias("check"), F.sum("plus").alias("plus"),
        F.sum("minus").alias("minus"))


def differences(pairs: DataFrame, attempt: int, turns: int = TURNS) -> DataFrame:
    """Per pair: digests recovered on either side, and cells left over."""
    cells = cells_of(pairs, attempt)
    for t in range(turns):
        cells = peel(cells, t % SUBTABLES, attempt)
    left = (F.col("cell") >= 0) & ((F.col("count") != 0) | (F.col("digest") != 0)
                                   | (F.col("check") != 0))
    return cells.groupBy("range", "place", "pair").agg(
        F.sum("plus").alias("plus"), F.sum("minus").alias("minus"),
        F.sum(left.cast("int")).alias("cells_left"))


def pairs_of(versions: DataFrame) -> DataFrame:
    """The pairs (own, edited) and (own, next) of every document."""
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return versions.select("range", "place", "own", "edited", "next") \
        .repartition(parts, "range", "place") \
        .select("range", "place", F.explode(F.array(
            F.struct(F.lit(0).alias("pair"), F.col("own").alias("left"), F.col("edited").alias("right")),
            F.struct(F.lit(1).alias("pair"), F.col("own").alias("left"), F.col("next").alias("right")),
        )).alias("p")).select("range", "place", "p.*")


def recovered(versions: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """``differences`` of all pairs, retried larger until none fails."""
    done, pairs = None, pairs_of(versions)
    for attempt in range(attempts):
        result = written(differences(pairs, attempt), "peeled")
        good = result.where("cells_left = 0")
        done = good if done is None else done.unionByName(good)
        failed = result.where("cells_left > 0").select("range", "place", "pair")
        if not failed.take(1):
            return done
        pairs = pairs_of(versions.join(failed.select("range", "place").distinct(),
                                       ["range", "place"], "left_semi")) \
            .join(failed, ["range", "place", "pair"], "left_semi")
    raise RuntimeError(f"a sketch could not be peeled in {attempts} sizes")


def likeness(left: str, right: str, plus: Column, minus: Column) -> Column:
    """Jaccard index from set sizes and recovered differences."""
    common = F.size(left) - F.coalesce(plus, F.lit(0))
    union = common + F.coalesce(plus, F.lit(0)) + F.coalesce(minus, F.lit(0))
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 ranges: int = RANGES) -> DataFrame:
    """Per row: ``key``, ``n_chars``, ``edited_sha256``, the two sketches,
    and the likeness to the edited text and to the next document."""
    rows = with_next(docs, key, text, ranges)
    rows = rows.withColumn("edited_text", edited_text(F.col("text"), F.col("following")))
    versions = written(rows.select(
        "range", "place", "id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited_text")).alias("edited"),
        paragraph_digests(F.col("following")).alias("next")), "versions")
    diff = recovered(versions).groupBy("range", "place").agg(
        *(F.sum(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}{p}")
          for p in (0, 1) for c in ("plus", "minus")))
    return versions.join(diff, ["range", "place"], "left").select(
        F.col("id").alias(key), "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness("own", "edited", F.col("plus0"), F.col("minus0")).alias("near_edited"),
        likeness("own", "next", F.col("plus1"), F.col("minus1")).alias("near_next"))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
