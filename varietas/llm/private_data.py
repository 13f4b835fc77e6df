"""Personal data by rules and by bootstrapped contexts.

Rules find e-mail addresses, IP addresses, payment cards and telephone
numbers in whole texts (the base spans).  Their values are the seeds of a
bootstrap.  Everything shaped like an identifier that no rule accepts (an
address without a dotted host or spelled out, groups of hexadecimal digits, a
number without a leading plus or a valid check digit) is a candidate.  Every
seed and candidate stands in lexical patterns: the word before it, the two
words before it, the words on both sides.

Patterns and values form a graph with one edge for each pattern a value
stands in.  Spark scores it for a few rounds.  A pattern's confidence for a
kind is the belief in that kind among its values, against all belief, a
quarter of its undecided values and one more value of prior doubt.  Patterns
with enough support and confidence lend it to the candidates in them (noisy
or); a candidate with enough belief becomes a value of that kind and supports
patterns in the next round.  Every place of such a value, and every place
where a seed's value stands in another form, becomes a span.

Values and patterns are counted by aggregation, and joins are salted, so a
value or a word that stands in a third of all texts is spread over tasks.

Defined results: a null or empty text has no spans; texts of any length are
read whole, in time that is linear in their length; repeated rows give a row
each and count their values once; equally strong kinds go to the first as
listed; a null id stays null; an empty table gives no rows.  ``n_email`` to
``n_phone`` count base spans.  Only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varietas.llm.common import chunks, ship_by_value, small_batches, table, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROUNDS = 3
SUPPORT, CONFIDENCE, BELIEF, UNDECIDED = 3, 0.7, 0.9, 0.25
# Code points on either side in which a pattern's words are looked for.
REACH = 48
SALTS = 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look-behind keep every search linear.
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++)"
    r"|(?P<ip>(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))"
    r"|(?P<number>(?<![0-9A-Za-z])\(?[0-9]++(?:(?:[ .-]|\) ?| \()[0-9]++)*+(?![0-9A-Za-z]))")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})(?: at | ?[\[(]at[\])] ?)"
    r"([A-Za-z0-9-]+(?:(?: dot | ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+)")
DOT = re.compile(r" dot | ?[\[(]dot[\])] ?")
WORD = re.compile(r"[^\W\d_]+")


# --------------------------------------------------------------- base spans
def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping addresses: from each @, back over the local
    part and on over the host."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_address(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order."""
    out = [(a, EMAIL, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), IP, m.end()) for m in ADDRESS.finditer(text) if is_address(m[0])]
        out += [(m.start(), CARD, m.end()) for m in DIGITS.finditer(text) if is_card(m[0])]
        out += [(m.start(), PHONE, m.end()) for m in DIALLED.finditer(text)
                if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# ----------------------------------------------------------------- mentions
def value_of(kind: int, text: str) -> str:
    """A form that all spellings of an identifier share."""
    if kind in (CARD, PHONE):
        return "d:" + digits_of(text)
    return "ei"[kind == IP] + ":" + text.lower()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """``(start, end, allowed kinds as bits, value)`` of identifier-like
    places in the gaps between base spans."""
    if not any(c in text for c in "@0123456789") and "dot" not in text:
        return []
    out, at = [], 0
    spelled = [m for m in SPELLED.finditer(text)] if "dot" in text else []
    taken = sorted([(a, b) for a, _, b in base]
                   + [m.span() for m in spelled if not any(a < m.end() and m.start() < b for a, _, b in base)])
    whole = {m.span(): m for m in spelled}
    for a, b in [*taken, (len(text), len(text))]:
        for m in CANDIDATE.finditer(text, at, a) if at < a else ():
            n = len(digits_of(m[0]))
            if m["email"]:
                out.append((*m.span(), 1 << EMAIL, value_of(EMAIL, m[0])))
            elif m["ip"]:
                out.append((*m.span(), 1 << IP, value_of(IP, m[0])))
            elif 7 <= n <= 19:
                allowed = (n >= 12) << CARD | (n <= 15) << PHONE
                out.append((*m.span(), allowed, value_of(CARD, m[0])))
        if (a, b) in whole:
            m = whole[a, b]
            out.append((a, b, 1 << EMAIL, value_of(EMAIL, f"{m[1]}@{DOT.sub('.', m[2])}")))
        at = max(at, b)
    return out


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: words within ``REACH`` code points."""
    left = [w.lower() for w in WORD.findall(text, max(0, start - REACH), start)[-2:]]
    right = WORD.search(text, end, min(len(text), end + REACH))
    out = []
    if left:
        out.append(f"{left[-1]} _")
        if right:
            out.append(f"{left[-1]} _ {right[0].lower()}")
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    return out


MENTION = "struct<start:int, stop:int, seed:int, allowed:int, value:string, patterns:array<string>>"
PLACE = "struct<start:int, kind:int, stop:int>"


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``mapInArrow`` function for base spans and mentions of each row."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    mention = pa.list_(pa.struct([
        ("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.int32()), ("allowed", pa.int32()),
        ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch, texts in chunks(batches, "text"):
        spans, mentions, digests = [], [], []
        for data in texts:
            text = data.decode("utf-8", "replace")
            base = base_spans(text)
            found = [(a, b, kind, 0, value_of(kind, text[a:b])) for a, kind, b in base]
            found += [(a, b, None, allowed, value) for a, b, allowed, value in candidates(text, base)]
            spans.append([{"start": a, "kind": kind, "stop": b} for a, kind, b in base])
            mentions.append([{"start": a, "stop": b, "seed": kind, "allowed": allowed, "value": value,
                              "patterns": patterns_at(text, a, b)} for a, b, kind, allowed, value in found])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "ident": batch.column("ident"), "base": pa.array(spans, span),
            "base_sha256": pa.array(digests, pa.string()), "mentions": pa.array(mentions, mention)})


# ---------------------------------------------------------------- bootstrap
def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (unique by ``key``); a key's rows on the
    left are dealt by ``spread`` over ``SALTS`` tasks."""
    a = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    b = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [key, "salt"], how).drop("salt")


def edges_of(mentions: DataFrame) -> DataFrame:
    """``pattern, value, seed, allowed``: one row per pattern of a value.  A
    value that some text shows as a seed is one everywhere."""
    edges = mentions.select(F.explode("patterns").alias("pattern"), "value").distinct()
    values = mentions.groupBy("value").agg(F.min("seed").alias("seed"), F.bit_or("allowed").alias("allowed"))
    return salted_join(edges, values, "value", "pattern")


def confident(edges: DataFrame, learned: DataFrame, support: int, confidence: float) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns to be trusted, from the
    seeds and the values ``learned`` so far."""
    known = salted_join(edges, learned, "value", "pattern", "left") \
        .withColumn("kind", F.coalesce("seed", "kind")) \
        .withColumn("belief", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("belief")))
    sums = known.groupBy("pattern").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("belief"))), F.lit(0.0)).alias(name)
          for k, name in enumerate(KINDS)], F.count(F.when(F.col("kind").isNull(), 1)).alias("undecided"))
    against = sum((F.col(name) for name in KINDS), UNDECIDED * F.col("undecided") + 1)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(name).alias("support"),
                              (F.col(name) / against).alias("confidence")) for k, name in enumerate(KINDS)])
    # a pattern without undecided values has nothing to teach
    return sums.where(F.col("undecided") > 0).select("pattern", F.explode(each).alias("k")) \
        .select("pattern", "k.*").where((F.col("support") >= support) & (F.col("confidence") >= confidence)) \
        .drop("support")


def believed(edges: DataFrame, patterns: DataFrame, belief: float) -> DataFrame:
    """``value, kind, belief`` of the candidates that trusted patterns hold."""
    lent = salted_join(edges.where(F.col("seed").isNull()), patterns, "pattern", "value") \
        .where(F.col("allowed").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0)
    kinds = lent.groupBy("value", "kind").agg(
        (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("belief"))
    return kinds.groupBy("value").agg(F.max(F.struct("belief", (-F.col("kind")).alias("last"))).alias("k")) \
        .select("value", (-F.col("k.last")).alias("kind"), F.col("k.belief").alias("belief")) \
        .where(F.col("belief") >= belief)


def learned_values(edges: DataFrame, rounds: int, support: int, confidence: float, belief: float) -> DataFrame:
    """Candidates that the bootstrap takes for personal data."""
    learned = edges.sparkSession.createDataFrame([], "value string, kind int, belief double")
    for _ in range(rounds):
        # a round starts from all edges again, so a value can also be lost
        patterns = confident(edges, learned, support, confidence)
        learned = written(believed(edges, patterns, belief), "identifiers")
    return learned


def personal_data(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", rounds: int = ROUNDS,
                  support: int = SUPPORT, confidence: float = CONFIDENCE,
                  belief: float = BELIEF) -> DataFrame:
    """Per row of ``docs``: the id as ``ident``, ``base`` and ``places``
    (arrays of ``start, kind, stop``; ``places`` are all spans, in order) and
    ``base_sha256``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("ident"),
                       F.col(text).cast("binary").alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL(
        f"base array<{PLACE}>, base_sha256 string, mentions array<{MENTION}>").fields])
    rows = written(rows.mapInArrow(scanned, schema), "mentions")
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = written(edges_of(mentions), "edges")
    learned = learned_values(edges, rounds, support, confidence, belief)
    others = mentions.where(F.col("seed").isNull()).select("row", "start", "stop", "allowed", "value")
    # a candidate may also be a seed's value in another form
    seeds = mentions.where(F.col("seed").isNotNull()).groupBy("value").agg(F.min("seed").alias("kind"))
    seeds = others.select("value").distinct().join(seeds, "value")
    values = learned.select("value", "kind").unionByName(seeds)
    more = salted_join(others, values, "value", "row") \
        .where(F.col("allowed").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0) \
        .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))
    places = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(f"array<{PLACE}>"))))
    return rows.drop("mentions").join(more, "row", "left") \
        .select("ident", "base", "base_sha256", places.alias("places"))


def listed(places: Column) -> Column:
    """``kind:start:stop`` of each place, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(places, lambda p: F.concat_ws(
        ":", F.get(names, p["kind"]), p["start"].cast("string"), p["stop"].cast("string"))), ",")


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda p: p["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return found.select(F.col("ident").alias("doc_id"), *map(number, range(len(KINDS))),
                        "base_sha256", listed(F.col("places")).alias("spans"))


ship_by_value(__name__)
