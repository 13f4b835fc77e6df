"""Fingerprints, sharding and chat formatting."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from varietas.llm import chat, fingerprint, sharding


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -------------------------------------------------------------- fingerprints
def paragraphs(text):
    return set(re.findall(r"[^\n]{200}[^\n.!?]*[.!?]*|[^\n]+", text))


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_fingerprints(rows):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        out.append((k, len(t), digest(edited), round(jaccard(t, edited), 9), round(jaccard(t, following), 9)))
    return sorted(out, key=repr)


def test_fingerprints_equal_brute_force(documents):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) + "."
                          for _ in range(rng.randrange(1, 12)))) for i in range(25)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, "\U0001f600" * 7), (34, rows[4][1]), (35, rows[4][1]),
             (4, rows[4][1]), (None, "no key"), (36, "\n".join(f"line {i}" for i in range(3000)))]
    out = fingerprint.fingerprints(documents(rows), ranges=8).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9),
                   round(r["near_next"], 9)) for r in out), key=repr)
    assert got == brute_fingerprints(rows)
    texts = {k: t or "" for k, t in rows}
    prints = {}
    for r in out:  # equal texts and only those (as sets of paragraphs) have equal fingerprints
        prints.setdefault(r["fingerprint"], set()).add(frozenset(paragraphs(texts[r["doc_id"]])))
    assert all(len(s) == 1 for s in prints.values())


def test_fingerprints_of_one_row_and_none(documents):
    row = fingerprint.fingerprints(documents([(5, "abcd")])).first()
    assert (row["edited_sha256"], row["near_next"]) == (digest("abab"), 1.0)
    assert fingerprint.fingerprints(documents([])).collect() == []


# ------------------------------------------------------------------ sharding
def test_shards_are_balanced_whole_and_gapless(documents):
    rng = random.Random(8)
    same = "hot text " * 20
    rows = [(i, same if i % 3 == 0 else "x" * rng.randrange(400)) for i in range(1500)]
    rows += [(None, None), (7, "é"), (7, "é"), (2000, "")]
    out = sharding.shard(documents(rows), 7, ranges=16, per_range=8).collect()
    expected = sorted(((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == expected
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(7):
        own = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 7) <= 2 * largest
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}


def test_shards_of_few_rows_and_none(documents):
    assert sharding.shard(documents([]), 4).collect() == []
    one = sharding.shard(documents([(1, "a")]), 4).first()
    assert 0 <= one["shard"] < 4 and one["slot"] == 0


# ---------------------------------------------------------------------- chat
def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\b", "\\<|", "<\\|", "", None, "\n\nx\\:", "<|image:1|>",
             "\U0001f600 <", "|>", "long " * 5000]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(
        zip(["user", "assistant", "ro\nle", "<|im_end|>", None] * 3, nasty))]
    rows += [(3, None, "assistant", "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), (None, 0, "user", "z")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string") \
        .withColumn("key", F.lit("clash")).withColumn("content", F.lit(1))
    out = chat.format_conversations(table.withColumn("parts", chat.text_part(F.col("text")))) \
        .withColumn("back", chat.read_turns(F.col("formatted"))) \
        .withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    got = {r["conv_id"]: r for r in out.collect()}
    for c in (1, 2):
        own = [(role or "", text or "") for k, _, role, text in rows if k == c]
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == own
        assert got[c]["learned"] == "".join(t for role, t in own if role == "assistant")
        assert got[c]["formatted"].count("<|im_start|>") == len(own)
    assert got[3]["learned"] == "xyy" and got[3]["n_turns"] == 3
    assert [(t["role"], t["text"]) for t in got[None]["back"]] == [("user", "z")]


def test_chat_parts_become_numbered_placeholders(spark):
    text, image = ("text", "see <|", None, None), ("image", None, "a.png", 2)
    rows = [(1, 0, "user", [text, image, ("audio", None, "b.wav", None)]),
            (1, 1, "assistant", [("text", "ok", None, None)]),
            (1, 2, "user", [("document", "ignored", None, 3), ("odd", "read as text", None, 9)]),
            (1, 3, "user", None), (1, 4, "user", [])]
    table = spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts {chat.PART}")
    r = chat.format_conversations(table).first()
    assert r["formatted"] == (
        "<|im_start|>user\nsee <\\|<|image:1|><|audio:2|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
        "<|im_start|>user\n<|document:3|>read as text<|im_end|>\n" + "<|im_start|>user\n<|im_end|>\n" * 2)
    assert [(a["number"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (1, 0, "image", "a.png", 512), (2, 0, "audio", "b.wav", 25), (3, 2, "document", None, 1536)]
    assert r["expanded_tokens"] == 512 + 25 + 1536
    (span,) = r["loss"]
    assert r["formatted"][span["start"]:span["start"] + span["length"]] == "ok"


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], f"conv_id bigint, turn int, role string, parts {chat.PART}")
    assert chat.format_conversations(none).collect() == []
