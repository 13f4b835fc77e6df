"""Packing and token files against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from varietas.llm import packing, token_files
from varietas.llm.tokens import ChunkEncoder, encoder, tokenizer_path

TEXTS = [None, "", " ", "\n\t", "Plain words, and more. End", "café naïve ÉTÉ", "a,b.c", "x" * 3000,
         "\U0001f600 emoji​", "<|endoftext|> inside", "tab\tand  two spaces", "don't 12,345.67", "你好 世界",
         "word. word, word", " nbsp ", "İİ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text, last):
    return [*library.encode(text or "", add_special_tokens=False).ids, last]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def rows_of():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "delta.", "epsilon", "zeta-eta", "42"]
    rows = list(enumerate(TEXTS))
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 900)))) for i in range(60)]
    rows += [(100, rows[-1][1]), (300, " ".join(rng.choices(words, k=9000)))]
    return rows


def test_chunked_ids_equal_the_library(library):
    texts = [(t or "").encode() for _, t in rows_of()]
    ids, counts = encoder(tokenizer_path()).encode(texts, 2)
    expected = [ids_of(library, t.decode(), 2) for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_chunk_of_more_ids_than_a_place_and_length_share(library):
    texts = ["before it", "a1" * 530_000, "after it"]
    coder = ChunkEncoder(tokenizer_path())
    ids, counts = coder.encode([t.encode() for t in texts], 2)
    expected = [ids_of(library, t, 2) for t in texts]
    assert len(expected[1]) > 1 << 20
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_every_id_is_packed_once(documents, library):
    rows = rows_of()
    out = packing.pack(documents(rows).coalesce(1), capacity=256, group=20).collect()
    expected = sorted((k, len(ids_of(library, t, 1))) for k, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    whole = {(k, len(ids)): ids for k, t in rows for ids in [ids_of(library, t, 1)]}
    assert set(pieces) == set(whole)
    covered = 0
    for key, own in pieces.items():
        for r in own:
            assert r["ids_crc32"] == crc(whole[key][r["start"]:r["start"] + r["length"]])
            covered += r["length"]
    assert covered == sum(n for _, n in expected)
    for key, own in pieces.items():
        at = 0
        for start, n in sorted((r["start"], r["length"]) for r in own):
            assert start == at
            at += n
        assert at == key[1]
    for own in sequences.values():
        at = 0
        for offset, n in sorted((r["offset"], r["length"]) for r in own):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0


def test_sum_of_squares_takes_the_least():
    p = packing.SumOfSquares(10)
    p.place("a", 6)
    p.place("b", 4)  # closing the window beats a second open one
    assert [[x[0] for x in w] for w in p.full] == [["a", "b"]] and p.levels.sum() == 0
    p.place("c", 3)
    p.place("d", 3)  # level 6 (counts 0, 1) against level 3 twice (2)
    assert p.levels[6] == 1 and p.levels[3] == 0


def test_packing_of_an_empty_table(documents):
    assert packing.pack(documents([])).collect() == []


# --------------------------------------------------------------- token files
def test_files_read_back(spark, documents, library, tmp_path):
    rows = rows_of()
    folder = str(tmp_path / "files")
    token_files.write_token_files(documents(rows).repartition(3), folder, block=2000, lanes=8)
    out = sorted(tuple(r) for r in token_files.read_token_files(spark, folder).collect())
    ids = sorted((k, ids_of(library, t, 2)) for k, t in rows)
    assert sorted((k, n, c) for k, _, n, c in out) == sorted((k, len(x), crc(x)) for k, x in ids)
    at = 0
    for _, start, n, _ in sorted(out, key=lambda r: r[1]):
        assert start == at
        at += n
    by_start = [k for k, *_ in sorted(out, key=lambda r: r[1])]
    assert by_start == sorted(by_start)


def test_damage_is_noticed(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "files")
    token_files.write_token_files(documents([(1, "some words " * 50)]), folder)
    blocks = spark.read.parquet(f"{folder}/blocks").withColumn(
        "words", F.concat(F.expr("substring(words, 1, octet_length(words) - 1)"), F.expr("X'7f'")))
    blocks.write.parquet(f"{folder}-bad/blocks")
    spark.read.parquet(f"{folder}/table").write.parquet(f"{folder}-bad/table")
    with pytest.raises(Exception, match="damaged payload|wrong ids"):
        token_files.read_token_files(spark, f"{folder}-bad").collect()


@pytest.mark.parametrize("n,lanes", [(0, 1), (1, 1), (7, 4), (1000, 16), (5000, 8)])
def test_blocks_decode_from_every_checkpoint(n, lanes):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 400).astype(np.uint16)
    freq = token_files.scaled(np.bincount(np.append(ids, 3), minlength=500), 12)
    assert freq.sum() == 1 << 12 and (freq[np.unique(ids)] > 0).all()
    coder = token_files.Coder(freq, 12)
    states, words, marks = coder.encode(ids, lanes, check=16)
    assert coder.decode(states, words, n, lanes).tolist() == ids.tolist()
    for c in range(1, len(marks) // (8 * (lanes + 1)) + 1):
        part = coder.decode(states, words, n, lanes, marks, first=c, check=16)
        assert part.tolist() == ids[c * 16 * lanes:].tolist()


def test_files_of_an_empty_table(spark, documents, tmp_path):
    token_files.write_token_files(documents([]), str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).collect() == []


def test_ids_beyond_16_bits_are_refused(spark, documents, tmp_path):
    with pytest.raises(ValueError, match="ids up to 70000"):
        token_files.write_token_files(documents([(1, "some words")]), str(tmp_path / "wide"), last=70000)
    token_files.write_token_files(documents([(None, "some words"), (4, "more"), (None, "")]), str(tmp_path / "null"))
    out = token_files.read_token_files(spark, str(tmp_path / "null")).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, 4]
