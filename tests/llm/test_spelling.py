"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from varietas.llm import spelling


def brute_words(rows, drop=31, least=7, count=2):
    words = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{ident}:{run}".encode())
            if drop and ident is not None and h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least and n >= count}


def brute(rows, **options):
    words = brute_words(rows, **options)
    near = defaultdict(set)
    letters = sorted(set("".join(words)))
    for w in words:
        for i in range(len(w) + 1):
            for e in ([w[:i] + w[i + 1:]] if i < len(w) else []) \
                    + [w[:i] + c + w[i:] for c in letters] \
                    + ([w[:i] + c + w[i + 1:] for c in letters] if i < len(w) else []):
                if e != w and e in words:
                    near[w].add(e)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda e: (-words[e], e))
        if words[best] >= 10 * words[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), words[form[w]] if w in form else -1)
                  for w, n in words.items())


def grouped(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], -1 if r[5] is None else r[5]) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(base)
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", w[k] * 2, "É"]) + w[k + rng.randrange(2):]
            out.append(rng.choice([w, w, w.upper() if w.isascii() else w, w.capitalize()]))
        rows.append((i, rng.choice([" ", "-", "1", "一"]).join(out)))
    return rows


def test_equal_to_brute_force(spark, documents):
    rows = texts(1, 300)
    rows += [(5, None), (6, ""), (None, rows[3][1]), (7, rows[4][1]), (7, rows[4][1]),
             (8, "×÷×÷×÷× " * 2), (9, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa " * 3)]
    got = grouped(spelling.spelling_variants(documents(rows), drop=31))
    assert got == brute(rows)
    assert sum(r[4] for r in got) > 100 and any(r[1] for r in got)


@pytest.mark.parametrize("pass_bytes", [8, 64, 400])
def test_small_passes_give_the_same_words(spark, documents, pass_bytes):
    rows = texts(2, 25)
    got = grouped(spelling.spelling_variants(documents(rows), drop=31, pass_bytes=pass_bytes))
    assert got == brute(rows)


def test_forms_are_followed_to_the_last(spark, documents):
    rows = [(1, "abcdefgh " * 2000 + "abcdefgx " * 200 + "abcdefyx " * 20 + "abcdzfyx " * 2)]
    out = {r[0]: r for r in grouped(spelling.spelling_variants(documents(rows)))}
    assert out == {r[0]: r for r in brute(rows, drop=0)}
    assert out["abcdzfyx"][1:3] == ("abcdefyx", "abcdefgh")


def test_very_long_words_and_texts(spark, documents):
    long = "abc" * 40000
    rows = [(1, long + " " + long[:-1]), (2, long + " " + long[:-1]), (3, "gardens gardens " * 60000 + "gardenss gardenss")]
    got = grouped(spelling.spelling_variants(documents(rows)))
    assert [(len(r[0]), r[3], r[4]) for r in got] == [(119999, 2, 1), (120000, 2, 1), (7, 120000, 1), (8, 2, 1)]
    assert got[3][1:3] == ("gardens", "gardens")


def test_empty_table(spark, documents):
    assert grouped(spelling.spelling_variants(documents([]))) == []


def test_passes_hold_their_bytes_and_all_words():
    counts = {7: 1000, 8: 100_000, 9: 3}
    passes = spelling.passes_of(counts, 64_000)
    for filters in passes:
        assert 8 * (filters[-1].at + filters[-1].blocks) <= 64_000
    for length, n in counts.items():
        parts = [f for p in passes for f in p if f.length == length]
        assert [f.part for f in parts] == list(range(parts[0].parts))
        assert sum(8 * f.blocks for f in parts) >= n * spelling.FILTER_BYTES


def test_query_equals_brute_force(spark, sf_dir):
    import pyarrow.parquet as pq
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert grouped(spelling.op13_spelling_variants(spark, sf_dir)) == brute(list(zip(rows["doc_id"], rows["text"])))
