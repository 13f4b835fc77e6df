"""Jaccard join, line dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from varietas.llm import decontaminate, jaccard_join, linededup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10 ** 6)}"
    return out


# ------------------------------------------------------------------ Jaccard
def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered(text))
    k = min(k, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return sorted((k, len(s), min(least[root(i)])) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def near_rows(seed):
    rng = random.Random(seed)
    rows, at = [], 100
    for size in (6, 9, 20, 45, 90, 200):
        base = prose(rng, size)
        chain = base
        for step in range(7):
            rows.append((at, " ".join(changed(rng, base, step))))
            chain = changed(rng, chain, max(1, size // 60))
            rows.append((at + 1, "\t".join(chain).upper()))
            at += 2
    shared = prose(rng, 30)  # one passage in many otherwise different texts
    for _ in range(12):
        rows.append((at, " ".join(prose(rng, 60) + shared)))
        at += 1
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ntwo"), (6, "one two three"),
             (7, "same " * 50), (8, "same " * 51), (9, "été a b c d"), (9, "été a b c d"),
             (10, "ÉTÉ a b c d"), (11, " ".join(prose(rng, 20000)))]
    rows.append((12, rows[-1][1] + " tail end"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell,doubts", [(2048, 64), (4, 1)])
def test_jaccard_components_equal_brute_force(documents, cell, doubts):
    rows = near_rows(cell)
    out = jaccard_join.jaccard_components(documents(rows), cell=cell, doubts=doubts)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in out.collect()) == brute_components(rows)


def star_rows(leaves):
    """A page and shorter variants of it with five other words, each linked
    with the page alone."""
    rng = random.Random(leaves)
    page = [f"p{i}" for i in range(272)]
    rows = [(1000, " ".join(page))]
    for v in range(leaves):
        words = page[:-8]
        for i, at in enumerate(sorted(rng.sample(range(50), 5))):
            words[5 * at + 4] = f"v{v}-{i}"
        rows.append((v, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaves,doubts", [(130, 64), (40, 1)])
def test_jaccard_star_of_variants_is_one_component(documents, leaves, doubts):
    rows = star_rows(leaves)
    expected = brute_components(rows)
    assert {c for _, _, c in expected} == {0}
    sets = [shingles(t) for k, t in rows if k != 1000]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    out = jaccard_join.jaccard_components(documents(rows), doubts=doubts)
    assert sorted(tuple(r) for r in out.collect()) == expected


def test_jaccard_rounds_stay_few_where_links_are_refuted(documents, monkeypatch):
    """A crowd of short variants near the threshold: many bitmaps allow links
    that their sets refuse, and no round may settle one link at a time."""
    rng = random.Random(5)
    bases = [prose(rng, 100) for _ in range(3)]
    rows = [(i, " ".join(changed(rng, bases[i % 3], 1 + i % 4))) for i in range(400)]
    refused, searches, write = [], [], jaccard_join.written

    def counted(df, name):
        out = write(df, name)
        if name == "likely":
            searches.append(name)
        if name == "verified":
            refused.append(out.where("not linked").count())
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    out = jaccard_join.jaccard_components(documents(rows), doubts=8)
    assert sorted(tuple(r) for r in out.collect()) == brute_components(rows)
    assert sum(refused) > 20 and len(searches) <= 5


def test_jaccard_null_keys_and_empty_table(documents):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "p q r s t u"), (None, None)]
    out = {tuple(r) for r in jaccard_join.jaccard_components(documents(rows)).collect()}
    assert out == {(None, 2, 7), (7, 2, 7), (None, 2, None), (None, 0, None)}
    assert jaccard_join.jaccard_components(documents([])).collect() == []


def test_jaccard_threshold_is_inclusive(documents):
    # 9 shingles each side, 8 shared: 8 / 10 is exactly 0.8
    rows = [(1, "a b c d e f g h i j k l m"), (2, "z b c d e f g h i j k l m")]
    assert brute_components(rows) == [(1, 9, 1), (2, 9, 1)]
    out = jaccard_join.jaccard_components(documents(rows)).collect()
    assert sorted(tuple(r) for r in out) == brute_components(rows)


def test_one_row_of_each_group_stays_whatever_the_keys(spark, documents):
    import corpus_pipeline

    a, b, c, d = (" ".join(prose(random.Random(i), 60)) for i in range(4))
    rows = [(None, a), (None, a), (None, a + " end"),  # null keys alone
            (7, b), (7, b + " end"), (7, b + " end"),  # one key, near texts
            (None, c), (9, c), (8, c + " end"), (8, d),  # 8 stays, and d of the same key
            (None, ""), (None, ""), (3, None)]
    docs = documents(rows)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len([k for k, t in kept if t and t.startswith(a)]) == 1
    assert len([k for k, t in kept if t and t.startswith(b)]) == 1
    assert [k for k in kept if k[1] and not k[1].startswith((a, b))].count((8, d)) == 1
    assert [k for k in kept if k[1] and k[1].startswith(c)] == [(8, c + " end")]
    assert sorted((k for k in kept if not k[1]), key=repr) == sorted(rows[-3:], key=repr)
    assert len(kept) == 7


# --------------------------------------------------------------- line dedup
def brute_lines(rows, min_sites=10, words=50, passage_sites=2):
    docs = {(k, t or "", s or "") for k, t, s in rows}
    sites, holder = defaultdict(set), {}
    for k, t, s in docs:
        for line in t.split("\n"):
            if line.strip(" \t\n\x0b\f\r"):
                long = len([w for w in re.split(r"[ \t\x0b\f\r]+", line) if w]) >= words
                sites[line, long].add((k, t) if long else s)
                holder[line] = min(holder.get(line, (k, t)), (k, t))
    spread = {line for (line, long), found in sites.items()
              if len(found) >= (passage_sites if long else min_sites)}
    out = []
    for k, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x not in spread or holder[x] == (k, t or "")]
        out.append((k, t if len(kept) == len(lines) else "\n".join(kept), len(lines),
                    len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_spread_lines_equal_brute_force(documents):
    rng = random.Random(5)
    passage = " ".join(prose(rng, 60))
    rows = []
    for i in range(120):
        body = [" ".join(prose(rng, 8)) for _ in range(3)]
        site = f"site{i % 14}"
        body.append("subscribe to our letter")  # 14 sites
        if i % 14 < 10:
            body.append("exactly ten sites")
        if i % 14 < 9:
            body.append("nine sites only")
        if i % 14 == 0:
            body += ["one site repeats this", ""]
        if i in (3, 40, 41):
            body.insert(1, passage)
        rows.append((i, "\n".join(body), site))
    rows += [(200, None, "s1"), (201, "", None), (202, "\n \n", "s2"), (203, "subscribe to our letter", None),
             (204, "twice\ntwice", "s3"), (50, rows[50][1], rows[50][2])]
    out = linededup.remove_spread_lines(documents(rows))
    assert set(documents(rows).columns) < set(out.columns)
    got = sorted(((r["doc_id"], r["text"], r["_lines"], r["_removed"]) for r in out.collect()), key=repr)
    assert got == brute_lines(rows)
    texts = {r[0]: r[1] for r in got}
    assert passage in texts[3] and passage not in texts[40] and passage not in texts[41]
    assert texts[203] == ""


def test_spread_lines_of_an_empty_table(documents):
    assert linededup.remove_spread_lines(documents([])).collect() == []


# ---------------------------------------------------------- decontamination
def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(docs, items, span=13):
    windows = defaultdict(set)
    for name, text in items:
        w = item_words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(name)
    sizes = {len(g) for g in windows}
    out = []
    for key, text in docs:
        w, hit, names = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        listed = sorted(str(x) for x in names if x is not None)
        out.append((key, len(w), len(hit), len(listed),
                    hashlib.sha256(",".join(listed).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [32 << 20, 400])
def test_decontamination_equals_brute_force(spark, documents, block_bytes):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, rng.randrange(14, 60)))) for i in range(12)]
    items += [(20, "short item of five words"), (21, None), (22, ""), (23, "!!"), (24, "Aa"), (None, "null item here"),
              (25, items[0][1]), (26, " ".join(["again"] * 30))]
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(5, 400))
        own = item_words(rng.choice(items[:12])[1])
        n = rng.choice((12, 13, 14, 20))
        at = rng.randrange(max(1, len(own) - n + 1))
        place = rng.randrange(len(w))
        docs.append((i, " ".join(w[:place] + own[at:at + n] + w[place:]).title()))
    docs += [(100, None), (101, ""), (102, "--"), (103, "a short, ITEM of five-words"), (104, "null\nitem here"),
             (105, "aa bb"), (106, "again " * 40), (107, "again " * 12), (0, docs[0][1]),
             (108, " ".join(prose(rng, 20000) + item_words(items[3][1])))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.with_hits(documents(docs), bench, block_bytes=block_bytes)
    got = [(r["row"]["doc_id"], r["n_words"], r["n_hit"], len(r["items"]),
            hashlib.sha256(",".join(r["items"]).encode()).hexdigest(),
            r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in out.collect()]
    assert sorted(got, key=repr) == brute_hits(docs, items)
    for r in out.collect():  # the merged spans hold exactly the hit words
        assert sum(h["length"] for h in r["hits"]) == r["n_hit"]
    kept = decontaminate.keep_clean(documents(docs), bench, block_bytes=block_bytes)
    assert kept.columns == documents(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in got if not r[5])


def test_decontamination_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.with_hits(documents([]), none).collect() == []
    row = decontaminate.with_hits(documents([(1, "a b")]), none).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


def test_every_span_long_enough_is_found():
    """Winnowing keeps a common fingerprint of every shared span."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        span = rng.integers(0, 5, 13).astype(np.uint64)  # few words: many ties
        prints = []
        for _ in range(2):
            h = np.concatenate([rng.integers(0, 5, rng.integers(0, 30)), span,
                                rng.integers(0, 5, rng.integers(0, 30))]).astype(np.uint64)
            g = decontaminate.gram_hashes(h, 8)
            prints.append(set(g[decontaminate.winnow(g, np.ones(len(g), bool), 6)].tolist()))
        assert prints[0] & prints[1] & set(decontaminate.gram_hashes(span, 8).tolist())
