"""Personal data against plain rules and a bootstrap over dictionaries."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pyarrow.parquet as pq

from varietas.llm import private_data as P

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain_base(text):
    """The rules as they are stated, one search for each kind."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def plain_spans(texts, rounds=3):
    """All spans of each text, by a bootstrap over dictionaries."""
    base = [plain_base(t) for t in texts]
    loose = [P.candidates(t, b) for t, b in zip(texts, base)]
    seed, allowed, holds = {}, defaultdict(int), defaultdict(set)
    for t, b, c in zip(texts, base, loose):
        for a, k, z in b:
            v = P.value_of(k, t[a:z])
            seed[v] = min(k, seed.get(v, 9))
            for p in P.patterns_at(t, a, z):
                holds[p].add(v)
        for a, z, bits, v in c:
            allowed[v] |= bits
            for p in P.patterns_at(t, a, z):
                holds[p].add(v)
    learned = {}
    for _ in range(rounds):
        doubt = defaultdict(float)
        for values in holds.values():
            mass, undecided = [0.0] * 4, 0
            for v in values:
                if v in seed:
                    mass[seed[v]] += 1
                elif v in learned:
                    mass[learned[v][0]] += learned[v][1]
                else:
                    undecided += 1
            if not undecided:
                continue
            for k in range(4):
                c = mass[k] / (sum(mass) + undecided / 4 + 1)
                if mass[k] >= 3 and c >= 0.7:
                    for v in values:
                        if v not in seed and allowed[v] >> k & 1:
                            doubt[v, k] += math.log1p(-c)
        learned = {}
        for (v, k), d in sorted(doubt.items(), key=lambda x: (x[1], x[0][1])):
            if 1 - math.exp(d) >= 0.9:
                learned.setdefault(v, (k, 1 - math.exp(d)))
    kind = {**{v: k for v, (k, _) in learned.items()}, **seed}
    return [sorted(b + [(a, kind[v], z) for a, z, bits, v in c if v in kind and bits >> kind[v] & 1])
            for b, c in zip(base, loose)]


def joined(places):
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in places)


def expected(rows):
    texts = [t or "" for _, t in rows]
    return sorted((repr(i), *(sum(p[1] == k for p in plain_base(t)) for k in range(4)),
                   hashlib.sha256(joined(plain_base(t)).encode()).hexdigest(), joined(s))
                  for (i, _), t, s in zip(rows, texts, plain_spans(texts)))


def query(spark, tmp_path, documents, rows):
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.op12_personal_data(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return sorted((repr(r[0]), *r[1:]) for r in out.collect())


def noise(rng):
    parts = ["a@b.c", "x_y+z@host-1.example.com", "@", "..@a.b.", "a@b", "1.2.3.4", "256.1.1.1", "001.02.3.255.7",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (499) 555-6503", "+44", "+1+23",
             "+(555) 1234567890", "é", "一", " ", "-", ".", "(", ")", "7", "12", "word", "\n", "_q@r.st", "1234567890123456"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " ", "."]) for _ in range(rng.randrange(14)))


def test_base_spans_equal_the_stated_rules():
    rng = random.Random(1)
    found = 0
    for _ in range(5000):
        text = noise(rng)
        assert P.base_spans(text) == plain_base(text), text
        found += len(plain_base(text))
    assert found > 3000


def test_bootstrap_finds_identifiers_that_no_rule_finds(spark, documents, tmp_path):
    rows = [(i, f"please ring me under +49 30 90{i:04}{i * 37 % 10000:04} today") for i in range(9)]
    rows += [(20 + i, f"write to the mailbox u{i}@site{i}.org soon") for i in range(9)]
    rows += [(40, "please ring me under 030 5550147 today"),  # no plus
             (41, "write to the mailbox root@intranet soon"),  # no dot
             (42, "write to the mailbox ann at site dot org soon"),  # spelled out
             (43, "order number 0305550199 shipped"),  # no such context
             (44, "my digits 49 30 900003 0111 again"),  # a seed's value in another form
             (45, "elsewhere 030-5550147 stands alone"),  # a learned value in another place
             (46, None), (47, ""), (None, "please ring me under +49 30 12345678 today"), (48, "x"), (48, "x")]
    got = query(spark, tmp_path, documents, rows)
    assert got == expected(rows)
    spans = {r[0]: r[-1] for r in got}
    assert spans["40"] == "phone:21:32" and spans["45"] == "phone:10:21"
    assert spans["41"] == "email:21:34" and spans["42"] == "email:21:40"
    assert spans["43"] == "" and spans["44"] == "phone:10:27"


def test_later_rounds_use_what_earlier_ones_found(spark, documents):
    rows = [(i, f"dial the number +1 202 55501{i:02} now") for i in range(8)]
    rows += [(10 + i, f"dial the number 5550{i}001 now and or my line 5550{i}001 ok") for i in range(6)]
    rows += [(30, "or my line 77712345 ok")]
    def spans(rounds):
        found = P.personal_data(documents(rows), rounds=rounds).collect()
        return {r["ident"]: [(p["start"], p["kind"], p["stop"]) for p in r["places"]] for r in found}
    texts = [t for _, t in rows]
    for rounds in (1, 2):
        got = spans(rounds)
        assert [got[i] for i, _ in rows] == plain_spans(texts, rounds)
    assert spans(1)[30] == [] and spans(2)[30] == [(11, 3, 19)]


def test_contexts_of_mixed_kinds_teach_nothing(spark, documents, tmp_path):
    rows = [(i, f"see the value +49 30 90{i:04}1234 there") for i in range(6)]
    rows += [(20 + i, f"see the value 10.0.0.{i} there") for i in range(6)]
    rows += [(40, "see the value 5550123456 there")]
    got = query(spark, tmp_path, documents, rows)
    assert got == expected(rows)
    assert {r[0]: r[-1] for r in got}["40"] == ""


def test_hot_value_and_hot_context(spark, documents, tmp_path):
    rows = [(i, "mail the office info@example.org or info@example now") for i in range(300)]
    rows += [(1000 + i, f"mail the office p{i}@example.org or p{i}@example now") for i in range(30)]
    assert query(spark, tmp_path, documents, rows) == expected(rows)


def test_very_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000,
                 "(1) " * 100_000, "ab at " * 70_000 + "dot", "a:" * 200_000, "@" * 400_000, "1-" * 200_000,
                 "a" * 200_000 + "@" + "b" * 200_000, "a at b dot " * 40_000):
        start = time.process_time()
        base = P.base_spans(text)
        for a, b, _, _ in P.candidates(text, base):
            P.patterns_at(text, a, b)
        assert time.process_time() - start < 5


def test_empty_table(spark, documents, tmp_path):
    assert query(spark, tmp_path, documents, []) == []


def test_query_equals_plain_version(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted((repr(r[0]), *r[1:]) for r in P.op12_personal_data(spark, sf_dir).collect())
    assert got == expected(list(zip(rows["doc_id"], rows["text"])))
