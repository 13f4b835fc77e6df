"""Pair scores as Spark column expressions (no Python UDF).

Each function takes two token-array (or string) columns of the same row and
returns the score of that pair, so a pair table of any size is scored
partition-parallel inside the stage that produced it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varietas.functions.text import ngrams

# LCS by the bit-vector recurrence fits one 64-bit word when the shorter
# side has at most this many tokens; longer pairs use several such words.
BITVECTOR_MAX_TOKENS = 62


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def occurrence_tags(a) -> Column:
    """Tag every item with its occurrence number (``x``, ``x``, ``y`` ->
    ``x#0``, ``x#1``, ``y#0``) so that multiset intersection becomes set
    intersection.  Sorting groups equal items; ``array_position`` on the
    sorted array gives the first index of each item."""
    return F.transform(F.array(F.array_sort(_col(a))), lambda s: F.transform(
        s, lambda g, k: F.concat(g, F.lit("\u0001"),
                                 (k - F.array_position(s, g) + 1).cast("string"))))[0]


def clipped_overlap(a, b) -> Column:
    """Multiset intersection size: sum over distinct items of min(count).

    Hash-based (``array_intersect`` of occurrence-tagged items), so a pair
    of long texts costs a sort, not a scan per distinct item.
    """
    return F.size(F.array_intersect(occurrence_tags(a), occurrence_tags(b)))


def bind_all(body, **cols: Column) -> Column:
    """Evaluate each named column once and call ``body(**values)``."""
    st = F.struct(*[c.alias(k) for k, c in cols.items()])
    return F.transform(F.array(st), lambda p: body(**{k: p[k] for k in cols}))[0]


def bind(a: Column, b: Column, body) -> Column:
    """Evaluate ``a`` and ``b`` once and pass them to ``body(a, b)``."""
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))),
                       lambda p: body(p["a"], p["b"]))[0]


def bleu(q_tokens, r_tokens, max_order: int = 4) -> Column:
    """Sentence BLEU of prediction ``q`` against one reference ``r``.

    Unsmoothed, uniform weights, brevity penalty ``exp(1 - |r|/|q|)`` when
    ``|q| <= |r|``.  Any order without a match (including a prediction
    shorter than ``max_order``) gives 0; an empty side gives 0 instead of a
    division error.
    """
    q, r = _col(q_tokens), _col(r_tokens)
    lq, lr = F.size(q), F.size(r)
    log_p = []
    any_zero = F.lit(False)
    for n in range(1, max_order + 1):
        possible = F.greatest(lq - n + 1, F.lit(0))
        matches = clipped_overlap(ngrams(q, n), ngrams(r, n))
        any_zero = any_zero | (possible == 0) | (matches == 0)
        log_p.append(F.log(matches.cast("double") / F.greatest(possible, F.lit(1))))
    mean_log = sum(log_p[1:], log_p[0]) / max_order
    bp = F.when(lq > lr, F.lit(1.0)).otherwise(
        F.exp(1.0 - lr.cast("double") / F.greatest(lq, F.lit(1))))
    return (F.when((lq == 0) | (lr == 0) | any_zero, F.lit(0.0))
            .otherwise(bp * F.exp(mean_log)))


def rouge_n_f(q_tokens, r_tokens, n: int = 1) -> Column:
    """ROUGE-n F1 = 2 * clipped n-gram overlap / (|q grams| + |r grams|)."""
    gq = ngrams(q_tokens, n) if n > 1 else _col(q_tokens)
    gr = ngrams(r_tokens, n) if n > 1 else _col(r_tokens)
    m = clipped_overlap(gq, gr)
    denom = F.size(gq) + F.size(gr)
    return F.when(m > 0, 2.0 * m / denom).otherwise(F.lit(0.0))


def _shl(x: Column, n: Column) -> Column:
    # F.shiftleft only accepts a literal shift count
    return F.call_function("shiftleft", x, n)


def _lcs_bitvector(s: Column, long: Column) -> Column:
    """LCS length with ``s`` (<= 62 tokens) as a bit vector.

    One step per token x of ``long``: U = V & M[x];
    V = ((V + U) | (V & ~M[x])) & mask.  LCS = |s| - popcount(V).
    """
    m = F.size(s)
    one = F.lit(1).cast("bigint")
    mask = _shl(one, m) - 1

    def match_bits(x):
        return F.aggregate(
            F.sequence(F.lit(0), m - 1), F.lit(0).cast("bigint"),
            lambda acc, j: acc.bitwiseOR(F.when(s[j] == x, _shl(one, j))
            .otherwise(F.lit(0).cast("bigint"))))

    def step(v, x):
        # bind M[x] once through a one-element aggregate
        return F.aggregate(
            F.array(match_bits(x)), v,
            lambda vv, mx: ((vv + (vv.bitwiseAND(mx))).bitwiseOR(vv.bitwiseAND(F.bitwise_not(mx))))
            .bitwiseAND(mask))

    v = F.aggregate(long, mask, step)
    return m - F.bit_count(v)


def _lcs_multiword(s: Column, long: Column) -> Column:
    """LCS length with ``s`` split over 62-bit words (any length).

    The same recurrence as :func:`_lcs_bitvector`; the addition carries
    from word to word (a fold over the words of ``s``), so a step costs
    O(|s|) for the match masks plus O(words^2) for the carry chain.
    """
    w_bits = BITVECTOR_MAX_TOKENS
    m = F.size(s)
    k = F.ceil(m / w_bits).cast("int")
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    full = F.lit((1 << w_bits) - 1).cast("bigint")

    def word_mask(w):
        return F.when(w < k - 1, full).otherwise(_shl(one, m - w * w_bits) - 1)

    def match_words(x):
        return F.transform(F.sequence(F.lit(0), k - 1), lambda w: F.aggregate(
            F.sequence(w * w_bits, F.least(w * w_bits + (w_bits - 1), m - 1)), zero,
            lambda acc, j: acc.bitwiseOR(F.when(s[j] == x, _shl(one, j - w * w_bits))
                                         .otherwise(zero))))

    def add_step(v, mx):
        start = F.struct(zero.alias("c"), F.array().cast("array<bigint>").alias("out"))

        def word(acc, w):
            vw, mw = v[w], mx[w]
            t = vw + vw.bitwiseAND(mw) + acc["c"]
            nw = (t.bitwiseAND(full).bitwiseOR(vw.bitwiseAND(F.bitwise_not(mw)))
                  .bitwiseAND(word_mask(w)))
            return F.struct(F.shiftright(t, w_bits).alias("c"),
                            F.concat(acc["out"], F.array(nw)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), k - 1), start, word)["out"]

    init = F.transform(F.sequence(F.lit(0), k - 1), word_mask)
    final = F.aggregate(long, init, lambda v, x: F.aggregate(
        F.array(match_words(x)), v, lambda v2, mx: add_step(v2, mx)))
    return m - F.aggregate(final, F.lit(0), lambda a, x: a + F.bit_count(x))


def lcs_length(a_tokens, b_tokens) -> Column:
    """Longest common subsequence length of two token arrays."""
    a, b = _col(a_tokens), _col(b_tokens)
    pair = F.struct(
        F.when(F.size(a) <= F.size(b), a).otherwise(b).alias("s"),
        F.when(F.size(a) <= F.size(b), b).otherwise(a).alias("l"))
    return F.transform(F.array(pair), lambda p: (
        F.when(F.size(p["s"]) == 0, F.lit(0))
        .when(F.size(p["s"]) <= BITVECTOR_MAX_TOKENS,
              _lcs_bitvector(p["s"], p["l"]))
        .otherwise(_lcs_multiword(p["s"], p["l"]))))[0]


def rouge_l_f(q_tokens, r_tokens) -> Column:
    """ROUGE-L F1 = 2 * LCS / (|q| + |r|) (P = L/|q|, R = L/|r|)."""
    q, r = _col(q_tokens), _col(r_tokens)
    lcs = lcs_length(q, r)
    return F.when(lcs > 0, 2.0 * lcs / (F.size(q) + F.size(r))).otherwise(F.lit(0.0))


def jaccard(q_set, r_set) -> Column:
    """|A ∩ B| / |A ∪ B| over token sets; 0 when both are empty."""
    q, r = _col(q_set), _col(r_set)
    union = F.size(F.array_union(q, r))
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, r)) / union)


def levenshtein(q, r) -> Column:
    """Character edit distance (code points), raw count."""
    return F.levenshtein(_col(q), _col(r))


def cosine(u, v) -> Column:
    """Cosine similarity of two equal-length float arrays."""
    u, v = _col(u), _col(v)

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0),
                           lambda s, z: s + z)

    denom = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(u, v) / denom)
