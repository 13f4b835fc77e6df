"""DuckDB SQL fragments that mirror the Spark expressions of ``varietas``.

These build the oracle SQL of ``__spark_entry__.oracle_sql()``; they are
test tooling, not part of the library.  Fragments take SQL expressions (as
strings) and return SQL expressions.
"""

from __future__ import annotations

from varietas.functions.text import PUNCTUATION

# Python's whitespace set written out for RE2 (whose \s is ASCII-only).
WS = (r"[\t\n\x0b\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PUNCT = PUNCTUATION.replace("'", "''")
SEED = "0"


def clean(x: str) -> str:
    return (f"nullif(translate(trim(regexp_replace({x}, '{WS}+', ' ', 'g')), "
            f"'{PUNCT}', ''), '')")


def split_sentences(x: str) -> str:
    pieces = f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    return (f"list_filter(list_transform({pieces}, lambda sp: {clean('sp')}), "
            f"lambda sp: sp IS NOT NULL)")


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda tk: tk <> '')"


def rouge_tokens(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            f"lambda tk: tk <> '')")


def lower_set(x: str) -> str:
    return f"list_distinct({tokens(f'lower({x})')})"


def ngrams(t: str, n: int) -> str:
    return (f"(CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda gi: array_to_string({t}[gi:gi + {n - 1}], ' ')) ELSE []::VARCHAR[] END)")


def tags(sorted_list: str) -> str:
    """Occurrence-tagged items of an already sorted list (multiset -> set)."""
    return (f"list_transform({sorted_list}, lambda g, k: g || chr(1) || "
            f"CAST(k - list_position({sorted_list}, g) AS VARCHAR))")


def overlap_sorted(a: str, b: str) -> str:
    """Clipped overlap of two sorted lists (column references)."""
    return f"len(list_intersect({tags(a)}, {tags(b)}))"


def gram_cols(t: str, prefix: str) -> str:
    """Select-list columns ``{prefix}_g1..g4``: sorted n-gram lists of ``t``."""
    return ", ".join(f"list_sort({ngrams(t, n)}) AS {prefix}_g{n}" for n in range(1, 5))


def bleu(qp: str, rp: str, ql: str, rl: str) -> str:
    """BLEU-4 from the sorted n-gram columns of :func:`gram_cols` and the
    token counts ``ql``, ``rl``."""
    ms = [overlap_sorted(f"{qp}_g{n}", f"{rp}_g{n}") for n in range(1, 5)]
    logs = " + ".join(f"ln(({m}) / ({ql} - {n - 1}))" for n, m in enumerate(ms, 1))
    zero = " OR ".join(f"({m}) = 0" for m in ms)
    return (f"(CASE WHEN {ql} < 4 OR {rl} = 0 OR {zero} THEN 0.0 ELSE "
            f"(CASE WHEN {ql} > {rl} THEN 1.0 ELSE exp(1 - {rl} / {ql}) END)"
            f" * exp(({logs}) / 4) END)")


def lcs(s: str, l: str) -> str:
    """LCS length; ``s`` should be the shorter list (inner loop)."""
    return (f"list_reduce({l}, lambda prev, x: list_reduce(range(1, len({s}) + 1), "
            f"lambda cur, j: list_append(cur, CASE WHEN {s}[j] = x THEN prev[j] + 1 "
            f"ELSE greatest(prev[j + 1], cur[j]) END), [0]), "
            f"list_resize([0], len({s}) + 1, 0))[len({s}) + 1]")


def lcs_sym(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) <= len({b}) THEN {lcs(a, b)} ELSE {lcs(b, a)} END)")


def rouge_l(a: str, b: str) -> str:
    L = lcs_sym(a, b)
    return f"(CASE WHEN {L} > 0 THEN 2.0 * {L} / (len({a}) + len({b})) ELSE 0.0 END)"


def rouge_1(a: str, b: str, a_sorted: str, b_sorted: str) -> str:
    """ROUGE-1 F1 over two token-list columns and their sorted copies."""
    m = overlap_sorted(a_sorted, b_sorted)
    return f"(CASE WHEN {m} > 0 THEN 2.0 * {m} / (len({a}) + len({b})) ELSE 0.0 END)"


def jaccard(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {u} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / {u} END)"


def chars(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END)"


def _lev_dp(s: str, l: str) -> str:
    return (f"list_reduce({l}, lambda prev, x: list_reduce(range(1, len({s}) + 1), "
            f"lambda cur, j: list_append(cur, least(prev[j + 1] + 1, cur[j] + 1, "
            f"prev[j] + CASE WHEN {s}[j] = x THEN 0 ELSE 1 END)), [prev[1] + 1]), "
            f"range(0, len({s}) + 1))[len({s}) + 1]")


def lev_prep(a: str, b: str, prefix: str = "lv") -> str:
    """Select-list columns for :func:`levenshtein_cols`: both sides as code
    point lists and the pair's alphabet, computed once per row."""
    ca, cb = chars(a), chars(b)
    return (f"{ca} AS {prefix}_a, {cb} AS {prefix}_b, "
            f"list_distinct(list_concat({ca}, {cb})) AS {prefix}_alpha")


def levenshtein_cols(prefix: str = "lv") -> str:
    """Code-point edit distance over the columns of :func:`lev_prep`.

    DuckDB's levenshtein counts bytes, so each pair's characters are first
    re-coded to single bytes (an injective map over the pair's own
    alphabet); alphabets above 127 characters use the row DP."""
    a, b, alpha = f"{prefix}_a", f"{prefix}_b", f"{prefix}_alpha"
    enc = (lambda c: f"array_to_string(list_transform({c}, lambda ch: chr(list_position({alpha}, ch))), '')")
    return (f"(CASE WHEN len({alpha}) <= 127 THEN levenshtein({enc(a)}, {enc(b)}) "
            f"WHEN len({a}) <= len({b}) THEN {_lev_dp(a, b)} ELSE {_lev_dp(b, a)} END)")


def documents_corpus() -> str:
    return "SELECT source AS ds_name, doc_id, text AS nl_instructions FROM documents"


def conversations_corpus() -> str:
    return ("SELECT 'conversations' AS ds_name, conv_id::bigint * 4294967296 + turn AS doc_id, "
            "text AS nl_instructions FROM conversations")


def sentences(corpus_sql: str) -> str:
    """Sentence table S over a corpus select (ds_name, doc_id, nl_instructions)."""
    return (f"SELECT ds_name, doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, "
            f"unnest(l) AS nl_instructions FROM (SELECT ds_name, doc_id, "
            f"{split_sentences('nl_instructions')} AS l FROM ({corpus_sql}))")


def draw(n_expr: str, *parts: str) -> str:
    tag = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {tag})), 1, 12))::BIGINT % {n_expr})"


def pairs_ctes(s_sql: str, n: int = 1000, trials: int = 3, distinct: bool = False) -> str:
    """CTEs ``s, ix, sizes, picks, pairs``: the sampled pairs with texts."""
    q = draw("z.N", f"'{SEED}'", "z.ds_name", f"t.k // {n}", f"t.k % {n}", "'q'")
    if distinct:
        rr = draw("(z.N - 1)", f"'{SEED}'", "z.ds_name", f"t.k // {n}", f"t.k % {n}", "'r'")
        r = f"(CASE WHEN {rr} >= {q} THEN {rr} + 1 ELSE {rr} END)"
    else:
        r = draw("z.N", f"'{SEED}'", "z.ds_name", f"t.k // {n}", f"t.k % {n}", "'r'")
    minn = 1 if distinct else 0
    return f"""s AS ({s_sql}),
ix AS (SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY doc_id, pos) - 1 AS row_idx FROM s),
sizes AS (SELECT ds_name, count(*) AS N FROM s GROUP BY ds_name),
picks AS (SELECT z.ds_name, CAST(t.k // {n} AS INTEGER) AS trial, CAST(t.k % {n} AS INTEGER) AS sid,
          {q} AS q_idx, {r} AS r_idx
          FROM sizes z, range(0, {trials * n}) t(k) WHERE z.N > {minn}),
pairs AS (SELECT p.ds_name, p.trial, p.sid, p.q_idx, p.r_idx,
          a.doc_id AS q_doc_id, a.pos AS q_pos, a.nl_instructions AS q_nl_instructions,
          b.doc_id AS r_doc_id, b.pos AS r_pos, b.nl_instructions AS r_nl_instructions
          FROM picks p JOIN ix a ON a.ds_name = p.ds_name AND a.row_idx = p.q_idx
          JOIN ix b ON b.ds_name = p.ds_name AND b.row_idx = p.r_idx)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tagged_ctes(s_sql: str) -> str:
    """CTEs ``s, t, lex, b, tagged``: one row per token with tag and upos,
    mirroring ``varietas.operators.annotate`` (same lexicon dict)."""
    from varietas.operators.annotate import AUX_WORDS, LEXICON, UPOS
    lex_rows = ", ".join(f"({_q(w)}, {_q(t)})" for w, t in LEXICON.items())
    upos_case = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in UPOS.items())
    aux = ", ".join(_q(w) for w in AUX_WORDS)
    lt = "lower(token)"
    rule = (f"CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'CD' "
            f"WHEN k > 0 AND regexp_matches(token, '^\\p{{Lu}}') THEN 'NNP' "
            f"WHEN length({lt}) > 4 AND ends_with({lt}, 'ing') THEN 'VBG' "
            f"WHEN length({lt}) > 3 AND ends_with({lt}, 'ed') THEN 'VBD' "
            f"WHEN length({lt}) > 3 AND ends_with({lt}, 'ly') THEN 'RB' "
            f"WHEN length({lt}) > 4 AND regexp_matches({lt}, '(able|ible|ful|ous|ive|less|ical|ish)$') THEN 'JJ' "
            f"WHEN length({lt}) > 3 AND ends_with({lt}, 's') AND NOT ends_with({lt}, 'ss') THEN 'NNS' "
            f"ELSE 'NN' END")
    return f"""s AS ({s_sql}),
t AS (SELECT ds_name, doc_id, pos, nl_instructions, CAST(unnest(range(len(tk))) AS INTEGER) AS k, unnest(tk) AS token
      FROM (SELECT *, {tokens('nl_instructions')} AS tk FROM s)),
lex(w, lt) AS (VALUES {lex_rows}),
b AS (SELECT t.*, lex.lt AS lexhit, coalesce(lex.lt, {rule}) AS base FROM t LEFT JOIN lex ON lex.w = lower(t.token)),
tagged AS (SELECT ds_name, doc_id, pos, nl_instructions, k, token,
    CASE WHEN lexhit IS NULL AND k > 0 AND base = 'NN'
              AND lag(base) OVER (PARTITION BY ds_name, doc_id, pos ORDER BY k) IN ('TO', 'MD') THEN 'VB'
         ELSE base END AS tag
  FROM b),
tagged2 AS (SELECT *, CASE WHEN lower(token) IN ({aux}) THEN 'AUX' ELSE coalesce(CASE tag {upos_case} END, 'X') END AS upos
  FROM tagged)"""


def annotated_ctes(s_sql: str) -> str:
    """``tagged_ctes`` plus ``ann``: per sentence token/tag/upos lists
    (sentences with no token keep empty lists)."""
    return f"""{tagged_ctes(s_sql)},
agg AS (SELECT ds_name, doc_id, pos, list(token ORDER BY k) AS tk, list(tag ORDER BY k) AS tg,
               list(upos ORDER BY k) AS up FROM tagged2 GROUP BY ds_name, doc_id, pos),
ann AS (SELECT s.ds_name, s.doc_id, s.pos, s.nl_instructions,
               coalesce(agg.tk, []::VARCHAR[]) AS tk, coalesce(agg.tg, []::VARCHAR[]) AS tg,
               coalesce(agg.up, []::VARCHAR[]) AS up
        FROM s LEFT JOIN agg USING (ds_name, doc_id, pos))"""


def ranks(tg: str) -> str:
    return (f"list_transform({tg}, lambda x: CASE WHEN x = 'DT' THEN 1 WHEN x IN ('JJ', 'JJR', 'JJS') THEN 2 "
            f"WHEN x IN ('NN', 'NNS', 'NNP', 'NNPS') THEN 3 ELSE 0 END)")


def starts(rk: str) -> str:
    """0-based chunk start indexes from a rank-list column."""
    return (f"list_filter(range(0, len({rk})), lambda i: i = 0 OR {rk}[i + 1] = 0 OR {rk}[i] = 0 "
            f"OR {rk}[i + 1] < {rk}[i] OR ({rk}[i + 1] = 1 AND {rk}[i] = 1))")


def shallow_tree(tk: str, tg: str, rk: str, st: str) -> str:
    lv = f"list_transform(range(1, len({tk}) + 1), lambda i: '(' || {tg}[i] || ' ' || {tk}[i] || ')')"
    e = f"(CASE WHEN c < len({st}) THEN {st}[c + 1] ELSE len({tk}) END)"
    a = f"{st}[c]"
    body = f"array_to_string(({lv})[{a} + 1:{e}], ' ')"
    chunk = f"CASE WHEN list_max({rk}[{a} + 1:{e}]) = 3 THEN '(NP ' || {body} || ')' ELSE {body} END"
    return (f"(CASE WHEN len({tk}) = 0 THEN '(S )' ELSE '(S ' || array_to_string("
            f"list_transform(range(1, len({st}) + 1), lambda c: {chunk}), ' ') || ')' END)")
