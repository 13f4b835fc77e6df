"""Oracle SQL (DuckDB) for every registered query that SQL can express."""

from __future__ import annotations

from oracle import sqlparts as P
from varietas.operators.stats import STOPWORDS, WORD_PATTERN

ORACLE: dict[str, str] = {}

S_DOCS = P.sentences(P.documents_corpus())
S_MULTI = P.sentences(f"{P.documents_corpus()} UNION ALL {P.conversations_corpus()}")
STOP_IN = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
WORD_RE = "(" + WORD_PATTERN.replace("'", "''") + ")"
SEP = " | "


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


# ---------------------------------------------------------------- P: rows
ORACLE["clean_and_standardize"] = S_DOCS

ORACLE["clean_text"] = (f"SELECT ds_name, doc_id, {P.clean('nl_instructions')} AS cleaned "
                        f"FROM ({P.documents_corpus()})")

ORACLE["split_sentences"] = f"""
SELECT ds_name, doc_id, CAST(len(l) AS INTEGER) AS n_sentences, array_to_string(l, '{SEP}') AS sentences
FROM (SELECT ds_name, doc_id, {P.split_sentences('nl_instructions')} AS l FROM ({P.documents_corpus()}))"""

ORACLE["explode_sentences"] = P.sentences(P.conversations_corpus())

ORACLE["drop_blank"] = f"""
SELECT * FROM (SELECT ds_name, doc_id, {P.clean('nl_instructions')} AS nl_instructions
               FROM ({P.conversations_corpus()}))
WHERE nl_instructions IS NOT NULL AND nl_instructions <> ''"""

ORACLE["drop_na"] = f"""
SELECT * FROM (SELECT ds_name, doc_id, {P.clean('nl_instructions')} AS nl_instructions
               FROM ({P.documents_corpus()}))
WHERE nl_instructions IS NOT NULL"""

ORACLE["tokenize"] = f"""
SELECT ds_name, doc_id, pos, CAST(unnest(range(len(t))) AS INTEGER) AS k, unnest(t) AS token
FROM (SELECT *, {P.tokens('nl_instructions')} AS t FROM ({S_DOCS}))"""

ORACLE["seq_len"] = f"""
SELECT ds_name, doc_id, pos, CAST(len({P.tokens('nl_instructions')}) AS INTEGER) AS seq_len
FROM ({S_DOCS})"""

# ---------------------------------------------------------------- A: stats
ORACLE["total_instructions"] = f"SELECT ds_name, count(*) AS n_rows FROM ({S_DOCS}) GROUP BY ds_name"

ORACLE["unique_commands"] = f"""
SELECT ds_name, CAST(count(DISTINCT nl_instructions) + max(CAST(nl_instructions IS NULL AS INTEGER)) AS BIGINT) AS n_unique
FROM ({S_DOCS}) GROUP BY ds_name"""

ORACLE["nunique"] = f"""
SELECT ds_name, count(DISTINCT len({P.tokens('nl_instructions')})) AS n_unique
FROM ({S_DOCS}) GROUP BY ds_name"""

ORACLE["unique_unigrams"] = f"""
SELECT ds_name, count(DISTINCT tok) AS n_unigrams
FROM (SELECT ds_name, unnest(list_append({P.tokens('nl_instructions')}, NULL)) AS tok FROM ({S_DOCS}))
GROUP BY ds_name"""

ORACLE["length_histogram"] = f"""
SELECT ds_name, CAST(len({P.tokens('nl_instructions')}) AS INTEGER) AS seq_len, count(*) AS n
FROM ({S_DOCS}) GROUP BY ALL"""

ORACLE["length_histogram_summary"] = f"""
WITH h AS (SELECT ds_name, CAST(len({P.tokens('nl_instructions')}) AS INTEGER) AS seq_len, count(*) AS n
           FROM ({S_MULTI}) GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY ds_name) AS share FROM h)
SELECT ds_name, CAST(least(seq_len, 30) AS INTEGER) AS bin, {r6('sum(share)', 'share')}
FROM sh GROUP BY ALL"""

ORACLE["word_frequency"] = f"""
WITH w AS (SELECT ds_name, unnest(regexp_extract_all(nl_instructions, '{WORD_RE}', 1)) AS word FROM ({S_DOCS})),
w2 AS (SELECT ds_name, CASE WHEN lower(word) LIKE '%''s' THEN substr(word, 1, length(word) - 2) ELSE word END AS word FROM w),
w3 AS (SELECT * FROM w2 WHERE NOT regexp_matches(word, '^\\p{{Nd}}+$') AND length(word) > 0
       AND lower(word) NOT IN ({STOP_IN})),
c AS (SELECT ds_name, lower(word) AS key, count(*) AS n FROM w3 GROUP BY ALL),
m AS (SELECT c.ds_name, coalesce(s2.key, c.key) AS key, CAST(sum(c.n) AS BIGINT) AS n FROM c
      LEFT JOIN c s2 ON s2.ds_name = c.ds_name AND c.key LIKE '%s' AND c.key NOT LIKE '%ss'
      AND s2.key = substr(c.key, 1, length(c.key) - 1) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ds_name ORDER BY n DESC, key) AS INTEGER) AS rank FROM m)
SELECT ds_name, key AS word, n, rank, {r6('n / max(n) OVER (PARTITION BY ds_name)', 'rel')}
FROM r WHERE rank <= 100"""

ORACLE["bigram_frequency"] = f"""
WITH s AS (SELECT ds_name, nl_instructions, row_number() OVER () AS sentence FROM ({S_DOCS})),
w AS (SELECT ds_name, sentence, generate_subscripts(l, 1) AS place, unnest(l) AS word FROM (
        SELECT ds_name, sentence, regexp_extract_all(nl_instructions, '{WORD_RE}', 1) AS l FROM s)),
w2 AS (SELECT ds_name, sentence, place, CASE WHEN lower(word) LIKE '%''s' THEN left(lower(word), length(word) - 2)
         ELSE lower(word) END AS word FROM w),
f AS (SELECT ds_name, word, lead(word) OVER (PARTITION BY sentence ORDER BY place) AS following
      FROM w2 WHERE word <> '' AND NOT regexp_matches(word, '^\\p{{Nd}}+$')),
c AS (SELECT ds_name, word || ' ' || following AS bigram, count(*) AS n FROM f
      WHERE following IS NOT NULL AND word NOT IN ({STOP_IN}) AND following NOT IN ({STOP_IN}) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ds_name ORDER BY n DESC, bigram) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 100"""


def _collocations(corpus: str, by: str, top: int) -> str:
    """Words and pairs whose log-likelihood ratio exceeds 30; ``by`` is the
    group column (a constant for an ungrouped run)."""
    entropy = lambda *cells: " + ".join(f"(CASE WHEN {c} > 0 THEN ({c}) * ln({c}) ELSE 0 END)" for c in cells)
    both, first, second, rest = "n", "(c1 - n)", "(c2 - n)", "(total - c1 - c2 + n)"
    # the ratio as sums of x ln x over the cells and margins of the 2 x 2 table
    llr = (f"2 * ({entropy(both, first, second, rest)} + {entropy('total')}"
           f" - ({entropy('c1', '(total - c1)', 'c2', '(total - c2)')}))")
    return f"""
WITH s AS (SELECT {by} AS g, nl_instructions, row_number() OVER () AS sentence FROM ({corpus})),
w AS (SELECT g, sentence, generate_subscripts(l, 1) AS place, unnest(l) AS word FROM (
        SELECT g, sentence, regexp_extract_all(nl_instructions, '{WORD_RE}', 1) AS l FROM s)),
w2 AS (SELECT g, sentence, place, CASE WHEN lower(word) LIKE '%''s' THEN left(lower(word), length(word) - 2)
         ELSE lower(word) END AS word FROM w),
f AS MATERIALIZED (SELECT g, word, lead(word) OVER (PARTITION BY sentence ORDER BY place) AS following
      FROM w2 WHERE word <> '' AND NOT regexp_matches(word, '^\\p{{Nd}}+$')),
u AS MATERIALIZED (SELECT g, word AS raw, count(*) AS n FROM f WHERE word NOT IN ({STOP_IN}) GROUP BY ALL),
b AS (SELECT g, word || ' ' || following AS raw, count(*) AS n FROM f
      WHERE following IS NOT NULL AND word NOT IN ({STOP_IN}) AND following NOT IN ({STOP_IN}) GROUP BY ALL),
ux AS MATERIALIZED (SELECT *, CASE WHEN raw LIKE '%s' AND raw NOT LIKE '%ss' THEN left(raw, length(raw) - 1) END AS stem FROM u),
us AS MATERIALIZED (SELECT x.g, x.raw, coalesce(o.raw, x.raw) AS std, x.n FROM ux x LEFT JOIN ux o ON o.g = x.g AND o.raw = x.stem),
ut AS (SELECT g, std, sum(n) AS n FROM us GROUP BY ALL),
bst AS MATERIALIZED (SELECT *, CASE WHEN raw LIKE '%s' AND raw NOT LIKE '%ss' THEN left(raw, length(raw) - 1) END AS stem FROM b),
bm AS (SELECT x.g, coalesce(o.raw, x.raw) AS bigram, sum(x.n) AS n FROM bst x LEFT JOIN bst o ON o.g = x.g AND o.raw = x.stem GROUP BY ALL),
bs AS (SELECT *, split_part(bigram, ' ', 1) AS r1, split_part(bigram, ' ', 2) AS r2 FROM bm),
tt AS (SELECT g, CAST(sum(n) AS DOUBLE) AS total FROM u GROUP BY g),
uc AS MATERIALIZED (SELECT g, raw, std, CAST(sum(n) OVER (PARTITION BY g, std) AS DOUBLE) AS c FROM us),
b1 AS MATERIALIZED (SELECT bs.g, bigram, CAST(bs.n AS DOUBLE) AS n, r2, uc.std AS w1, uc.c AS c1
       FROM bs JOIN uc ON uc.g = bs.g AND uc.raw = r1),
b2 AS MATERIALIZED (SELECT b1.*, uc.std AS w2, uc.c AS c2 FROM b1 JOIN uc ON uc.g = b1.g AND uc.raw = r2),
bx AS (SELECT b2.*, total FROM b2 JOIN tt ON tt.g = b2.g),
bc AS (SELECT *, CASE WHEN total <= c1 OR total <= c2 THEN 0.0 ELSE {llr} END AS score FROM bx),
ok AS (SELECT * FROM bc WHERE score > 30),
used AS (SELECT g, word, sum(n) AS n FROM (SELECT g, w1 AS word, n FROM ok UNION ALL SELECT g, w2, n FROM ok) GROUP BY ALL),
terms AS (SELECT ut.g, ut.std AS term, CAST(ut.n - coalesce(used.n, 0) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS score
          FROM ut LEFT JOIN used ON used.g = ut.g AND used.word = ut.std
          UNION ALL SELECT g, bigram, CAST(n AS BIGINT), score FROM ok),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY n DESC, term) AS INTEGER) AS rank FROM terms)
SELECT g, term, n, rank, {r6('n / max(n) OVER (PARTITION BY g)', 'rel')}, round(score, 3) AS score
FROM r WHERE rank <= {top}"""


ORACLE["collocations"] = f"SELECT g AS ds_name, * EXCLUDE g FROM ({_collocations(S_DOCS, 'ds_name', 100)})"
ORACLE["collocations_all"] = f"SELECT * EXCLUDE g FROM ({_collocations(S_MULTI, '0', 1000)})"

# ---------------------------------------------------------------- R: sampling
PAIRS = P.pairs_ctes(S_DOCS)
PAIR_KEYS = "ds_name, trial, sid, q_doc_id, q_pos, r_doc_id, r_pos"

ORACLE["sample_pairs"] = f"""WITH {PAIRS}
SELECT {PAIR_KEYS}, q_idx, r_idx, q_nl_instructions, r_nl_instructions FROM pairs"""

ORACLE["sample_pairs_all"] = f"""
WITH ix AS (SELECT *, row_number() OVER (ORDER BY ds_name, doc_id, pos) - 1 AS row_idx FROM ({S_MULTI})),
picks AS (SELECT CAST(k // 1000 AS INTEGER) AS trial, CAST(k % 1000 AS INTEGER) AS sid,
  {P.draw("z.N", f"'{P.SEED}'", "k // 1000", "k % 1000", "'q'")} AS q_idx,
  {P.draw("z.N", f"'{P.SEED}'", "k // 1000", "k % 1000", "'r'")} AS r_idx
  FROM (SELECT count(*) AS N FROM ix) z, range(0, 3000) t(k))
SELECT trial, sid, {", ".join(f"{t}.{c} AS {t}_{c}" for t in "qr" for c in ("ds_name", "doc_id", "pos", "nl_instructions"))},
  q_idx, r_idx FROM picks JOIN ix q ON q.row_idx = q_idx JOIN ix r ON r.row_idx = r_idx"""

ORACLE["shuffle"] = f"""
SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY shuffle_key, doc_id, pos) - 1 AS position FROM (
  SELECT *, md5(concat_ws('|', '{P.SEED}', ds_name, CAST(doc_id AS VARCHAR), CAST(pos AS VARCHAR))) AS shuffle_key
  FROM ({S_DOCS}))"""

_swr_draw = P.draw("z.N", f"'{P.SEED}'", "z.ds_name", "t.k // 10000", "(t.k % 10000) // 2500",
                   "t.k % 2500", "'s'")
ORACLE["sample_with_replacement"] = f"""
WITH s AS ({S_DOCS}),
ix AS (SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY doc_id, pos) - 1 AS row_idx FROM s),
sizes AS (SELECT ds_name, count(*) AS N FROM s GROUP BY ds_name),
picks AS (SELECT z.ds_name, CAST(t.k // 10000 AS INTEGER) AS trial, CAST((t.k % 10000) // 2500 AS INTEGER) AS batch,
          CAST(t.k % 2500 AS INTEGER) AS sid, {_swr_draw} AS s_idx
          FROM sizes z, range(0, 30000) t(k))
SELECT p.ds_name, p.trial, p.batch, p.sid, p.s_idx, a.doc_id AS s_doc_id, a.pos AS s_pos, a.nl_instructions
FROM picks p JOIN ix a ON a.ds_name = p.ds_name AND a.row_idx = p.s_idx"""

SCORED = f"""tk AS (SELECT *,
    {P.tokens('q_nl_instructions')} AS q_ws, {P.tokens('r_nl_instructions')} AS r_ws,
    {P.rouge_tokens('q_nl_instructions')} AS q_rg, {P.rouge_tokens('r_nl_instructions')} AS r_rg,
    {P.lower_set('q_nl_instructions')} AS q_jc, {P.lower_set('r_nl_instructions')} AS r_jc,
    {P.lev_prep('q_nl_instructions', 'r_nl_instructions')}
  FROM pairs),
tg AS (SELECT *, {P.gram_cols('q_ws', 'qb')}, {P.gram_cols('r_ws', 'rb')},
    list_sort(q_rg) AS q_rgs, list_sort(r_rg) AS r_rgs FROM tk),
scored AS (SELECT *,
    {P.bleu('qb', 'rb', 'len(q_ws)', 'len(r_ws)')} AS bleu,
    {P.rouge_l('q_rg', 'r_rg')} AS rouge_l,
    {P.rouge_1('q_rg', 'r_rg', 'q_rgs', 'r_rgs')} AS rouge_1,
    CAST({P.levenshtein_cols()} AS DOUBLE) AS levenshtein,
    {P.jaccard('q_jc', 'r_jc')} AS jaccard
  FROM tg)"""

ORACLE["trial_means"] = f"""WITH {PAIRS}, {SCORED}
SELECT ds_name, trial, {r6('avg(jaccard)', 'trial_mean')} FROM scored GROUP BY ALL"""

# the values as doubles: the report rounds them once, when it prints them
TRIAL_SUMMARY = f"""WITH {PAIRS}, {SCORED},
long AS (UNPIVOT (SELECT ds_name, trial, bleu, rouge_l, rouge_1, levenshtein, jaccard FROM scored)
         ON bleu, rouge_l, rouge_1, levenshtein, jaccard INTO NAME metric VALUE score),
m AS (SELECT ds_name, metric, trial, avg(score) AS tm FROM long GROUP BY ALL)
SELECT ds_name, metric, avg(tm) AS avg, stddev_pop(tm) AS std FROM m GROUP BY ALL"""
ORACLE["trial_summary"] = f"SELECT ds_name, metric, {r6('avg', 'avg')}, {r6('std', 'std')} FROM ({TRIAL_SUMMARY})"

for _m in ("bleu", "rouge_l", "rouge_1", "levenshtein", "jaccard"):
    ORACLE[f"{_m}_pairs"] = f"""WITH {PAIRS}, {SCORED}
SELECT {PAIR_KEYS}, {r6(_m, 'score')} FROM scored"""
    ORACLE[f"{_m}_summary"] = f"""WITH {PAIRS}, {SCORED},
m AS (SELECT ds_name, trial, avg({_m}) AS tm FROM scored GROUP BY ALL)
SELECT ds_name, {r6('avg(tm)', 'avg')}, {r6('stddev_pop(tm)', 'std')} FROM m GROUP BY ALL"""

# ---------------------------------------------------------------- D: diversity


def _ngram_diversity(corpus: str, by: str) -> str:
    return f"""
WITH t AS (SELECT {by} AS g, ds_name, doc_id, pos, unnest(range(len(tk))) AS k, unnest(tk) AS token
           FROM (SELECT *, {P.tokens('nl_instructions')} AS tk FROM ({corpus}))),
p AS (SELECT g, token, row_number() OVER (PARTITION BY g ORDER BY ds_name, doc_id, pos, k) AS p FROM t),
g AS (SELECT g, token AS g1,
        token || ' ' || lead(token, 1) OVER w AS g2,
        token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w AS g3,
        token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w || ' ' || lead(token, 3) OVER w AS g4
      FROM p WINDOW w AS (PARTITION BY g ORDER BY p)),
d AS (SELECT g, count(*) AS total, count(DISTINCT g1) AS d1, count(DISTINCT g2) AS d2,
             count(DISTINCT g3) AS d3, count(DISTINCT g4) AS d4 FROM g GROUP BY g)
SELECT g, d1 / total + (CASE WHEN total > 1 THEN d2 / (total - 1) ELSE 0 END)
  + (CASE WHEN total > 2 THEN d3 / (total - 2) ELSE 0 END)
  + (CASE WHEN total > 3 THEN d4 / (total - 3) ELSE 0 END) AS ngram_diversity, total AS n_tokens FROM d"""


NGRAM_DIVERSITY = f"SELECT g AS ds_name, * EXCLUDE g FROM ({_ngram_diversity(S_DOCS, 'ds_name')})"
ORACLE["ngram_diversity_all"] = (f"SELECT {r6('ngram_diversity', 'ngram_diversity')}, n_tokens "
                                 f"FROM ({_ngram_diversity(S_MULTI, '0')})")
ORACLE["ngram_diversity"] = f"SELECT ds_name, {r6('ngram_diversity', 'ngram_diversity')}, n_tokens FROM ({NGRAM_DIVERSITY})"


def _blocks(corpus: str, by: str, size: int) -> str:
    return f"""
WITH o AS (SELECT {by} AS g, ds_name, doc_id, pos, nl_instructions AS t,
             coalesce(sum(strlen(nl_instructions) + 1) OVER (PARTITION BY {by} ORDER BY ds_name, doc_id, pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ({corpus})),
j AS (SELECT g, CAST(off // {size} AS BIGINT) AS block, count(*) AS n_texts, string_agg(t, ' ' ORDER BY off) AS text
      FROM o GROUP BY ALL)
SELECT g, block, n_texts, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM j"""


ORACLE["compression_blocks"] = f"SELECT g AS ds_name, * EXCLUDE g FROM ({_blocks(S_DOCS, 'ds_name', 1 << 14)})"
ORACLE["compression_blocks_all"] = f"SELECT * EXCLUDE g FROM ({_blocks(S_MULTI, '0', 1 << 20)})"

_two = lambda x: (f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % 2147483647 AS {{0}}, "
                  f"CAST('0x' || substr(md5({x}), 9, 8) AS BIGINT) % 2147483647 AS {{1}}")
HOMOGENIZATION_MINHASH = f"""
WITH k AS (SELECT ds_name, doc_id, pos, {P.lower_set('nl_instructions')} AS tk FROM ({S_DOCS})),
e AS (SELECT ds_name, doc_id, pos, unnest(tk) AS token FROM k),
v AS (SELECT token, {_two('token').format('x', 'y')} FROM (SELECT DISTINCT token FROM e)),
co AS (SELECT j, {_two("'minhash ' || j").format('a', 'b')} FROM range(256) r(j)),
h AS (SELECT token, j, (x * a % 2147483647 + y * b) % 2147483647 AS h FROM v, co),
m AS (SELECT ds_name, doc_id, pos, j, min(h) AS h FROM e JOIN h USING (token) GROUP BY ALL),
c AS (SELECT ds_name, j, h, CAST(count(*) AS DOUBLE) AS c FROM m GROUP BY ALL),
q AS (SELECT ds_name, j, sum(c * (c - 1)) AS s FROM c GROUP BY ALL),
z AS (SELECT ds_name, avg(s) AS s, stddev_samp(s) / 16 AS e FROM q GROUP BY ds_name),
r AS (SELECT ds_name, count(*) AS n_rows FROM k GROUP BY ds_name)
SELECT ds_name, n_rows, n_rows * (n_rows - 1) AS n_pairs,
  CASE WHEN n_rows > 1 THEN coalesce(s, 0) / (n_rows * (n_rows - 1.0)) END AS homogenization,
  CASE WHEN n_rows > 1 THEN coalesce(e, 0) / (n_rows * (n_rows - 1.0)) END AS std_error
FROM r LEFT JOIN z USING (ds_name)"""
ORACLE["homogenization_minhash"] = (f"SELECT ds_name, n_rows, n_pairs, {r6('homogenization', 'homogenization')}, "
                                    f"{r6('std_error', 'std_error')} FROM ({HOMOGENIZATION_MINHASH})")

HPAIRS = P.pairs_ctes(S_DOCS, distinct=True)


def _homogenization(metric: str) -> str:
    return f"""WITH {HPAIRS}, {SCORED},
m AS (SELECT ds_name, trial, avg({metric}) AS tm FROM scored GROUP BY ALL)
SELECT ds_name, avg(tm) AS homogenization, stddev_pop(tm) AS std FROM m GROUP BY ALL"""


for _key, _m in (("homogenization_rougel", "rouge_l"), ("homogenization_jaccard", "jaccard")):
    ORACLE[_key] = (f"SELECT ds_name, {r6('homogenization', 'homogenization')}, {r6('std', 'std')} "
                    f"FROM ({_homogenization(_m)})")

for _key, _m in (("rougel", "rouge_l"), ("jaccard", "jaccard")):
    ORACLE[f"homogenization_{_key}_estimate"] = f"""WITH {HPAIRS}, {SCORED},
e AS (SELECT ds_name, count(*) AS n_pairs, avg({_m}) AS estimate,
        stddev_samp({_m}) / sqrt(count(*)) AS std_error FROM scored GROUP BY ds_name),
r AS (SELECT ds_name, count(*) AS n_rows FROM ({S_DOCS}) GROUP BY ds_name)
SELECT ds_name, n_rows, coalesce(n_pairs, 0) AS n_pairs, {r6('estimate', 'estimate')},
  {r6('std_error', 'std_error')} FROM r LEFT JOIN e USING (ds_name)"""

HOMOGENIZATION_COSINE = f"""
WITH k AS (SELECT ds_name, doc_id, pos, {P.tokens('nl_instructions')} AS tk FROM ({S_DOCS})),
c AS (SELECT ds_name, doc_id, pos, token, count(*) AS n
      FROM (SELECT ds_name, doc_id, pos, unnest(tk) AS token FROM k) GROUP BY ALL),
u AS (SELECT ds_name, token, n / sqrt(sum(n * n) OVER (PARTITION BY ds_name, doc_id, pos)) AS w FROM c),
q AS (SELECT ds_name, sum(s * s) AS q
      FROM (SELECT ds_name, token, sum(w) AS s FROM u GROUP BY ALL) GROUP BY ds_name),
r AS (SELECT ds_name, count(*) AS n_rows, count(*) FILTER (len(tk) > 0) AS m FROM k GROUP BY ds_name)
SELECT ds_name, n_rows, n_rows * (n_rows - 1) AS n_pairs,
  CASE WHEN n_rows > 1 THEN (coalesce(q, 0) - m) / (n_rows * (n_rows - 1.0)) END AS homogenization
FROM r LEFT JOIN q USING (ds_name)"""
ORACLE["homogenization_cosine"] = (f"SELECT ds_name, n_rows, n_pairs, {r6('homogenization', 'homogenization')} "
                                   f"FROM ({HOMOGENIZATION_COSINE})")

# ---------------------------------------------------------------- N: annotation
from varietas.operators.annotate import _DEP_LABEL, AUX_WORDS, UPOS  # noqa: E402

TAGGED = P.tagged_ctes(S_DOCS)
ANN = P.annotated_ctes(S_DOCS)

ORACLE["pos_tag"] = f"""WITH {TAGGED}
SELECT ds_name, doc_id, pos, k, token, tag, upos FROM tagged2"""

ORACLE["learn_lexicon"] = f"""WITH {TAGGED},
c AS (SELECT lower(token) AS token, tag, count(*) AS n FROM tagged2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, tag) AS rr FROM c)
SELECT token, tag, n FROM r WHERE rr = 1"""

_tag_upos = " ".join(f"WHEN {P._q(k)} THEN {P._q(v)}" for k, v in UPOS.items())
_aux = ", ".join(P._q(w) for w in AUX_WORDS)
ORACLE["pos_tag_learned"] = f"""
WITH l AS ({ORACLE["learn_lexicon"]}),
c AS (WITH {P.tagged_ctes(P.sentences(P.conversations_corpus()))} SELECT ds_name, doc_id, pos, k, token, tag FROM tagged2),
t AS (SELECT ds_name, doc_id, pos, k, c.token, coalesce(l.tag, c.tag) AS tag FROM c LEFT JOIN l ON l.token = lower(c.token))
SELECT *, CASE WHEN lower(token) IN ({_aux}) THEN 'AUX' ELSE coalesce(CASE tag {_tag_upos} END, 'X') END AS upos FROM t"""

for _key, _u, _col in (("extract_nouns", "NOUN", "nouns"), ("extract_verbs", "VERB", "verbs")):
    ORACLE[_key] = f"""WITH {ANN}
SELECT ds_name, doc_id, pos,
  array_to_string(list_filter(list_transform(range(1, len(tk) + 1), lambda i: CASE WHEN up[i] = '{_u}' THEN tk[i] END), lambda x: x IS NOT NULL), ' ') AS {_col},
  CAST(len(list_filter(up, lambda x: x = '{_u}')) AS INTEGER) AS n_{_col}
FROM ann"""

for _key, _u, _col in (("noun_frequency", "extract_nouns", "nouns"), ("verb_frequency", "extract_verbs", "verbs")):
    ORACLE[_key] = f"""
WITH w AS (SELECT ds_name, unnest(regexp_extract_all({_col}, '{WORD_RE}', 1)) AS word FROM ({ORACLE[_u]})),
w2 AS (SELECT ds_name, CASE WHEN lower(word) LIKE '%''s' THEN left(lower(word), length(word) - 2) ELSE lower(word) END AS word FROM w),
c AS (SELECT ds_name, word, count(*) AS n FROM w2
      WHERE word <> '' AND NOT regexp_matches(word, '^\\p{{Nd}}+$') AND word NOT IN ({STOP_IN}) GROUP BY ALL),
m AS (SELECT ds_name, CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss'
        AND (ds_name, left(word, length(word) - 1)) IN (SELECT (ds_name, word) FROM c)
        THEN left(word, length(word) - 1) ELSE word END AS word, n FROM c),
t AS (SELECT ds_name, word, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ds_name ORDER BY n DESC, word) AS INTEGER) AS rank FROM t)
SELECT ds_name, word, n, rank, {r6('n / max(n) OVER (PARTITION BY ds_name)', 'rel')} FROM r WHERE rank <= 100"""

_sel = lambda u: (f"array_to_string(list_filter(list_transform(range(1, len(tk) + 1), lambda i: "
                  f"CASE WHEN up[i] = '{u}' THEN tk[i] END), lambda x: x IS NOT NULL), ' ')")
ORACLE["add_features"] = f"""WITH {ANN}
SELECT ds_name, doc_id, pos, nl_instructions, nl_instructions AS spacy_parse,
  {_sel('NOUN')} AS nouns, {_sel('VERB')} AS verbs, CAST(len(tk) AS INTEGER) AS seq_len
FROM ann"""

ORACLE["tag_vocabulary"] = f"""WITH {TAGGED}
SELECT tag, count(*) AS n FROM tagged2 GROUP BY tag"""

ORACLE["shallow_tree"] = f"""WITH {ANN},
r AS (SELECT *, {P.ranks('tg')} AS rk FROM ann),
r2 AS (SELECT *, {P.starts('rk')} AS st FROM r)
SELECT ds_name, doc_id, pos, {P.shallow_tree('tk', 'tg', 'rk', 'st')} AS constituency_parse_tree FROM r2"""

_dep_case = " ".join(f"WHEN {P._q(k)} THEN {P._q(v)}" for k, v in _DEP_LABEL.items())
ORACLE["dep_tree_string"] = f"""WITH {ANN},
r AS (SELECT *, {P.ranks('tg')} AS rk,
        coalesce(list_position(list_transform(tg, lambda x: starts_with(x, 'VB')), true) - 1, 0) AS root FROM ann),
r2 AS (SELECT *, {P.starts('rk')} AS st FROM r),
d AS (SELECT ds_name, doc_id, pos, list_transform(range(0, len(tk)), lambda i:
        'head: ' || (CASE WHEN i = root THEN tk[i + 1]
                          WHEN rk[i + 1] > 0 AND coalesce(list_filter(st, lambda x: x > i)[1], len(tk)) - 1 <> i
                               THEN tk[coalesce(list_filter(st, lambda x: x > i)[1], len(tk))]
                          ELSE tk[root + 1] END)
        || ' dep: ' || (CASE WHEN i = root THEN 'ROOT'
                          WHEN rk[i + 1] > 0 AND coalesce(list_filter(st, lambda x: x > i)[1], len(tk)) - 1 <> i
                               AND rk[i + 1] = 3 THEN 'compound'
                          WHEN rk[i + 1] > 0 AND coalesce(list_filter(st, lambda x: x > i)[1], len(tk)) - 1 <> i
                               THEN coalesce(CASE tg[i + 1] {_dep_case} END, 'dep')
                          WHEN rk[i + 1] = 3 AND i > root THEN 'obj'
                          WHEN rk[i + 1] = 3 THEN 'nsubj'
                          ELSE coalesce(CASE tg[i + 1] {_dep_case} END, 'dep') END)) AS parts
      FROM r2)
SELECT ds_name, doc_id, pos, array_to_string(parts, '; ') AS dep_parse_tree FROM d"""

ORACLE["dep_vocabulary"] = f"""
SELECT regexp_extract(part, ' dep: ([A-Za-z]+)$', 1) AS label, count(*) AS n
FROM (SELECT unnest(string_split(dep_parse_tree, '; ')) AS part FROM ({ORACLE["dep_tree_string"]}) WHERE dep_parse_tree <> '')
GROUP BY ALL"""

DEP_PARSES = f"""dp AS (SELECT d.*, s.nl_instructions FROM ({ORACLE["dep_tree_string"]}) d
  JOIN ({S_DOCS}) s USING (ds_name, doc_id, pos)),
dg AS (SELECT ds_name, dep_parse_tree, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first,
  arg_min(nl_instructions, {{'d': doc_id, 'p': pos}}) AS exemplar FROM dp GROUP BY ALL),
dc AS (SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY first) - 1 AS code,
  CAST(row_number() OVER (PARTITION BY ds_name ORDER BY n DESC, dep_parse_tree) AS INTEGER) AS rank FROM dg)"""
ORACLE["common_dep_parses"] = f"""WITH {DEP_PARSES}
SELECT ds_name, dep_parse_tree, n, exemplar, code, rank FROM dc WHERE rank <= 25"""
ORACLE["dep_parse_histogram"] = f"WITH {DEP_PARSES} SELECT ds_name, code, n FROM dc"

# ------------------------------------------------- A8: common parses
PARSES = f"""{ANN},
p AS (SELECT ds_name, doc_id, pos, nl_instructions, array_to_string(tg, ' ') AS parse FROM ann),
fs AS (SELECT ds_name, parse, doc_id AS fd, pos AS fp, nl_instructions AS exemplar FROM
       (SELECT *, row_number() OVER (PARTITION BY ds_name, parse ORDER BY doc_id, pos) AS r FROM p) WHERE r = 1),
codes AS (SELECT ds_name, parse, exemplar, row_number() OVER (PARTITION BY ds_name ORDER BY fd, fp) - 1 AS code FROM fs),
cnt AS (SELECT ds_name, parse, count(*) AS n FROM p GROUP BY ALL),
top AS (SELECT cnt.*, CAST(row_number() OVER (PARTITION BY ds_name ORDER BY n DESC, parse) AS INTEGER) AS rank FROM cnt)"""

ORACLE["dictionary_encode"] = f"""WITH {PARSES}
SELECT p.ds_name, p.doc_id, p.pos, p.parse, c.code FROM p JOIN codes c USING (ds_name, parse)"""

ORACLE["top_parses"] = f"""WITH {PARSES}
SELECT ds_name, parse, n, rank FROM top WHERE rank <= 25"""

ORACLE["top_parse_exemplar"] = f"""WITH {PARSES}
SELECT t.ds_name, t.parse, t.n, f.exemplar, t.rank FROM top t JOIN fs f USING (ds_name, parse) WHERE t.rank <= 25"""

ORACLE["parse_histogram"] = f"""WITH {PARSES}
SELECT p.ds_name, c.code, count(*) AS n FROM p JOIN codes c USING (ds_name, parse) GROUP BY ALL"""

ORACLE["common_parses"] = f"""WITH {PARSES}
SELECT t.ds_name, t.parse, t.n, c.exemplar, c.code, t.rank FROM top t JOIN codes c USING (ds_name, parse)
WHERE t.rank <= 25"""

# ---------------------------------------------------------------- D4/D5: patterns, maps
_pat_draw = P.draw("z.N", f"'{P.SEED}'", "z.ds_name", "t.k // 10000", "(t.k % 10000) // 2500",
                   "t.k % 2500", "'s'")
_g4 = lambda col, part: " || ' ' || ".join(
    [col] + [f"lead({col}, {i}) OVER (PARTITION BY {part} ORDER BY p)" for i in range(1, 4)])

ORACLE["common_patterns"] = f"""WITH {ANN},
ix AS (SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY doc_id, pos) - 1 AS row_idx FROM ann),
sizes AS (SELECT ds_name, count(*) AS N FROM ann GROUP BY ds_name),
picks AS (SELECT z.ds_name, t.k // 10000 AS trial, (t.k % 10000) // 2500 AS batch, t.k % 2500 AS sid,
          {_pat_draw} AS s_idx FROM sizes z, range(0, 30000) t(k)),
sp AS (SELECT p.ds_name, p.trial, p.batch, p.sid, a.tk, a.tg FROM picks p JOIN ix a ON a.ds_name = p.ds_name AND a.row_idx = p.s_idx),
tok AS (SELECT ds_name, trial, batch, sid, unnest(range(len(tk))) AS k, unnest(tk) AS token, unnest(tg) AS tag FROM sp),
pp AS (SELECT *, row_number() OVER (PARTITION BY ds_name, trial, batch ORDER BY sid, k) AS p FROM tok),
g AS (SELECT ds_name, trial, batch, {_g4('tag', 'ds_name, trial, batch')} AS pattern,
             {_g4('token', 'ds_name, trial, batch')} AS text FROM pp),
g2 AS (SELECT * FROM g WHERE pattern IS NOT NULL),
c AS (SELECT ds_name, trial, batch, pattern, count(*) AS n FROM g2 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ds_name, trial, batch ORDER BY n DESC, pattern) AS r FROM c) WHERE r <= 5)
SELECT DISTINCT g2.ds_name, g2.pattern, g2.text FROM g2 JOIN top USING (ds_name, trial, batch, pattern)"""

ORACLE["common_patterns_full"] = f"""WITH {TAGGED},
pp AS (SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY doc_id, pos, k) AS p FROM tagged2),
g AS (SELECT ds_name, {_g4('tag', 'ds_name')} AS pattern, {_g4('token', 'ds_name')} AS text FROM pp),
g2 AS (SELECT * FROM g WHERE pattern IS NOT NULL),
c AS (SELECT ds_name, pattern, count(*) AS n FROM g2 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ds_name ORDER BY n DESC, pattern) AS r FROM c) WHERE r <= 5)
SELECT DISTINCT g2.ds_name, g2.pattern, g2.text FROM g2 JOIN top USING (ds_name, pattern)"""

ORACLE["patterns_json"] = f"""
WITH t AS (SELECT DISTINCT ds_name, pattern, text FROM ({ORACLE["common_patterns"]})),
p AS (SELECT ds_name, pattern, string_agg('        ' || to_json(text)::VARCHAR, ',' || chr(10) ORDER BY text) AS texts
      FROM t GROUP BY ALL)
SELECT ds_name, '{{' || chr(10) || string_agg('    ' || to_json(pattern)::VARCHAR || ': [' || chr(10) || texts || chr(10)
  || '    ]', ',' || chr(10) ORDER BY pattern) || chr(10) || '}}' AS patterns_json FROM p GROUP BY ds_name"""

ORACLE["merge_maps"] = """
SELECT DISTINCT event_type, key, value FROM (
  SELECT event_type, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value
  FROM (SELECT event_type, CAST(CAST(props AS JSON) AS MAP(VARCHAR, INTEGER)) AS m FROM events))"""

ORACLE["flatten_nested"] = f"""
SELECT ds_name, doc_id, CAST(len(f) AS INTEGER) AS n_tokens, array_to_string(f, ' ') AS tokens
FROM (SELECT ds_name, doc_id, flatten(list_transform({P.split_sentences('nl_instructions')},
        lambda sx: {P.tokens('sx')})) AS f FROM ({P.documents_corpus()}))"""

# ---------------------------------------------------------------- M7 / M5: trees, vectors
TREES_S = f"""SELECT r2.ds_name, r2.doc_id, r2.pos, {P.shallow_tree('tk', 'tg', 'rk', 'st')} AS nl_instructions
FROM (SELECT *, {P.starts('rk')} AS st FROM (SELECT *, {P.ranks('tg')} AS rk FROM ann)) r2"""


def _subtrees_sql(trees_sql: str) -> str:
    """CTEs tr, tt, dd, br, ee, sub over (ds_name, doc_id, pos, tree)."""
    return f"""tr AS (SELECT ds_name, doc_id, pos, regexp_extract_all(tree, '(\\(|\\)|[^\\s()]+)', 1) AS arr FROM ({trees_sql})),
tt AS (SELECT ds_name, doc_id, pos, unnest(range(len(arr))) AS k, unnest(arr) AS tok FROM tr),
dd AS (SELECT *, sum(CASE WHEN tok = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY ds_name, doc_id, pos ORDER BY k) AS dep
       FROM tt WHERE tok IN ('(', ')')),
br AS (SELECT *, CASE WHEN tok = '(' THEN dep ELSE dep + 1 END AS lv FROM dd),
ee AS (SELECT *, lead(k) OVER (PARTITION BY ds_name, doc_id, pos, lv ORDER BY k) AS e FROM br),
sub AS (SELECT ee.ds_name, ee.doc_id, ee.pos, array_to_string(tr.arr[ee.k + 1:ee.e + 1], ' ') AS subtree
        FROM ee JOIN tr USING (ds_name, doc_id, pos) WHERE ee.tok = '(')"""


ORACLE["subtrees"] = f"""WITH {ANN}, {_subtrees_sql(TREES_S.replace('AS nl_instructions', 'AS tree'))}
SELECT ds_name, doc_id, pos, subtree FROM sub"""

_TPAIRS = P.pairs_ctes(f"WITH {ANN} {TREES_S}")
_TK = f"""WITH {_TPAIRS},
trs AS (SELECT DISTINCT ds_name, q_doc_id AS doc_id, q_pos AS pos, q_nl_instructions AS tree FROM pairs
        UNION SELECT DISTINCT ds_name, r_doc_id, r_pos, r_nl_instructions FROM pairs),
{_subtrees_sql('SELECT * FROM trs')},
bags AS (SELECT ds_name, doc_id, pos, subtree, count(*) AS cnt FROM sub GROUP BY ALL),
tot AS (SELECT ds_name, doc_id, pos, sum(cnt) AS total FROM bags GROUP BY ALL),
com AS (SELECT p.ds_name, p.trial, p.sid, sum(least(a.cnt, b.cnt)) AS common FROM pairs p
        JOIN bags a ON a.ds_name = p.ds_name AND a.doc_id = p.q_doc_id AND a.pos = p.q_pos
        JOIN bags b ON b.ds_name = p.ds_name AND b.doc_id = p.r_doc_id AND b.pos = p.r_pos AND b.subtree = a.subtree
        GROUP BY ALL),
kscored AS (SELECT p.*, CASE WHEN coalesce(tq.total, 0) + coalesce(tr2.total, 0) > 0
              THEN 100.0 * coalesce(c.common, 0) / (coalesce(tq.total, 0) + coalesce(tr2.total, 0)) ELSE 0.0 END AS score
        FROM pairs p
        LEFT JOIN tot tq ON tq.ds_name = p.ds_name AND tq.doc_id = p.q_doc_id AND tq.pos = p.q_pos
        LEFT JOIN tot tr2 ON tr2.ds_name = p.ds_name AND tr2.doc_id = p.r_doc_id AND tr2.pos = p.r_pos
        LEFT JOIN com c ON c.ds_name = p.ds_name AND c.trial = p.trial AND c.sid = p.sid)"""

ORACLE["treekernel_pairs"] = f"""{_TK}
SELECT {PAIR_KEYS}, {r6('score', 'score')} FROM kscored"""

ORACLE["treekernel_summary"] = f"""{_TK},
m AS (SELECT ds_name, trial, avg(score) AS tm FROM kscored GROUP BY ALL)
SELECT ds_name, {r6('avg(tm)', 'avg')}, {r6('stddev_pop(tm)', 'std')} FROM m GROUP BY ALL"""

_VPAIRS = P.pairs_ctes("SELECT DISTINCT 'embeddings' AS ds_name, vec_id // 8 AS doc_id, 0 AS pos, "
                       "NULL AS nl_instructions FROM embeddings")
_BS = f"""WITH {_VPAIRS},
v AS (SELECT vec_id // 8 AS item, vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
sims AS (SELECT p.ds_name, p.trial, p.sid, a.vec_id AS qv, b.vec_id AS rv,
           CASE WHEN sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)) = 0 THEN 0.0
                ELSE list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) END AS c
         FROM pairs p JOIN v a ON a.item = p.q_doc_id JOIN v b ON b.item = p.r_doc_id),
pp AS (SELECT ds_name, trial, sid, avg(m) AS precision FROM (SELECT ds_name, trial, sid, qv, max(c) AS m FROM sims GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT ds_name, trial, sid, avg(m) AS recall FROM (SELECT ds_name, trial, sid, rv, max(c) AS m FROM sims GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT p.ds_name, p.trial, p.sid, p.q_doc_id, p.r_doc_id, pp.precision, rr.recall,
         CASE WHEN pp.precision + rr.recall <> 0 THEN 2 * pp.precision * rr.recall / (pp.precision + rr.recall) ELSE 0.0 END AS f1
       FROM pairs p LEFT JOIN pp USING (ds_name, trial, sid) LEFT JOIN rr USING (ds_name, trial, sid))"""

ORACLE["bertscore_pairs"] = f"""{_BS}
SELECT ds_name, trial, sid, q_doc_id, r_doc_id, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')} FROM bs"""

ORACLE["bertscore_summary"] = f"""{_BS},
m AS (SELECT ds_name, trial, avg(f1) AS tm FROM bs GROUP BY ALL)
SELECT ds_name, {r6('avg(tm)', 'avg')}, {r6('stddev_pop(tm)', 'std')} FROM m GROUP BY ALL"""

# ---------------------------------------------------------------- S / J: io and jobs
from varietas.plans.report import LINES, ORDER as REPORT_ORDER  # noqa: E402

ORACLE["scan_corpus"] = P.documents_corpus()

ORACLE["ds_name_from_path"] = ("SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS ds_name "
                               "FROM pages")

ORACLE["feature_table"] = f"""WITH {ANN},
r AS (SELECT *, {P.ranks('tg')} AS rk FROM ann),
r2 AS (SELECT *, {P.starts('rk')} AS st FROM r)
SELECT ds_name, doc_id, pos, nl_instructions, nl_instructions AS spacy_parse,
  {_sel('NOUN')} AS nouns, {_sel('VERB')} AS verbs, CAST(len(tk) AS INTEGER) AS seq_len,
  {P.shallow_tree('tk', 'tg', 'rk', 'st')} AS constituency_parse_tree
FROM r2"""


ORACLE["features_written"] = ORACLE["feature_table"]

ORACLE["read_catalog"] = """
SELECT 'documents' AS ds_name, doc_id, text AS nl_instructions FROM documents
UNION ALL SELECT 'items', item_id, text FROM benchmark"""


def _fmt4(x: str) -> str:
    return f"printf('%.4f', CAST({x} AS DOUBLE))"


def _line_sql(metric: str, v: str, s: str | None) -> str:
    head, _, rest = LINES[metric].partition("{v}")
    if "{s}" in rest:
        mid, _, tail = rest.partition("{s}")
        return f"{P._q(head)} || {v} || {P._q(mid)} || {s} || {P._q(tail)}"
    return f"{P._q(head)} || {v} || {P._q(rest)}"


def _rep(metric: str, sql: str, value: str, std: str | None, integer: bool = False) -> str:
    v = f"CAST({value} AS BIGINT)::VARCHAR" if integer else _fmt4(value)
    s = _fmt4(std) if std else None
    std_col = f"round(CAST({std} AS DOUBLE), 6)" if std else "CAST(NULL AS DOUBLE)"
    return (f"SELECT ds_name, CAST({REPORT_ORDER[metric]} AS INTEGER) AS ord, '{metric}' AS metric, "
            f"round(CAST({value} AS DOUBLE), 6) AS value, {std_col} AS std, "
            f"{_line_sql(metric, v, s)} AS line FROM ({sql}) q")


_report_parts = [
    _rep("unique_commands", ORACLE["unique_commands"], "n_unique", None, True),
    _rep("unique_unigrams", ORACLE["unique_unigrams"], "n_unigrams", None, True),
    *[_rep(m, f"SELECT * FROM ts WHERE metric = '{m}'", "avg", "std")
      for m in ("rouge_l", "rouge_1", "bleu", "levenshtein", "jaccard")],
    _rep("homogenization", _homogenization("rouge_l"), "homogenization", "std"),
    _rep("homogenization_minhash", HOMOGENIZATION_MINHASH, "homogenization", "std_error"),
    _rep("homogenization_cosine", HOMOGENIZATION_COSINE, "homogenization", None),
    _rep("ngram_diversity", NGRAM_DIVERSITY, "ngram_diversity", None),
]
ORACLE["report"] = (f"WITH ts AS MATERIALIZED ({TRIAL_SUMMARY})\n"
                    + "\nUNION ALL\n".join(_report_parts))
