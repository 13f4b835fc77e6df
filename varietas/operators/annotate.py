"""Token annotation: POS tags, nouns, verbs, lengths, shallow trees.

The statistical taggers/parsers of a single-machine pipeline are replaced by
a table job: a closed-class lexicon, suffix and shape rules for open-class
words, and one context rule.  A batch of sentences is tagged in Arrow, each
distinct word of it once, so tagging is a narrow projection (no shuffle).  A
tagger learned from tagged data (``learn_lexicon``) plugs in through
``pos_tag(..., lexicon=df)``.
"""

from __future__ import annotations

import unicodedata
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varietas.functions.text import tokenize
from varietas.operators.joins import lookup_join

TEXT = "nl_instructions"
WORDS = T.ArrayType(T.StringType())

# Closed-class English words and a few very common
# instruction words with their Penn Treebank tag, one tag per line.
_LEXICON_TEXT = """
DT the a an this that these those each every some any no another all both either neither
IN of in on at for with from by into onto over under above below behind beside between near inside outside through towards toward across along around off about against after before during without within upon than if because while until since as like
TO to
CC and or but nor
PRP i you he she it we they me him us them
PRP$ my your his its our their her
MD can could will would shall should may might must
VB be have do pick place put move open close push pull turn lift take grab go rotate slide stack drop set get bring give make knock press hold wipe flip insert remove pour fold stop stand look find use let
VBZ is has does
VBP are am
VBD was were had did
VBN been
VBG being
RB not very then now also too just again here there back away forward still only up down out
WP what who whom which
WRB where when why how
CD zero one two three four five six seven eight nine ten
JJ red green blue yellow pink purple orange black white gray grey brown small large big little left right top bottom middle new old empty full other same next last first second third
"""

LEXICON: dict[str, str] = {}
for _line in _LEXICON_TEXT.strip().splitlines():
    _tag, *_words = _line.split()
    for _w in _words:
        LEXICON.setdefault(_w, _tag)

AUX_WORDS = ("be", "is", "are", "am", "was", "were", "been", "being",
             "have", "has", "had", "do", "does", "did")

# Penn tag -> universal tag (proper nouns are PROPN, so they are not nouns).
UPOS = {
    "NN": "NOUN", "NNS": "NOUN", "NNP": "PROPN", "NNPS": "PROPN",
    "VB": "VERB", "VBD": "VERB", "VBG": "VERB", "VBN": "VERB", "VBP": "VERB", "VBZ": "VERB",
    "MD": "AUX", "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "RB": "ADV", "DT": "DET",
    "IN": "ADP", "TO": "PART", "CC": "CCONJ", "PRP": "PRON", "PRP$": "PRON", "CD": "NUM",
    "WP": "PRON", "WRB": "ADV",
}


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# Every tag the rules give, by its number.
TAGS = sorted({*LEXICON.values(), "CD", "NNP", "VBG", "VBD", "RB", "JJ", "NNS", "NN", "VB"})
_NUMBER = {tag: i for i, tag in enumerate(TAGS)}
_ADJECTIVE = ("able", "ible", "ful", "ous", "ive", "less", "ical", "ish")
# Distinct words whose tags a task keeps at hand.
KEPT_WORDS = 100_000


def rule_tag(word: str, inner: bool) -> str:
    """Tag of a word not in the lexicon, from its shape and suffix;
    ``inner``: it does not stand first in its sentence."""
    t, n = word.lower(), len(word.lower())
    if word.isascii() and word.isdigit():
        return "CD"
    if inner and unicodedata.category(word[:1] or " ") == "Lu":
        return "NNP"
    if n > 4 and t.endswith("ing"):
        return "VBG"
    if n > 3 and t.endswith("ed"):
        return "VBD"
    if n > 3 and t.endswith("ly"):
        return "RB"
    if n > 4 and t.endswith(_ADJECTIVE):
        return "JJ"
    return "NNS" if n > 3 and t.endswith("s") and not t.endswith("ss") else "NN"


# by word, from the lowest byte up: tag as the first word, tag elsewhere, in
# the lexicon, auxiliary
_known: dict[str, int] = {}


def _word(word: str) -> int:
    found = _known.get(word)
    if found is None:
        if len(_known) >= KEPT_WORDS:
            _known.clear()
        t = word.lower()
        tag = LEXICON.get(t)
        first = inner = tag or rule_tag(word, False)
        if tag is None and word[:1].isupper():
            inner = rule_tag(word, True)
        found = _known[word] = (_NUMBER[first] | _NUMBER[inner] << 8 | (tag is not None) << 16
                                | (t in AUX_WORDS) << 24)
    return found


def _lists(like: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """``values`` in lists as long as those of ``like``, null where they are."""
    ends = np.cumsum(np.asarray(pc.fill_null(like.value_lengths(), 0), np.int32), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), values,
                                    mask=like.is_null() if like.null_count else None)


def _tagged(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``(tag numbers, auxiliary)`` of all tokens of a batch: each distinct
    word is looked at once, its tags are dealt to its places as numbers."""
    coded = pc.fill_null(tokens.flatten(), "").dictionary_encode()
    codes = np.asarray(coded.indices)
    words = np.fromiter(map(_word, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
    first_tag, inner_tag, listed, auxiliary = (words >> s & 255 for s in (0, 8, 16, 24))
    sizes = np.asarray(pc.fill_null(tokens.value_lengths(), 0), np.int64)
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    tag = np.where(first, first_tag[codes], inner_tag[codes])
    after = np.zeros(len(codes), bool)
    after[1:] = np.isin(tag[:-1], [_NUMBER["TO"], _NUMBER["MD"]])
    bare = after & ~first & (listed[codes] == 0) & (tag == _NUMBER["NN"])
    return np.where(bare, _NUMBER["VB"], tag), auxiliary[codes] == 1


def _tags_of(tokens: pa.Array) -> pa.Array:
    tag, _ = _tagged(tokens)
    return _lists(tokens, pa.array(TAGS).take(pa.array(tag)))


def _upos_of(tokens: pa.Array) -> pa.Array:
    tag, auxiliary = _tagged(tokens)
    universal = [*[UPOS.get(t, "X") for t in TAGS], "AUX"]
    return _lists(tokens, pa.array(universal).take(pa.array(np.where(auxiliary, len(TAGS), tag))))


def tag_tokens(tokens: Column) -> Column:
    """``array<string>`` Penn tags for a token array.

    Lexicon words take their lexicon tag; other words take ``rule_tag``,
    except that a word tagged NN right after TO or MD becomes VB.
    """
    return F.arrow_udf(_tags_of, WORDS)(tokens)


def upos_tokens(tokens: Column) -> Column:
    """:func:`upos_tags` of the tags of :func:`tag_tokens`."""
    return F.arrow_udf(_upos_of, WORDS)(tokens)


def upos_tags(tokens: Column, tags: Column) -> Column:
    """Universal tags; be/have/do forms and modals are AUX."""
    umap = _map_literal(UPOS)
    return F.transform(F.arrays_zip(tokens.alias("o"), tags.alias("t")), lambda z: F.when(
        F.lower(z["o"]).isin(*AUX_WORDS), F.lit("AUX")).otherwise(
        F.coalesce(F.try_element_at(umap, z["t"]), F.lit("X"))))


def pos_tag(S: DataFrame, text_col: str = TEXT, lexicon: DataFrame | None = None) -> DataFrame:
    """Add ``tokens``, ``tags`` (Penn) and ``upos`` arrays to every row.

    With ``lexicon`` (``token, tag``; e.g. from :func:`learn_lexicon`), a
    lexicon tag overrides the built-in one whatever the token's case: tokens
    are exploded, joined to the lexicon (broadcast only if its measured bytes
    allow it, else salted, as a frequent word is a hot key) and regrouped by
    the row key ``(ds_name, doc_id, pos)``.  Entries that differ in case only
    are one: their counts ``n`` (1 each without such a column) are added and
    the most frequent tag stays, the smallest of equals.
    """
    out = S.withColumn("tokens", tokenize(text_col))
    out = out.withColumn("tags", tag_tokens(F.col("tokens")))
    if lexicon is not None:
        keys = ["ds_name", "doc_id", "pos"]
        seen = F.col("n") if "n" in lexicon.columns else F.lit(1)
        lex = lexicon.groupBy(F.lower("token").alias("_lt"), "tag").agg(F.sum(seen).alias("n")) \
            .groupBy("_lt").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("_ltag"))
        ex = out.select(*keys, F.posexplode(F.arrays_zip("tokens", "tags")).alias("_k", "_z")) \
            .withColumn("_lt", F.lower("_z.tokens"))
        ex = lookup_join(ex, lex, ["_lt"], "doc_id", "left")
        fixed = ex.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
            "_k", F.coalesce("_ltag", "_z.tags").alias("tag")))).alias("_kt"))
        out = out.drop("tags").join(
            fixed.select(*keys, F.transform("_kt", lambda x: x["tag"]).alias("tags")),
            on=keys, how="left")
        out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        return out.withColumn("upos", upos_tags(F.col("tokens"), F.col("tags")))
    return out.withColumn("upos", upos_tokens(F.col("tokens")))


def tagged_tokens(T: DataFrame, keys: Sequence[str] = ("ds_name", "doc_id", "pos")) -> DataFrame:
    """One row per token: ``keys, k, token, tag, upos``; without ``upos`` where
    ``T`` comes without it."""
    found = [(c, a) for c, a in (("tokens", "token"), ("tags", "tag"), ("upos", "upos")) if c in T.columns]
    z = F.arrays_zip(*[F.col(c).alias(a) for c, a in found])
    return T.select(*keys, F.posexplode(z).alias("k", "_z")).select(*keys, "k", *[f"_z.{a}" for _, a in found])


def learn_lexicon(tokens: DataFrame, token_col: str = "token", tag_col: str = "tag") -> DataFrame:
    """Most frequent tag per (lower-cased) token; ties -> smallest tag.

    The ranking window is partitioned by token, so each window holds one
    token's distinct tags only.
    """
    counts = tokens.groupBy(F.lower(token_col).alias("token"), F.col(tag_col).alias("tag")) \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("token").orderBy(F.col("n").desc(), F.col("tag"))
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def select_by_upos(tokens: Column, upos: Column, wanted: str) -> Column:
    """Tokens whose universal tag is ``wanted``, in order, duplicates kept."""
    return F.filter(tokens, lambda _, i: F.get(upos, i) == wanted)


def add_features(S: DataFrame, text_col: str = TEXT, nouns: bool = True, verbs: bool = True,
                 seq_len: bool = True, spacy_col: str | None = "spacy_parse") -> DataFrame:
    """Copy the text and add only the requested feature columns."""
    T = pos_tag(S, text_col)
    out = T
    if spacy_col:
        out = out.withColumn(spacy_col, F.col(text_col))
    if nouns:
        out = out.withColumn("nouns", select_by_upos(F.col("tokens"), F.col("upos"), "NOUN"))
    if verbs:
        out = out.withColumn("verbs", select_by_upos(F.col("tokens"), F.col("upos"), "VERB"))
    if seq_len:
        out = out.withColumn("seq_len", F.size("tokens"))
    return out


def tag_vocabulary(T: DataFrame, tag_col: str = "tags") -> DataFrame:
    """The tag set in use, with how often each tag occurs."""
    return T.select(F.explode(tag_col).alias("tag")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------- shallow trees
_RANK = {"DT": 1, **dict.fromkeys(("JJ", "JJR", "JJS"), 2), **dict.fromkeys(("NN", "NNS", "NNP", "NNPS"), 3)}


class _Chunks:
    """Chunks of all sentences of a batch, as arrays over its tokens: a
    maximal DT? JJ* NN+ run is one chunk; every other token is its own.

    ``rank`` of the tag, ``start``: the token opens a chunk, ``last``: place
    of the chunk's last token, ``begin``: place of the sentence's first one,
    ``codes`` into ``names``, the distinct tags."""

    def __init__(self, tokens: pa.ListArray, tags: pa.ListArray) -> None:
        self.words, self.tags = tokens.flatten(), tags.flatten()
        coded = self.tags.dictionary_encode()
        self.names, self.codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        sizes = np.asarray(pc.fill_null(tokens.value_lengths(), 0), np.int64)
        n = len(self.codes)
        self.begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.rank = r = self.of_tag(_RANK, 0)
        before = np.concatenate([np.zeros(min(n, 1), r.dtype), r[:-1]])
        self.start = (np.arange(n) == self.begin) | (r == 0) | (before == 0) | (r < before) | ((r == 1) & (before == 1))
        opened = np.flatnonzero(self.start)
        ends = np.append(opened, n)[1:]
        self.last = np.repeat(ends, ends - opened) - 1

    def of_tag(self, table: dict, otherwise) -> np.ndarray:
        return np.array([table.get(t, otherwise) for t in self.names] or [otherwise])[self.codes]


def _joined(parts: pa.Array, like: pa.ListArray) -> pa.Array:
    return pc.binary_join(_lists(like, parts), " ")


def _tree_of(tokens: pa.Array, tags: pa.Array) -> pa.Array:
    c = _Chunks(tokens, tags)
    noun = c.rank[c.last] == 3
    opening = pa.array(["(", "(NP ("]).take(pa.array((noun & c.start).astype(np.int8)))
    closing = pa.array([")", "))"]).take(pa.array((noun & (np.arange(len(noun)) == c.last)).astype(np.int8)))
    leaves = pc.binary_join_element_wise(opening, c.tags, " ", c.words, closing, "")
    return pc.binary_join_element_wise("(S ", _joined(leaves, tokens), ")", "")


def shallow_tree(tokens: Column, tags: Column) -> Column:
    """Bracketed shallow parse ``(S (VB lift) (NP (DT the) (NN box)))``.

    Chunks with a noun are wrapped in ``(NP ...)``, other tokens stay bare
    leaves.  O(tokens) per batch, in Arrow.
    """
    return F.arrow_udf(_tree_of, T.StringType())(tokens, tags)


def shallow_tree_of_text(text: Column) -> Column:
    """Shallow tree straight from a sentence column (tokenise, tag, bracket)."""
    toks = tokenize(text)
    return shallow_tree(toks, tag_tokens(toks))


# --------------------------------------------------------- dependency string
_DEP_LABEL = {"DT": "det", "JJ": "amod", "JJR": "amod", "JJS": "amod", "CD": "nummod",
              "CC": "cc", "IN": "prep", "TO": "aux", "MD": "aux", "RB": "advmod",
              "PRP$": "poss", "PRP": "nsubj"}


def _dependencies_of(tokens: pa.Array, tags: pa.Array) -> pa.Array:
    c = _Chunks(tokens, tags)
    place, n = np.arange(len(c.codes)), len(c.codes)
    # the sentence's first verb, else its first token
    verb = np.array([t is not None and t.startswith("VB") for t in c.names] or [False])[c.codes]
    places = np.flatnonzero(verb)
    sentence, first = np.unique(c.begin[places], return_index=True)
    root_of = np.arange(n)
    root_of[sentence] = places[first]
    root = root_of[c.begin]
    inside = (c.rank > 0) & (c.last != place)
    head = np.where(place == root, place, np.where(inside, c.last, root))
    label = c.of_tag(_DEP_LABEL, "dep").astype(object)
    noun = c.rank == 3
    label[noun & ~inside] = np.where(place > root, "obj", "nsubj")[noun & ~inside]
    label[noun & inside] = "compound"
    label[place == root] = "ROOT"
    found = pa.StructArray.from_arrays([c.words.take(pa.array(head)), pa.array(label, pa.string())], ["head", "dep"])
    return _lists(tokens, found)


def dependency_struct(tokens: Column, tags: Column) -> Column:
    """A dependency structure from the shallow chunks:
    ``struct<tokens: array<struct<head, dep>>>``.

    Root = first verb (else first token).  Inside a noun chunk every token
    depends on the chunk's last token ("compound" for nouns, tag labels for
    the rest); chunk heads and other tokens depend on the root ("obj" after
    the root, "nsubj" before it for nouns).
    """
    kind = T.ArrayType(T.StructType([T.StructField("head", T.StringType()), T.StructField("dep", T.StringType())]))
    return F.struct(F.arrow_udf(_dependencies_of, kind)(tokens, tags).alias("tokens"))


def dep_tree_string(dep: Column) -> Column:
    """``head: H dep: D; head: ...`` from ``struct<tokens: array<struct<head, dep>>>``."""
    return F.array_join(F.transform(dep["tokens"], lambda t: F.concat(
        F.lit("head: "), t["head"].cast("string"), F.lit(" dep: "), t["dep"])), "; ")
