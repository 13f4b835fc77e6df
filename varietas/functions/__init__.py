"""Column expressions (JVM-side): text cleaning, tokens, n-grams, pair scores."""

from varietas.functions.similarity import (bleu, clipped_overlap, cosine, jaccard,
                                           lcs_length, levenshtein, rouge_l_f, rouge_n_f)
from varietas.functions.text import (PUNCTUATION, clean_text, lower_tokens, ngrams,
                                     rouge_tokens, split_sentences, tokenize)

__all__ = [
    "PUNCTUATION", "clean_text", "split_sentences", "tokenize", "lower_tokens",
    "rouge_tokens", "ngrams", "bleu", "clipped_overlap", "rouge_n_f", "rouge_l_f",
    "lcs_length", "jaccard", "levenshtein", "cosine",
]
