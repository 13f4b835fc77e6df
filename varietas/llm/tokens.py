"""Whole-text token ids through the tokenizers library.

The vocabulary's pre-tokenizer never lets a token cross white space, so a
text's ids are the ids of its white-space-separated chunks in order.  A task
therefore encodes every distinct chunk once and looks the others up; the
result equals encoding the whole text (``tests/llm`` compare them).  A text
that holds ``<|``, the start of the vocabulary's special tokens, is encoded
whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from varietas.llm.common import ship_by_value

# Distinct chunks a worker remembers (about 170 bytes each).
CHUNK_CACHE = 600_000
# Letters of which any run is one pre-token, in either case.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[{LATIN}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine (any machine that
    has the tokenizers also has the files)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts.  ``pool`` holds the ids of the chunks seen, one after the
    other; ``seen`` numbers the chunks and ``bounds`` says where each ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {"": 0}
        self.pool = array("I")
        self.bounds = array("q", [0, 0])

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Runs of Latin letters are one pre-token each: they are encoded
        joined and cut after the ids that end a word."""
        plain = [w for w in new if PLAIN.fullmatch(w)]
        ids = np.asarray(self.whole([" ".join(plain)])[0], np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(plain):
            self.bounds.frombytes((len(self.pool) + cuts).astype(np.int64).tobytes())
            self.pool.frombytes(ids.tobytes())
            self.seen.update(zip(plain, range(len(self.seen), len(self.seen) + len(plain))))
        odd = [w for w in new if w not in self.seen]
        for w, ids in zip(odd, self.whole(odd)):
            self.pool.extend(ids)
            self.bounds.append(len(self.pool))
            self.seen[w] = len(self.seen)

    def split(self, texts: list[str]) -> pa.ListArray:
        """Chunks of texts without special tokens.  ASCII letters are
        lowered as the vocabulary does, and a comma or full stop between a
        letter and white space, a pre-token of its own, is set apart: both
        leave the ids as they are and make far fewer distinct chunks."""
        column = pc.ascii_lower(pa.array(texts, pa.large_string()))
        column = pc.replace_substring(column, "\n", " ")
        column = pc.replace_substring_regex(column, f"([{LATIN}])([.,])( |$)", r"\1 \2\3")
        return pc.split_pattern(column, " ")

    def encode(self, texts: list[bytes], last: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, number of ids of each)``; each text's ids
        are followed by ``last``."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        strings = [t.decode("utf-8", "replace") for t in texts]
        special = [i for i, s in enumerate(strings) if "<|" in s]
        kept = [s for s in strings if "<|" not in s]
        ids, counts = self.encode_chunks(kept, last)
        if not special:
            return ids, counts
        bounds = np.concatenate([[0], np.cumsum(counts)])
        parts = [ids[bounds[i]:bounds[i + 1]] for i in range(len(kept))]
        for i, own in zip(special, self.whole([strings[i] for i in special])):
            parts.insert(i, np.asarray([*own, last], np.uint32))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode_chunks(self, texts: list[str], last: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > CHUNK_CACHE:
            self.forget()
        lists = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        # through numpy: a tenth of the time of Arrow's own list of scalars
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(self.seen.get, words))
        new = [w for w, k in zip(words, numbers) if k is None] if None in numbers else []
        if new:
            self.learn(new)
            numbers = map(self.seen.__getitem__, words)
        known = np.fromiter(numbers, np.int64, len(words))
        bounds = np.frombuffer(self.bounds, np.int64)
        at = known[coded.indices.to_numpy()]
        places = bounds[at]
        lens = bounds[at + 1] - places
        ends = np.concatenate([[0], np.cumsum(lens)])
        counts = np.diff(ends[lists.offsets.to_numpy()]) + 1
        stops = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.uint32)
        out[stops] = last
        body = np.ones(len(out), bool)
        body[stops] = False
        if len(at):
            take = np.repeat(places - ends[:-1], lens) + np.arange(ends[-1])
            out[body] = np.frombuffer(self.pool, np.uint32)[take] if len(take) else 0
        return out, counts


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder; it outlives a task, as workers are reused."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_chunk_encoders", {})
    if path not in kept:
        kept[path] = ChunkEncoder(path)
    return kept[path]


ship_by_value(__name__)
