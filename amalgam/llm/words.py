"""Words of a tokenizer's pattern and the ids of each distinct word by the tokenizer's own library, for sizes in tokens."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from amalgam.llm.tokens import PATTERN, REMEMBERED, TOKENIZERS

# The same pattern as in tokens.py in the library's syntax. Fixed value.
LIBRARY_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def words_of(text: Column) -> Column:
    """The words that a text consists of, in order, without gaps; an empty array for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


class Sizes:
    """Ids of words, and bytes of ids, one for each Python worker."""

    def __init__(self, path: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.library = tiktoken.Encoding("own", pat_str=LIBRARY_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.known: dict[str, list[int]] = {}

    def of(self, words: list[str]) -> list[list[int]]:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        known, encode = self.known, self.library.encode_ordinary
        for w in words:
            if w not in known:
                known[w] = encode(w)
        return [known[w] for w in words]


@lru_cache(2)
def sizes(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Sizes:
    return Sizes(f"{folder}/{tokenizer}.tiktoken")


def coded(words: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column of word arrays, each word's code, and where each row's words begin (with the end)."""
    d = pc.dictionary_encode(words.flatten())
    offsets = words.offsets.to_numpy(zero_copy_only=False)
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False), (offsets - offsets[0]).astype(np.int64)
