"""Token counts of public tokenizers, counted once per word."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("ANNALES_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Words pre-split as the byte-level vocabulary expects them (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker remembers.
REMEMBERED = 500_000
HARD = re.compile(r" \s|\s \Z")


class _Counts(dict):
    """Tokens of a word; filled on demand, emptied when full."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = len(self.encode(word))
        return n


@lru_cache(2)
def counter(path: str):
    """A function from text to its number of tokens under the rank file at `path`."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = encoding.encode_ordinary
    counts = _Counts(encode)

    def count(text: str | None) -> int:
        if not text:
            return 0
        # A space opens a new word, so words count independently of each other unless
        # white space follows a space or ends the text after more of it; such texts are encoded whole.
        if HARD.search(text):
            return len(encode(text))
        first, *rest = text.split(" ")
        return counts[first] + sum([counts[" " + w] for w in rest])

    return count


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; null and empty texts have 0."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary)
        for batch in batches:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    return tokens(text)
