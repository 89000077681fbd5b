"""Sizes in tokens of a public tokenizer.

The vocabulary file's folder is a parameter; files are read on the workers and never copied. The pre-tokenizer cuts a text
into words whose token counts don't depend on their surroundings, so a text cut between them has the sum of its parts.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# fixed value: the public byte-level BPE pre-tokenizer pattern
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[int]:
    """One text after the other, so that the tokens of a single text are held at once."""
    enc = encoding(folder, vocabulary) if texts else None
    return [len(enc.encode_ordinary(t)) for t in texts]


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for an empty text, null for null."""

    @F.pandas_udf(T.LongType())
    def counted(s: pd.Series) -> pd.Series:
        there = s[s.notna()]
        return pd.Series(count_tokens(there.tolist(), folder, vocabulary), index=there.index, dtype="Int64").reindex(s.index)

    return counted(text)


def over_limit(text: Column, limit: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Whether a text has more than `limit` tokens; null if either is null. A byte-level token has one byte at least, so texts of no more bytes than the limit aren't tokenized."""
    short = F.octet_length(text) <= limit
    return F.when(text.isNull() | limit.isNull(), None).when(short, False).otherwise(token_count(F.when(short, "").otherwise(text), folder, vocabulary) > limit)
