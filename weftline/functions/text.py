"""Text functions that Spark has no builtin for, as Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_text(text: str | None) -> str | None:
    """NFKC, case folded, white-space runs as one blank, trimmed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


def split_lossless(text: str, measure, limit: int) -> list[str]:
    """Cut text into pieces of at most `limit` by `measure`; joined they give the text again.

    A piece that is too large is cut after the white space nearest its middle, or at the middle where it has none. A
    single character above the limit is an error.
    """
    if not text:
        return [] if limit >= 0 else [text]
    pieces: list[str] = []
    stack = [text]
    while stack:
        part = stack.pop()
        if measure(part) <= limit:
            pieces.append(part)
            continue
        if len(part) == 1:
            raise ValueError("a single character is above the limit")
        mid = len(part) // 2
        spaces = [i + 1 for i, c in enumerate(part[:-1]) if c.isspace()]
        cut = min(spaces, key=lambda i: (abs(i - mid), i)) if spaces else mid
        stack += [part[cut:], part[:cut]]
    return pieces
