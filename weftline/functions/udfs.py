"""Functions of this library for SQL texts: register(spark) adds them to the session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import fold, split_lossless
from weftline.operators.routing import recall_lower_bound


@F.pandas_udf(T.DoubleType())
def lower_bound(hits: pd.Series, positives: pd.Series) -> pd.Series:
    """The exact one-sided bound of a recall; null for null counts or no positives."""
    one = lambda h, p: None if pd.isna(h) or pd.isna(p) else recall_lower_bound(int(h), int(p))
    return pd.Series([one(h, p) for h, p in zip(hits, positives)], index=hits.index, dtype="float64")


@F.udtf(returnType="piece_no int, piece string")
class SplitText:
    """(piece_no, piece) of a text in pieces of at most `limit` characters; null has none."""

    def eval(self, text: str, limit: int):
        if text is not None and limit is not None:
            yield from enumerate(split_lossless(text, len, limit))


def register(spark: SparkSession) -> list[str]:
    """Names of the SQL functions added: fold_text(text), recall_lower_bound(hits, positives) and the table function split_text(text, limit)."""
    spark.udf.register("fold_text", fold)
    spark.udf.register("recall_lower_bound", lower_bound)
    spark.udtf.register("split_text", SplitText)
    return ["fold_text", "recall_lower_bound", "split_text"]
