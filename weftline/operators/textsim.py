"""Exact similarity of texts as sets of character 5-grams, by a join of prefixes.

Two sets of a and b grams at Jaccard similarity t or more share at least t * max(a, b) of them. In any fixed order of grams
the first a - ceil(t * a) + k of one and b - ceil(t * b) + k of the other then have k in common, whatever the edits are and
wherever they stand. Prefixes are put in order of document frequency, rare grams first, exploded into rows and joined on
the gram; a pair must share k prefix grams at positions that leave room for the overlap it needs. The texts of the pairs
that remain are fetched and compared exactly. No block of texts meets another as a whole: work grows with the grams that
texts share.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

GRAM = 5
COMMON = 3  # prefix grams that a pair must share
FREQUENT = 1 << 20  # grams whose order is sent to the workers, 12 bytes each; all rarer ones come before them


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def least_common(n_grams: int, similarity: float, common: int = COMMON) -> int:
    """Prefix grams that a set of this size shares at least with any set at the similarity or above, `common` at most."""
    return min(common, max(1, math.ceil(similarity * n_grams - 1e-9)))


def prefix_length(n_grams: int, similarity: float, common: int = COMMON) -> int:
    """Grams of a set, first ones of a fixed order, that hold least_common() grams of any set at the similarity or above."""
    return n_grams - max(1, math.ceil(similarity * n_grams - 1e-9)) + least_common(n_grams, similarity, common)


_POWERS = np.array([0x9E3779B97F4A7C15**k % 2**64 for k in range(GRAM)], dtype=np.uint64)


def hashes(text: str, index: bool = False):
    """Distinct 64-bit hashes of the grams, ascending; with index also where each one first stands."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = max(0, len(codes) - GRAM + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h += codes[k : n + k] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h, return_index=index)


def shared_chars(text: str, common: set[str]) -> int:
    """Characters of the text inside grams of the set: the matched intervals, merged."""
    n, end = 0, 0
    for i in range(len(text) - GRAM + 1):
        if text[i : i + GRAM] in common:
            n += i + GRAM - max(i, end)
            end = i + GRAM
    return n


def gram_order(texts: DataFrame, bound: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, rank of each): the `bound` most frequent grams of all texts that stand in several texts.

    Any order gives all pairs; this one keeps the lists of texts that share a prefix gram short.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            marks = [hashes(t) for t in f["text"]]
            h, n = np.unique(np.concatenate(marks), return_counts=True) if marks else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    counts = texts.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(bound).select("h").toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64)  # at most `bound` numbers
    rank = np.arange(len(top), 0, -1, dtype=np.int32)
    by = np.argsort(top)
    return top[by], rank[by]


def in_order(h: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions of the hashes in the order of grams: rare ones first, equal ranks by hash."""
    keys, ranks = order
    if not len(keys):
        return np.arange(len(h))
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.lexsort((h, np.where(keys[i] == h, ranks[i], 0)))


def prefixes(texts: DataFrame, order, similarity: float) -> DataFrame:
    """(n, size, at, h): one row for each prefix gram of (n, text); order is a broadcast gram_order()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, t in zip(f["n"], f["text"]):
                h = hashes(t)
                out.append((n, len(h), h[in_order(h, order.value)[: prefix_length(len(h), similarity)]].view(np.int64)))
            yield pd.DataFrame(out, columns=["n", "size", "h"])

    return texts.select("n", "text").mapInPandas(run, "n long, size int, h array<long>").select("n", "size", F.posexplode("h").alias("at", "h"))


def candidates(left: DataFrame, right: DataFrame, similarity: float, itself: bool = False) -> DataFrame:
    """(ln, rn): pairs that share enough prefix grams at fitting positions; of a table with itself each pair once, ln < rn."""
    a = left.select(F.col("n").alias("ln"), F.col("size").alias("ls"), F.col("at").alias("la"), "h")
    b = right.select(F.col("n").alias("rn"), F.col("size").alias("rs"), F.col("at").alias("ra"), "h")
    need = F.lit(similarity / (1 + similarity)) * (F.col("ls") + F.col("rs")) - 1e-9
    room = F.least("la", "ra") + F.least(F.col("ls") - F.col("la"), F.col("rs") - F.col("ra"))
    j = a.join(b, "h").filter((F.col("ls") >= F.lit(similarity) * F.col("rs") - 1e-9) & (F.col("rs") >= F.lit(similarity) * F.col("ls") - 1e-9) & (room >= need))
    if itself:
        j = j.filter("ln < rn")
    least = F.least(F.lit(COMMON), F.greatest(F.lit(1), F.ceil(F.lit(similarity) * F.least("ls", "rs") - 1e-9)))
    return j.groupBy("ln", "rn").agg(F.count("*").alias("c"), F.first(least).alias("k")).filter("c >= k").select("ln", "rn")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """(left_id, right_id, similarity, coverage, n_left, n_right) of candidate pairs (ln, rn) at the similarity or above; left and right: (id, text, n).

    coverage is the share of the right text inside grams of the left one.
    """
    a = left.select(F.col("n").alias("ln"), F.col("id").alias("left_id"), F.col("text").alias("lt"))
    b = right.select(F.col("n").alias("rn"), F.col("id").alias("right_id"), F.col("text").alias("rt"))
    kinds = f"left_id {dict(left.dtypes)['id']}, right_id {dict(right.dtypes)['id']}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = functools.lru_cache(maxsize=4096)(grams)
        for f in frames:
            rows = []
            for x, y, lt, rt in zip(f["left_id"], f["right_id"], f["lt"], f["rt"]):
                g, s = of(lt), of(rt)
                both = len(g & s)
                j = both / (len(g) + len(s) - both)
                if j >= similarity:
                    rows.append((x, y, j, shared_chars(rt, g) / len(rt), len(g), len(s)))
            yield pd.DataFrame(rows, columns=["left_id", "right_id", "similarity", "coverage", "n_left", "n_right"])

    found = pairs.join(a, "ln").join(b, "rn").filter("left_id <> right_id").select("left_id", "right_id", "lt", "rt")
    return found.mapInPandas(run, f"{kinds}, similarity double, coverage double, n_left long, n_right long")


def numbered(texts: DataFrame) -> DataFrame:
    """(id, text, n) of texts with a gram at least, written once: short numbers stand for the ids in the rows of grams."""
    return materialize(texts.filter(F.length("text") >= GRAM).select("id", "text", F.monotonically_increasing_id().alias("n")), "texts")[0]


def similar_texts(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs (left_id, right_id, similarity, coverage, n_left, n_right) of (id, text) tables: all at the similarity or above.

    Texts shorter than a gram match nothing, a text isn't paired with its own id. If left and right are one table each
    pair comes once, in either order. Ids are unique in a table. The grams of a group of near copies meet in one join key,
    which the adaptive skew join splits.
    """
    itself = left is right
    a = numbered(left)
    b = a if itself else numbered(right)
    order = left.sparkSession.sparkContext.broadcast(gram_order(a if itself else a.select("text").unionByName(b.select("text"))))
    rows, _ = materialize(prefixes(a, order, similarity), "prefixes")
    pairs, _ = materialize(candidates(rows, rows if itself else prefixes(b, order, similarity), similarity, itself), "pairs")
    return verified(pairs, a, b, similarity)
