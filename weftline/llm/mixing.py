"""Problem 9: mixing sources to target weights.

Every document has a hash; the documents of a source below a hash threshold are its partial copy. The threshold for a
token budget comes from a histogram: tokens by source and hash bucket, a running sum over the few buckets, and further
histograms that refine only the boundary bucket. Nothing is sorted. A document that overshoots the budget is stepped over:
a further threshold follows behind it for what is left, among documents that fit, until the rest is negligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZERS, VOCABULARY, token_count
from weftline.session import materialize

BUCKET_BITS = 12
LEVELS = 3  # 3 * 12 of the 52 hash bits: a boundary cell holds a document in 2**36 of the source
STEPS = 8  # thresholds of a source at most
REST = 0.001  # share of a budget that may stay unspent without a further threshold


def _hash(key: str, seed: str) -> Column:
    """52 bits of md5(seed:key)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), 1, 13), 16, 10).cast("long")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, own_tokens, reachable_share, budget): what each listed source shall give.

    Without total_tokens the total is the size of the listed sources' documents. A source whose share of it needs more than
    max_repeats copies of its documents gives all of these, and what it can't give is spread over the others in proportion
    to their targets; sources without tokens give nothing. reachable_share is the share that comes of that. The total is
    missed only where all sources are at their caps. Repeated target rows of a source: shares add up, the smallest cap
    holds; rows with a null source, a null or non-positive share or a cap below 1 give nothing.
    """
    t = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"))
    rows = [r.asDict() for r in t.join(own, "source", "left").fillna(0, ["own_tokens"]).orderBy("source").collect()]  # one row for each target
    whole = sum(r["own_tokens"] for r in rows) if total_tokens is None else total_tokens
    most = {r["source"]: r["own_tokens"] * max(0, r["max_repeats"]) for r in rows}
    budget = {r["source"]: 0.0 for r in rows}
    open_ = {r["source"]: r["target_share"] for r in rows if most[r["source"]]}
    left = float(whole)
    while open_ and left > 0:
        unit = left / sum(open_.values())
        full = [k for k, share in open_.items() if share * unit >= most[k]]
        for k in full or list(open_):
            budget[k] = min(float(most[k]), open_.pop(k) * unit)
            left -= budget[k]
    given = sum(budget.values())
    out = [(r["source"], r["target_share"], r["max_repeats"], r["own_tokens"], budget[r["source"]] / given if given else 0.0, int(budget[r["source"]] + 1e-6)) for r in rows]
    return sizes.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats int, own_tokens long, reachable_share double, budget long")


def thresholds(sizes: DataFrame, part: DataFrame) -> DataFrame:
    """(source, edge, beyond, rest): from `start` on, the documents of at most `rest` tokens with a hash below edge have at most `rest` in all.

    The hash cell from edge to beyond would exceed it; the new rest is what they leave. part: (source, rest, start). Each
    level sums tokens by source and hash cell inside the current boundary cell only.
    """
    now = part.select("source", "rest", F.col("rest").alias("limit"), "start", F.lit(0).cast("long").alias("lo"), F.lit(False).alias("all"))
    for level in range(LEVELS):
        width = 52 - BUCKET_BITS * (level + 1)
        j = sizes.join(F.broadcast(now), "source").filter("h >= start AND tokens <= limit AND NOT all")  # one row for each source of the target table
        if level:  # a document is inside the boundary cell of the level before if their leading bits agree
            j = j.filter(F.shiftright("h", width + BUCKET_BITS) == F.shiftright("lo", width + BUCKET_BITS))
        hist = j.groupBy("source", F.shiftright("h", width).alias("cell")).agg(F.sum("tokens").alias("n"))
        w = Window.partitionBy("source").orderBy("cell")  # at most 2**BUCKET_BITS rows a source
        run = hist.join(F.broadcast(now), "source").withColumn("upto", F.sum("n").over(w))
        fit = run.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("cell"))).alias("edge"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("used")
        )
        # no boundary cell: everything fits, which only happens at the first level
        now = now.join(fit, "source", "left").select(
            "source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), "limit", "start",
            F.when(F.col("edge").isNotNull(), F.shiftleft("edge", width)).otherwise(F.col("lo")).alias("lo"), (F.col("all") | F.col("edge").isNull()).alias("all"),
        )
        now = now.sparkSession.createDataFrame(now.collect(), now.schema)  # one row for each source of the target table
    top = F.lit(1 << 52)
    end = F.col("lo") + F.lit(1 << (52 - BUCKET_BITS * LEVELS))
    return now.select("source", F.when(F.col("all"), top).otherwise(F.greatest("lo", "start")).alias("edge"), F.when(F.col("all"), top).otherwise(end).alias("beyond"), "rest")


def spans(sizes: DataFrame, part: DataFrame) -> DataFrame:
    """(source, start, edge, limit): hash ranges whose documents of at most `limit` tokens make up the budget `rest` of part (source, rest).

    What a source leaves unspent is below REST of the budget, or no document behind the last threshold fits it.
    """
    spark = sizes.sparkSession
    goal = {r["source"]: r["rest"] for r in part.filter("rest > 0").collect()}  # one row for each source of the target table
    now, out = [(k, v, 0) for k, v in goal.items()], []
    for _ in range(STEPS):
        if not now:
            break
        found = thresholds(sizes, spark.createDataFrame(now, "source string, rest long, start long")).collect()
        begin = {k: (rest, start) for k, rest, start in now}
        out += [(r["source"], begin[r["source"]][1], r["edge"], begin[r["source"]][0]) for r in found]
        now = [(r["source"], r["rest"], r["beyond"]) for r in found if r["beyond"] < 1 << 52 and r["rest"] > REST * goal[r["source"]]]
    return spark.createDataFrame(out, "source string, start long, edge long, limit long")


def sized(docs: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: str = "mix-v1") -> DataFrame:
    """(doc_id, source, tokens, h) of the listed sources' documents, written once. Null ids, null sources and unlisted sources take no part; null and empty texts have 0 tokens."""
    listed = targets.filter("source IS NOT NULL").select("source").distinct()
    d = docs.filter("doc_id IS NOT NULL").join(listed, "source", "left_semi").select("doc_id", "source", "text")
    out, _ = materialize(d.select("doc_id", "source", F.coalesce(token_count(F.col("text"), folder, vocabulary), F.lit(0)).alias("tokens"), _hash("doc_id", seed).alias("h")), "sizes")
    return out


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, repeats): each document's whole copies plus one if it lies in one of its source's hash ranges; documents with 0 repeats are left out."""
    p = plan(sizes, targets, total_tokens).filter("budget > 0")
    p = p.withColumn("whole", F.expr("CAST(budget div own_tokens AS INT)")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("own_tokens"))
    cut = spans(sizes, p.select("source", "rest")).groupBy("source").agg(F.collect_list(F.struct("start", "edge", "limit")).alias("spans"))  # at most STEPS
    own = p.select("source", "whole", "max_repeats").join(cut, "source", "left")
    out = sizes.join(F.broadcast(own), "source")  # one row for each source of the target table
    part = F.coalesce(F.exists("spans", lambda x: (F.col("h") >= x.start) & (F.col("h") < x.edge) & (F.col("tokens") <= x.limit)), F.lit(False))
    return out.select("doc_id", "source", "tokens", F.least("max_repeats", F.col("whole") + part.cast("int")).alias("repeats")).filter("repeats > 0")


def share_report(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, reachable_share, max_repeats, own_tokens, mixed_tokens, actual_share, most_repeats): the shares reached."""
    p = plan(sizes, targets, total_tokens)
    m = mix(sizes, targets, total_tokens).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    whole = m.agg(F.sum("mixed_tokens").alias("__all"))
    j = p.join(m, "source", "left").crossJoin(F.broadcast(whole))  # one row
    return j.select(
        "source", "target_share", "reachable_share", "max_repeats", "own_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.try_divide("mixed_tokens", "__all"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
