"""Duplicate groups, near-duplicate links, components and split cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold
from weftline.operators.components import connected_components
from weftline.operators.textsim import similar_texts
from weftline.session import materialize

MIN_CHARS = 80
COSINE, LENGTH_RATIO, JACCARD = 0.95, 0.85, 0.85
# at cosine c the smallest Jaccard is c / (2 - c) for equal sizes and c**2 where the smaller set lies in the larger
REACH = min(COSINE / (2 - COSINE), COSINE**2) - 1e-9


def shared_across_splits(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """(text_hash, n_splits, n_rows) of texts that stand in more than one split; null splits don't count."""
    d = df.filter(F.col(text).isNotNull() & F.col(split).isNotNull()).groupBy(F.sha2(text, 256).alias("text_hash"), split).agg(F.count("*").alias("n"))
    return d.groupBy("text_hash").agg(F.count("*").alias("n_splits"), F.sum("n").alias("n_rows")).filter("n_splits > 1")


def canonical_mapping(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, canonical): the smallest key among the rows that agree in all parts (nulls equal)."""
    h = F.xxhash64(*parts, *[F.isnull(p) for p in parts])
    first = df.groupBy(h.alias("__h"), *parts).agg(F.min(key).alias("canonical"))
    d = df.select(key, *parts, h.alias("__h"))
    cond = d["__h"] == first["__h"]
    for p in parts:
        cond = cond & d[p].eqNullSafe(first[p])
    return d.join(first, cond).select(d[key], "canonical")


def text_classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, class, folded): class is the smallest key with the same folded text; rows with a null key or text are left out."""
    d = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).distinct()
    d = d.select(F.col(key), fold(text).alias("folded")).groupBy(key).agg(F.min("folded").alias("folded"))
    d, _ = materialize(d, "folded")
    first = d.groupBy(F.sha2("folded", 256).alias("__h")).agg(F.min(key).alias("class"))
    return d.withColumn("__h", F.sha2("folded", 256)).join(first, "__h").select(key, "class", "folded")


def near_duplicates(classes: DataFrame, key: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(left, right, cosine, jaccard): links between class representatives, left < right.

    Both folded texts have at least min_chars characters; their 5-gram sets have cosine >= 0.95 and Jaccard >= 0.85, their
    lengths a ratio of at least 0.85. Membership of the classes is in text_classes(); copies aren't expanded into pairs.
    """
    reps = classes.filter((F.col(key) == F.col("class")) & (F.length("folded") >= min_chars)).select(F.col(key).alias("id"), F.col("folded").alias("text"))
    reps, _ = materialize(reps, "reps")
    pairs = similar_texts(reps, reps, REACH)
    low, high = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    pairs = pairs.select(low.alias("left_id"), high.alias("right_id"), "similarity", "n_left", "n_right")
    both = F.col("similarity") / (1 + F.col("similarity")) * (F.col("n_left") + F.col("n_right"))
    cosine = both / F.sqrt(F.col("n_left") * F.col("n_right"))
    size = reps.select("id", F.length("text").alias("n"))
    p = pairs.withColumn("cosine", cosine).filter((F.col("cosine") >= COSINE - 1e-9) & (F.col("similarity") >= JACCARD))
    p = p.join(size.select(F.col("id").alias("left_id"), F.col("n").alias("__a")), "left_id").join(size.select(F.col("id").alias("right_id"), F.col("n").alias("__b")), "right_id")
    p = p.filter(F.least("__a", "__b") >= LENGTH_RATIO * F.greatest("__a", "__b"))
    return p.select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), "cosine", F.col("similarity").alias("jaccard"))


def duplicate_components(df: DataFrame, key: str, text: str = "text", near: bool = True) -> DataFrame:
    """(key, class, component, n_links): exact classes joined by near-duplicate links; component is its smallest key, n_links counts the links of the row's class."""
    c = text_classes(df, key, text)
    own = c.select(key, "class")
    if not near:
        return own.withColumns({"component": F.col("class"), "n_links": F.lit(0).cast("long")})
    links, _ = materialize(near_duplicates(c, key).select("left", "right"), "links")
    comp = connected_components(links, "left", "right").select(F.col("node").alias("class"), "component")
    n = links.select(F.explode(F.array("left", "right")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    out = own.join(comp, "class", "left").join(n, "class", "left")
    return out.select(key, "class", F.coalesce("component", "class").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def clean_splits(df: DataFrame, components: DataFrame, reviewed: DataFrame, key: str = "input_id", group: str = "group_id", limit: int | None = None, overhead: int = 0) -> DataFrame:
    """(key, split, reason): reason is null for kept rows, else the first that holds.

    empty_text, judge_input_limit (overhead + text length above limit), previously_reviewed_session and
    duplicate_of_reviewed_message (test rows only), duplicate_in_higher_priority_split (test over calibration over train
    inside a component of rows not excluded before). reviewed: (key) of rows seen by people.
    """
    d = df.select(key, "split", group, "text").join(components.select(key, "component"), key)
    seen = reviewed.select(key).distinct().withColumn("__seen", F.lit(True))
    d, _ = materialize(d.join(seen, key, "left"), "splits")
    groups = d.filter("__seen").select(group).distinct().withColumn("__g", F.lit(True))
    comps = d.filter("__seen").select("component").distinct().withColumn("__c", F.lit(True))
    d = d.join(groups, group, "left").join(comps, "component", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    test = F.col("split") == "test"
    reason = F.when(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) == 0, "empty_text")
    if limit is not None:
        reason = reason.when(F.length("text") + overhead > limit, "judge_input_limit")
    reason = reason.when(test & yes("__g"), "previously_reviewed_session").when(test & yes("__c"), "duplicate_of_reviewed_message")
    d, _ = materialize(d.select(key, "split", "component", reason.alias("reason")), "reasons")
    rank = F.when(F.col("split") == "test", 2).when(F.col("split") == "calibration", 1).otherwise(0)
    best = d.filter("reason IS NULL").groupBy("component").agg(F.max(rank).alias("__best"))
    late = F.col("reason").isNull() & (rank < F.col("__best"))
    return d.join(best, "component", "left").select(key, "split", F.when(late, "duplicate_in_higher_priority_split").otherwise(F.col("reason")).alias("reason"))


def split_overlaps(df: DataFrame, by: str) -> DataFrame:
    """(by, n_splits) of groups or components that still stand in several splits; must be empty after cleaning."""
    n = df.filter(F.col(by).isNotNull() & F.col("split").isNotNull()).groupBy(by).agg(F.countDistinct("split").alias("n_splits"))
    return n.filter("n_splits > 1")


def exact_duplicate_groups(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(representative, n_rows, text_hash) of texts that several rows share literally."""
    g = df.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(key).alias("representative"), F.count("*").alias("n_rows"))
    return g.filter("n_rows > 1")
