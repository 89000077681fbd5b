"""Contract checks as violation tables, and the eager check that raises before a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that are null or occur more than once."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    return n.filter(f"n > 1 OR {null}")


def bad_probabilities(df: DataFrame, col: str, positive: bool = False) -> DataFrame:
    """Rows whose value is NaN, infinite or outside [0, 1] ((0, 1] if positive); null is a missing score, not a bad one."""
    c = F.col(col)
    low = c <= 0 if positive else c < 0
    return df.filter(c.isNotNull() & (F.isnan(c) | low | (c > 1)))


def stale(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of df that `known` doesn't have."""
    return df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def coverage_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the tables has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def assert_empty(df: DataFrame, message: str) -> None:
    """Raise ValueError with up to three example rows if df has any."""
    rows = df.limit(3).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def leaking_groups(train: DataFrame, held_out: DataFrame, *group: str) -> DataFrame:
    """Held-out rows whose group was trained on."""
    keys = train.select(*group).distinct()
    cond = held_out[group[0]].eqNullSafe(keys[group[0]])
    for g in group[1:]:
        cond = cond & held_out[g].eqNullSafe(keys[g])
    return held_out.join(keys, cond, "left_semi")


def annotation_errors(examples: DataFrame, annotations: DataFrame, sources: tuple[str, ...] = ("human",)) -> DataFrame:
    """(input_id, error) of annotations (input_id, label, label_source, annotator, evidence_event_ids) against their examples' contexts.

    unknown_input, missing_annotation, repeated_annotation, wrong_label, wrong_source, no_annotator, evidence_outside_context,
    yes_without_target; the first that holds.
    """
    n = annotations.groupBy("input_id").agg(F.count("*").alias("__n"))
    x = examples.select("input_id", F.lit(True).alias("__ex"), "target_event_id", F.transform("context", lambda t: t.event_id).alias("__ids"))
    a = annotations.select("input_id", "label", "label_source", "annotator", "evidence_event_ids", F.lit(True).alias("__an")).dropDuplicates(["input_id"])
    j = x.join(a, "input_id", "full").join(n, "input_id", "left")
    ev = F.coalesce("evidence_event_ids", F.array().cast("array<string>"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    e = (
        F.when(F.col("__ex").isNull(), "unknown_input").when(F.col("__an").isNull(), "missing_annotation").when(F.col("__n") > 1, "repeated_annotation")
        .when(no(F.col("label").isin("yes", "no", "unclear")), "wrong_label").when(no(F.col("label_source").isin(*sources)), "wrong_source").when(no(F.col("annotator").rlike(r"\S")), "no_annotator")
        .when(F.size(F.array_except(ev, F.col("__ids"))) > 0, "evidence_outside_context").when((F.col("label") == "yes") & ~F.array_contains(ev, F.col("target_event_id")), "yes_without_target")
    )
    return j.select("input_id", e.alias("error")).filter("error IS NOT NULL")


def version_mix(labels: DataFrame, column: str) -> DataFrame:
    """(n_versions, n_missing): more than one version, or a missing one, makes labels unfit for one study."""
    return labels.agg(F.countDistinct(column).alias("n_versions"), F.count_if(F.col(column).isNull()).alias("n_missing"))


def target_coverage(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_inputs, n_labelled, n_missing, n_versions) of inputs and labels (input_id, label, judge_version): more than one version is unfit for one study."""
    ids = inputs.filter("input_id IS NOT NULL").select("input_id").distinct()
    own = labels.filter("label IS NOT NULL").select("input_id", "judge_version").join(ids, "input_id", "left_semi")
    j = ids.join(own.select("input_id").distinct().withColumn("__l", F.lit(True)), "input_id", "left")
    n = j.agg(F.count("*").alias("n_inputs"), F.count("__l").alias("n_labelled"), F.count_if(F.col("__l").isNull()).alias("n_missing"))
    return n.crossJoin(F.broadcast(own.agg(F.countDistinct("judge_version").alias("n_versions"))))  # one row each


def prediction_drift(a: DataFrame, b: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """(n_both, n_only_one, label_changes, max_score_change) of two prediction tables; null scores equal null scores only."""
    j = a.select(key, F.col(label).alias("__la"), F.col(score).alias("__sa"), F.lit(1).alias("__a")).join(b.select(key, F.col(label).alias("__lb"), F.col(score).alias("__sb"), F.lit(1).alias("__b")), key, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.agg(
        F.count_if(both).alias("n_both"), F.count_if(~both).alias("n_only_one"), F.count_if(both & ~F.col("__la").eqNullSafe(F.col("__lb"))).alias("label_changes"),
        F.max(F.when(both, F.abs(F.col("__sa") - F.col("__sb")))).alias("max_score_change"), F.count_if(both & (F.col("__sa").isNull() != F.col("__sb").isNull())).alias("score_presence_changes"),
    )
