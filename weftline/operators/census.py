"""Label census over two feedback tasks: fan-out, masks, fractions with bounds, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schemas import LABELS

TASKS = ("dissatisfaction", "correction")
CLASSES = {c: i for i, c in enumerate(LABELS)}


def label_index(label: Column) -> Column:
    """Class number of a label, -1 for a missing or unknown one: missing is never a class."""
    out = F.lit(-1)
    for c, i in CLASSES.items():
        out = F.when(label == c, i).otherwise(out)
    return out


def fan_out(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels of canonical inputs for every input that maps to them."""
    return mapping.join(labels.withColumnRenamed("input_id", "canonical"), "canonical")


def target_matrix(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(input_id, y_<task>...): -1 where the label is missing."""
    j = inputs.select("input_id").distinct().join(labels.select("input_id", *TASKS), "input_id", "left")
    return j.select("input_id", *[label_index(F.col(f"{t}.label")).alias(f"y_{t}") for t in TASKS])


def long_labels(labels: DataFrame) -> DataFrame:
    """(input_id, task, label): one row for each task."""
    one = lambda t: F.struct(F.lit(t).alias("task"), F.col(f"{t}.label").alias("label"))
    return labels.select("input_id", F.explode(F.array(*[one(t) for t in TASKS])).alias("x")).select("input_id", "x.*")


def task_counts(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(task, label, n) over all inputs; missing labels count as 'missing'."""
    j = inputs.select("input_id").distinct().crossJoin(F.broadcast(inputs.sparkSession.createDataFrame([(t,) for t in TASKS], "task string")))  # two rows
    x = j.join(long_labels(labels), ["input_id", "task"], "left")
    return x.groupBy("task", F.coalesce(F.when(F.col("label").isin(*LABELS), F.col("label")), F.lit("missing")).alias("label")).agg(F.count("*").alias("n"))


def bounds(counts: DataFrame) -> DataFrame:
    """(task, n, known, yes_fraction, low, high): yes among yes and no; bounds over all inputs with unclear and missing as no, then as yes."""
    s = lambda *k: F.coalesce(F.sum(F.when(F.col("label").isin(*k), F.col("n"))), F.lit(0))
    g = counts.groupBy("task").agg(F.sum("n").alias("n_inputs"), s("yes").alias("yes"), s("no").alias("no"), s("unclear", "missing").alias("open"))
    return g.select("task", "n_inputs", (F.col("yes") + F.col("no")).alias("known"), F.try_divide("yes", F.col("yes") + F.col("no")).alias("yes_fraction"), F.try_divide("yes", "n_inputs").alias("low"), F.try_divide(F.col("yes") + F.col("open"), "n_inputs").alias("high"))


def sessions_with_yes(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(task, sessions, messages) with at least one yes."""
    y = long_labels(labels).filter("label = 'yes'")
    return y.join(inputs.select("input_id", "tenant_id", "session_id").distinct(), "input_id").groupBy("task").agg(F.countDistinct("tenant_id", "session_id").alias("sessions"), F.countDistinct("input_id").alias("messages"))


def tag_counts(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode("reason_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def task_overlap(labels: DataFrame) -> DataFrame:
    """(label_a, label_b, n) over inputs with both labels."""
    a, b = (F.col(f"{t}.label") for t in TASKS)
    return labels.filter(a.isNotNull() & b.isNotNull()).groupBy(a.alias("dissatisfaction_label"), b.alias("correction_label")).agg(F.count("*").alias("n"))


def gate(labels_ok: Column, df: DataFrame, least: float) -> DataFrame:
    """(n, valid, fraction, passed): whether the valid share reaches `least`."""
    r = df.agg(F.count("*").alias("n"), F.count_if(labels_ok).alias("valid")).withColumn("fraction", F.try_divide("valid", "n"))
    return r.withColumn("passed", F.coalesce(F.col("fraction") >= least, F.lit(False)))
