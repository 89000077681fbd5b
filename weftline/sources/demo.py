"""A small made-up study: four traces with six questions, predictions and labels of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schemas import EVENT

# (trace, event, parent, sequence, role, text)
_TURNS = (
    ("loaf", "l1", None, 0, "user", "Which flour did I buy last week?"), ("loaf", "l2", "l1", 1, "assistant", "Rye."), ("loaf", "l3", "l2", 2, "user", "No, that was the week before."),
    ("kiln", "k1", None, 0, "user", "Plan the firing for Tuesday."), ("kiln", "k2", "k1", 1, "assistant", "Planned for Tuesday."), ("kiln", "k3", "k2", 2, "user", "Thanks, add the glaze."),
    ("moss", "m1", None, 0, "user", "List the open beds."), ("reed", "r1", None, 0, "user", "Rename the second reed."),
)
_LABELS = {"l3": "yes", "k3": "unclear"}
_SCORES = {"yes": 0.9, "no": 0.1, "unclear": None}


def events(spark: SparkSession) -> DataFrame:
    rows = [("demo", t, e, p, "main", s, role, "user_visible", text, "completed", "en", None) for t, e, p, s, role, text in _TURNS]
    return spark.createDataFrame(rows, EVENT)


def labels(examples: DataFrame) -> DataFrame:
    """(input_id, label) of the examples: one yes, one unclear, four no."""
    known = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])
    return examples.select("input_id", F.coalesce(F.try_element_at(known, F.col("target_event_id")), F.lit("no")).alias("label"))


def predictions(examples: DataFrame) -> DataFrame:
    """Scores that follow the labels; an unclear message has none."""
    score = F.when(F.col("label") == "yes", _SCORES["yes"]).when(F.col("label") == "no", _SCORES["no"])
    return labels(examples).select("input_id", score.alias("score"), F.lit("ok").alias("runtime_status"), F.lit(False).alias("model_abstention"), F.lit("demo").alias("model_version"), F.lit(None).cast("string").alias("context_status"))
