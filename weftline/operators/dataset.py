"""Single messages as examples: imported rows, new messages, minimal feedback rows, cache keys and request texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canon import canonical, digest, json_array, split_for, string_json

# They are part of hashed identities.
IMPORT_METRIC = "agent-dissatisfaction-message-v1"
MESSAGE_METRIC = "message-sentiment-v1"
MESSAGE_INPUT = "sentiment-message-only-v1"
FEEDBACK_METRIC = "agent-feedback-v1"
FEEDBACK_INPUT = "feedback-visible-events-v1"
MESSAGE_TENANT = "public-agent-trace-sentiment"


def imported(rows: DataFrame, dataset_id: str, revision: str, seed: int = 42, tenant: str = MESSAGE_TENANT) -> tuple[DataFrame, DataFrame]:
    """(examples, references) of rows (id, source_dataset, session_id, content_text, sentiment_label).

    Only these five columns are read. The group is the digest of [source, session], so a session stays in one split; the
    input id is the digest of the identity; labels go to the references alone. Rows with a null in id, source, session or
    text are left out. revision is a full 40-digit hash.
    """
    if not re.fullmatch(r"[0-9a-f]{40}", revision):
        raise ValueError("revision is a full 40-digit hash")
    r = rows.select(F.col("id").cast("string").alias("id"), "source_dataset", "session_id", "content_text", "sentiment_label").dropna(subset=["id", "source_dataset", "session_id", "content_text"])
    r = r.withColumn("trace_id", F.sha2(json_array("source_dataset", "session_id"), 256))
    turn = F.struct(F.col("id").alias("event_id"), F.lit("user").alias("role"), F.col("content_text").alias("text"))
    identity = {
        "tenant_id": F.lit(tenant), "trace_id": F.col("trace_id"), "branch_id": F.lit("unknown"), "target_event_id": F.col("id"), "metric_version": F.lit(IMPORT_METRIC),
        "input_version": F.lit(MESSAGE_INPUT), "context": F.array(turn), "context_status": F.lit("complete"), "context_scope": F.lit("message_only"),
        "history_available": F.lit(False), "dataset_id": F.lit(dataset_id), "dataset_revision": F.lit(revision),
    }
    full = r.select(
        *[v.alias(k) for k, v in identity.items()], digest(identity).alias("input_id"), F.col("trace_id").alias("group_id"), F.lit("unknown").alias("language"), "source_dataset",
        split_for(F.lit(tenant), "trace_id", seed).alias("split"), F.lit(seed).alias("split_seed"), "sentiment_label",
    )
    refs = full.select("input_id", F.col("target_event_id").alias("source_row_id"), "sentiment_label", F.lit("dataset_llm").alias("label_source"), "dataset_id", "dataset_revision")
    return full.drop("sentiment_label"), refs


def message_input(messages: DataFrame) -> DataFrame:
    """Unlabelled examples of new messages (tenant_id, session_id, message_id, text): split inference, group = digest of [tenant, session]."""
    m = messages.dropna(subset=["tenant_id", "session_id", "message_id", "text"]).withColumn("__g", F.sha2(json_array("tenant_id", "session_id"), 256))
    turn = F.struct(F.col("message_id").alias("event_id"), F.lit("user").alias("role"), "text")
    identity = {
        "tenant_id": F.col("tenant_id"), "trace_id": F.col("__g"), "branch_id": F.lit("unknown"), "target_event_id": F.col("message_id"), "metric_version": F.lit(MESSAGE_METRIC),
        "input_version": F.lit(MESSAGE_INPUT), "context": F.array(turn), "context_status": F.lit("complete"), "context_scope": F.lit("message_only"), "history_available": F.lit(False),
    }
    return m.select(*[v.alias(k) for k, v in identity.items()], digest(identity).alias("input_id"), F.col("__g").alias("group_id"), F.lit("inference").alias("split"), F.lit("unknown").alias("language"))


def feedback_input(examples: DataFrame) -> DataFrame:
    """Examples re-identified for the feedback tasks: the new input_id is the digest of ten fields, original_input_id keeps the first one (doing it twice changes nothing).

    Columns named sentiment_label, source_label and reason are dropped.
    """
    e = examples.drop("sentiment_label", "source_label", "reason")
    first = F.col("original_input_id") if "original_input_id" in e.columns else F.col("input_id")
    e = e.withColumns({"original_input_id": first, "metric_version": F.lit(FEEDBACK_METRIC), "input_version": F.lit(FEEDBACK_INPUT)})
    fields = ("tenant_id", "trace_id", "branch_id", "target_event_id", "context", "context_scope", "context_status", "history_available", "metric_version", "input_version")
    return e.withColumn("input_id", digest({k: F.col(k) for k in fields}))


def context_errors(examples: DataFrame) -> DataFrame:
    """(input_id, error): empty_context, repeated_event, not_ending_at_target or not_a_user_target."""
    ids = F.transform("context", lambda t: t.event_id)
    last = F.try_element_at("context", F.lit(-1))
    e = (
        F.when(F.coalesce(F.size("context"), F.lit(0)) < 1, "empty_context")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated_event")
        .when(~F.coalesce(last.event_id == F.col("target_event_id"), F.lit(False)), "not_ending_at_target")
        .when(~F.coalesce(last.role == "user", F.lit(False)), "not_a_user_target")
    )
    return examples.select("input_id", e.alias("error")).filter("error IS NOT NULL")


def cache_key(examples: DataFrame) -> Column:
    """Key under which equal requests share an answer: for a single message the digest of [tenant, scope, status, history flag, role, text], else the input id."""
    last = F.element_at("context", -1)
    parts = [string_json(F.col(c)) for c in ("tenant_id", "context_scope", "context_status")] + [F.col("history_available").cast("string"), string_json(last.role), string_json(last.text)]
    key = F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)
    return F.when((F.col("context_scope") == "message_only") & (F.size("context") == 1), key).otherwise(F.col("input_id"))


def request_text(examples: DataFrame, message_only: Column) -> Column:
    """What a model reads: the bare text of a single message, else the canonical JSON of the visible turns; never a label or metadata."""
    return F.when(message_only, F.element_at("context", -1).text).otherwise(canonical({"events": F.col("context"), "context_status": F.col("context_status"), "target_event_id": F.col("target_event_id")}))


def over_input_limit(system: str, user: Column, limit: int) -> Column:
    """Whether system prompt and request together exceed the limit in code points."""
    return F.length(user) + len(system) > limit
