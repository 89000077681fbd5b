"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _B, _L, _D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, *rest) for n, t, *rest in fields])


EVENT = _struct(
    ("tenant_id", _S, False), ("trace_id", _S, False), ("event_id", _S, False), ("parent_id", _S), ("branch_id", _S, False), ("sequence", _L, False),
    ("role", _S, False), ("visibility", _S, False), ("text", _S, False), ("status", _S), ("language", _S), ("group_id", _S),
)
CONTEXT = T.ArrayType(_struct(("event_id", _S), ("role", _S), ("text", _S)))
PREDICTION = _struct(("input_id", _S), ("score", _D), ("runtime_status", _S), ("model_abstention", _B), ("model_version", _S), ("context_status", _S))
SIGNAL = _struct(("label", _S), ("reason", _S), ("evidence", T.ArrayType(_S)))
FEEDBACK_LABEL = _struct(("input_id", _S), ("dissatisfaction", SIGNAL), ("correction", SIGNAL), ("reason_tags", T.ArrayType(_S)), ("label_source", _S), ("judge_version", _S))
ATTEMPT = _struct(("runtime_status", _S), ("elapsed_seconds", _D), ("http_status", T.IntegerType()), ("error_type", _S), ("prompt_tokens", _L), ("completion_tokens", _L), ("total_tokens", _L))
CALL = _struct(
    ("call_id", _S), ("input_id", _S), ("repeat", T.IntegerType()), ("judge_version", _S), ("prompt_hash", _S), ("attempt_no", _L), ("runtime_status", _S), ("error_type", _S),
    ("attempts", T.ArrayType(ATTEMPT)), ("label", _S),
)

# Domains of the event log and the label vocabulary.
ROLES = ("user", "assistant", "tool", "system")
VISIBILITIES = ("user_visible", "internal")
STATUSES = ("completed", "partial", "cancelled")
LABELS = ("yes", "no", "unclear")
SPLITS = ("train", "calibration", "test")
