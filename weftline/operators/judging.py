"""Answers of a labelling service: validation, consensus of repeats, agreement with references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schemas import LABELS

MAX_EVIDENCE, MAX_EVIDENCE_CHARS = 2, 240


def unfenced(content: Column) -> Column:
    """Content without one surrounding JSON code fence."""
    c = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(c.rlike(r"(?s)^```(?:json)?\s*\n.*\n?```$"), F.regexp_extract(c, r"(?s)^```(?:json)?\s*\n(.*?)\s*```$", 1)).otherwise(c)


def answer_error(content: Column, keys: dict[str, tuple[str, ...] | None], max_chars: int = 600) -> Column:
    """Null for a valid answer, else not_json, wrong_keys, wrong_label or wrong_text.

    The answer is one JSON object with exactly these keys; a key with values must have one of them, a key without must be
    a string of 1 to max_chars characters that isn't blank.
    """
    c = unfenced(content)
    have = F.json_object_keys(c)
    names = F.array(*[F.lit(k) for k in sorted(keys)])
    get = lambda k: F.get_json_object(c, f"$.{k}")
    label = F.lit(False)
    text = F.lit(False)
    for k, allowed in keys.items():
        if allowed:
            label = label | ~F.coalesce(get(k).isin(*allowed), F.lit(False))
        else:
            text = text | ~F.coalesce(F.length(get(k)).between(1, max_chars) & get(k).rlike(r"\S"), F.lit(False))
    return F.when(have.isNull(), "not_json").when(F.array_sort(have) != names, "wrong_keys").when(label, "wrong_label").when(text, "wrong_text")


def feedback_error(text: Column, signal: Column) -> Column:
    """Null for a valid signal (label, reason, evidence) of a text, else the first rule that it breaks.

    missing, wrong_label, too_much_evidence (more than two), empty_or_long_evidence, evidence_not_in_text, yes_without_evidence.
    """
    ev = F.coalesce(signal.getField("evidence"), F.array().cast("array<string>"))
    label = signal.getField("label")
    return (
        F.when(signal.isNull() | label.isNull(), "missing")
        .when(~label.isin(*LABELS), "wrong_label")
        .when(F.size(ev) > MAX_EVIDENCE, "too_much_evidence")
        .when(F.exists(ev, lambda e: e.isNull() | ~F.length(e).between(1, MAX_EVIDENCE_CHARS)), "empty_or_long_evidence")
        .when(F.exists(ev, lambda e: ~F.coalesce(F.contains(text, e), F.lit(False))), "evidence_not_in_text")
        .when((label == "yes") & (F.size(ev) == 0), "yes_without_evidence")
    )


def tags_error(tags: Column, allowed: tuple[str, ...], any_yes: Column) -> Column:
    """Null, repeated_tag, unknown_tag or tag_without_yes."""
    t = F.coalesce(tags, F.array().cast("array<string>"))
    return (
        F.when(F.size(F.array_distinct(t)) != F.size(t), "repeated_tag")
        .when(F.size(F.array_except(t, F.array(*[F.lit(a) for a in allowed]))) > 0, "unknown_tag")
        .when((F.size(t) > 0) & ~any_yes, "tag_without_yes")
    )


def consensus(inputs: DataFrame, calls: DataFrame, repeats: int) -> DataFrame:
    """(input_id, n_ok, n_labels, label, outcome): one label if exactly `repeats` calls are ok and agree.

    outcome: agreed, unresolved (ok but different), incomplete (another number of ok calls). label is null unless agreed.
    """
    ok = F.col("runtime_status") == "ok"
    c = calls.groupBy("input_id").agg(F.count_if(ok).alias("n_ok"), F.min(F.when(ok, F.col("label"))).alias("lo"), F.max(F.when(ok, F.col("label"))).alias("hi"), F.count_if(ok & F.col("label").isNull()).alias("nolabel"))
    j = inputs.select("input_id").distinct().join(c, "input_id", "left").fillna(0, ["n_ok", "nolabel"])
    same = (F.col("lo") == F.col("hi")) & (F.col("nolabel") == 0)
    outcome = F.when(F.col("n_ok") != repeats, "incomplete").when(F.coalesce(same, F.lit(False)), "agreed").otherwise("unresolved")
    return j.select("input_id", "n_ok", outcome.alias("outcome"), F.when(outcome == "agreed", F.col("lo")).alias("label"))


def repeat_agreement(calls: DataFrame) -> DataFrame:
    """(inputs_with_repeats, agreeing, fraction) over inputs with at least two ok calls."""
    c = calls.filter("runtime_status = 'ok'").groupBy("input_id").agg(F.count("*").alias("n"), (F.min("label") == F.max("label")).alias("same")).filter("n > 1")
    return c.agg(F.count("*").alias("inputs_with_repeats"), F.count_if("same").alias("agreeing")).withColumn("fraction", F.try_divide("agreeing", "inputs_with_repeats"))


def primary(calls: DataFrame) -> DataFrame:
    """The call of repeat 0 of each input."""
    return calls.filter("repeat = 0")


def disagreements(calls: DataFrame, references: DataFrame) -> DataFrame:
    """(input_id, label, reference) of ok primary calls that differ from the reference."""
    return primary(calls).filter("runtime_status = 'ok'").join(references.select("input_id", "reference"), "input_id").filter("label <> reference").select("input_id", "label", "reference")


def coverage_agreement(calls: DataFrame, references: DataFrame) -> DataFrame:
    """(inputs, ok, agreement_on_ok, agreement_with_failures): both denominators; failures count as disagreement in the second."""
    j = references.select("input_id", "reference").join(primary(calls).select("input_id", "runtime_status", "label"), "input_id", "left")
    ok = F.coalesce(F.col("runtime_status") == "ok", F.lit(False))
    r = j.agg(F.count("*").alias("inputs"), F.count_if(ok).alias("ok"), F.count_if(ok & (F.col("label") == F.col("reference"))).alias("agreeing"))
    return r.withColumns({"agreement_on_ok": F.try_divide("agreeing", "ok"), "agreement_with_failures": F.try_divide("agreeing", "inputs")})
