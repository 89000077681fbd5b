"""Queries over imported messages, annotations and compared predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.canon import json_array
from weftline.operators import checks, dataset
from weftline.plans.feedback_queries import INPUTS, inputs, predictions
from weftline.plans.trace_queries import DRAW
from weftline.session import table

REVISION, DATASET = "0123456789abcdef0123456789abcdef01234567", "feedback-messages"


def _rows(spark, d):
    lab = table(spark, d, "feedback_labels").select("input_id", F.col("dissatisfaction.label").alias("sentiment_label"))
    return inputs(spark, d).join(lab, "input_id", "left").select(F.col("input_id").alias("id"), "source_dataset", "session_id", F.col("text").alias("content_text"), "sentiment_label")


def imported_examples(spark, d):
    ex, _ = dataset.imported(_rows(spark, d), DATASET, REVISION)
    return ex.select("target_event_id", "input_id", "group_id", "split")


def imported_references(spark, d):
    return dataset.imported(_rows(spark, d), DATASET, REVISION)[1].select("source_row_id", "sentiment_label", "label_source")


def new_messages(spark, d):
    return dataset.message_input(inputs(spark, d)).select("input_id", "target_event_id", "tenant_id", "group_id", "split")


def cache_keys(spark, d):
    """Requests by cache key: how many inputs share one answer."""
    ex = dataset.imported(_rows(spark, d), DATASET, REVISION)[0]
    k = ex.select(dataset.cache_key(ex).alias("k")).groupBy("k").agg(F.count("*").alias("n_inputs"))
    return k.groupBy("n_inputs").agg(F.count("*").alias("n_requests"))


def feedback_inputs_identity(spark, d):
    """Imported messages re-identified for the feedback tasks."""
    ex = dataset.imported(_rows(spark, d), DATASET, REVISION)[0]
    return dataset.feedback_input(ex).select("target_event_id", "input_id")


def input_limit(spark, d):
    """Messages whose request exceeds 400 characters with a system prompt of 40."""
    x = inputs(spark, d).filter(dataset.over_input_limit("s" * 40, F.col("text"), 400))
    return x.select("input_id", F.length("text").alias("n_chars"))


def annotation_errors(spark, d):
    """Labels as annotations of the messages: null and foreign sources, labels without evidence of the target."""
    ex = dataset.message_input(inputs(spark, d)).select(F.concat_ws("/", "tenant_id", "group_id", "target_event_id").alias("input_id"), "target_event_id", "context")
    key = inputs(spark, d).select("input_id", F.concat_ws("/", "tenant_id", F.sha2(json_array("tenant_id", "session_id"), 256), "message_id").alias("k"), "message_id")
    lab = table(spark, d, "feedback_labels").join(key, "input_id")
    yes = F.col("correction.label") == "yes"
    a = lab.select(F.col("k").alias("input_id"), F.col("dissatisfaction.label").alias("label"), "label_source", F.col("judge_version").alias("annotator"), F.when(F.coalesce(yes, F.lit(False)), F.array("message_id")).alias("evidence_event_ids"))
    return checks.annotation_errors(ex, a, ("human", "llm_judge"))


def leakage_guard(spark, d):
    """Held-out messages whose session or project was trained on."""
    x = inputs(spark, d).withColumn("group_id", F.coalesce("group_id", "session_id"))
    return checks.leaking_groups(x.filter("split = 'train'"), x.filter("split IN ('calibration', 'test')"), "tenant_id", "group_id").select("input_id", "split")


def label_versions(spark, d):
    return checks.version_mix(table(spark, d, "feedback_labels"), "judge_version")


def prediction_drift(spark, d):
    """Predictions against a copy without one model version and with rounded scores."""
    p = predictions(spark, d).withColumn("score", F.when(F.isnan("score"), None).otherwise(F.col("score")))
    q = p.filter("model_version = 'student-a3'").withColumn("score", F.floor(F.col("score") * 10) / 10)
    return checks.prediction_drift(p, q, "input_id", "runtime_status", "score")


QUERIES = {f.__name__: f for f in (imported_examples, imported_references, new_messages, cache_keys, feedback_inputs_identity, input_limit, annotation_errors, leakage_guard, label_versions, prediction_drift)}

_T = dataset.MESSAGE_TENANT
_IMP = f"""WITH {INPUTS}, m AS (SELECT *, sha256(to_json([source_dataset, session_id])::VARCHAR) AS group_id2 FROM i WHERE source_dataset IS NOT NULL AND session_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT *, {DRAW.format(ns='split-v1', key=f"to_json(['{_T}', group_id2])")} AS u FROM m)"""
ORACLE = {
    "imported_examples": _IMP + f""" SELECT input_id AS target_event_id, group_id2 AS group_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'calibration' ELSE 'test' END AS split,
        sha256(to_json(struct_pack(branch_id := 'unknown', context := [struct_pack(event_id := input_id, role := 'user', text := text)], context_scope := 'message_only', context_status := 'complete', dataset_id := '{DATASET}',
        dataset_revision := '{REVISION}', history_available := false, input_version := 'sentiment-message-only-v1', metric_version := 'agent-dissatisfaction-message-v1', target_event_id := input_id, tenant_id := '{_T}', trace_id := group_id2))::VARCHAR) AS input_id FROM u""",
    "feedback_inputs_identity": _IMP + f""" SELECT input_id AS target_event_id, sha256(to_json(struct_pack(branch_id := 'unknown', context := [struct_pack(event_id := input_id, role := 'user', text := text)], context_scope := 'message_only',
        context_status := 'complete', history_available := false, input_version := '{dataset.FEEDBACK_INPUT}', metric_version := '{dataset.FEEDBACK_METRIC}', target_event_id := input_id, tenant_id := '{_T}', trace_id := group_id2))::VARCHAR) AS input_id FROM u""",
    "imported_references": _IMP + " SELECT input_id AS source_row_id, dissatisfaction.label AS sentiment_label, 'dataset_llm' AS label_source FROM m LEFT JOIN feedback_labels USING (input_id)",
    "new_messages": f"""WITH {INPUTS}, g AS (SELECT *, sha256(to_json([tenant_id, session_id])::VARCHAR) AS g FROM i WHERE text IS NOT NULL) SELECT message_id AS target_event_id, tenant_id, g AS group_id, 'inference' AS split,
        sha256(to_json(struct_pack(branch_id := 'unknown', context := [struct_pack(event_id := message_id, role := 'user', text := text)], context_scope := 'message_only', context_status := 'complete', history_available := false,
        input_version := 'sentiment-message-only-v1', metric_version := 'message-sentiment-v1', target_event_id := message_id, tenant_id := tenant_id, trace_id := g))::VARCHAR) AS input_id FROM g""",
    "cache_keys": f"WITH {INPUTS}, k AS (SELECT count(*) AS n_inputs FROM i WHERE text IS NOT NULL GROUP BY text) SELECT n_inputs, count(*) AS n_requests FROM k GROUP BY 1",
    "input_limit": f"WITH {INPUTS} SELECT input_id, length(text)::INT AS n_chars FROM i WHERE length(text) + 40 > 400",
    "annotation_errors": f"""WITH {INPUTS}, x AS (SELECT tenant_id || '/' || sha256(to_json([tenant_id, session_id])::VARCHAR) || '/' || message_id AS input_id, l.input_id AS lid, l.dissatisfaction.label AS label, l.label_source AS src, l.judge_version AS ann, coalesce(l.correction.label = 'yes', false) AS cited
        FROM i LEFT JOIN feedback_labels l ON l.input_id = i.input_id), e AS (SELECT input_id, CASE WHEN lid IS NULL THEN 'missing_annotation' WHEN coalesce(label, '') NOT IN ('yes', 'no', 'unclear') THEN 'wrong_label'
        WHEN coalesce(src, '') NOT IN ('human', 'llm_judge') THEN 'wrong_source' WHEN coalesce(trim(ann), '') = '' THEN 'no_annotator' WHEN label = 'yes' AND NOT cited THEN 'yes_without_target' END AS error FROM x) SELECT * FROM e WHERE error IS NOT NULL""",
    "leakage_guard": f"""WITH {INPUTS}, g AS (SELECT *, coalesce(group_id, session_id) AS g FROM i) SELECT input_id, split FROM g WHERE split IN ('calibration', 'test') AND (tenant_id, g) IN (SELECT (tenant_id, g) FROM g WHERE split = 'train')""",
    "label_versions": "SELECT count(DISTINCT judge_version) AS n_versions, count(*) FILTER (judge_version IS NULL) AS n_missing FROM feedback_labels",
    "prediction_drift": """WITH p AS (SELECT DISTINCT input_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, runtime_status, model_version FROM predictions), j AS (SELECT p.score AS a, floor(q.score * 10) / 10 AS b, q.input_id AS q FROM p LEFT JOIN p q ON q.input_id = p.input_id AND q.model_version = 'student-a3')
        SELECT count(q) AS n_both, count(*) FILTER (q IS NULL) AS n_only_one, 0::BIGINT AS label_changes, max(abs(a - b)) AS max_score_change, count(*) FILTER (q IS NOT NULL AND (a IS NULL) <> (b IS NULL)) AS score_presence_changes FROM j""",
}
