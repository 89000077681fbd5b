"""Queries over feedback inputs, predictions and labels: routing, sampling, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.canon import json_array, split_for, uniform
from weftline.operators import checks, dedup, routing, sampling
from weftline.plans.trace_queries import DRAW
from weftline.session import table

SHADOW, CASCADE = routing.Policy(), routing.Policy(mode="cascade", threshold=0.6, audit_rate=0.2)
COLUMNS = ["input_id", "tenant_id", "session_id", "message_id", "text", "language", "group_id", "split", "source_dataset", "history_available"]


def inputs(spark, d):
    """feedback_inputs without redeliveries."""
    return table(spark, d, "feedback_inputs").select(*COLUMNS).distinct()


def examples(spark, d):
    """Inputs as message-only examples: the session is the trace, the context is the message."""
    return inputs(spark, d).select(
        "input_id", "tenant_id", F.col("session_id").alias("trace_id"), F.lit("complete").alias("context_status"), F.coalesce("language", F.lit("unknown")).alias("language"),
        F.coalesce("group_id", "session_id").alias("group_id"), "split", "text", "source_dataset",
    )


def predictions(spark, d):
    return table(spark, d, "predictions").drop("scored_ts").distinct()


def labels(spark, d):
    return table(spark, d, "feedback_labels").select("input_id", F.col("dissatisfaction.label").alias("label")).filter("label IS NOT NULL")


def split_assignment(spark, d):
    return examples(spark, d).select("input_id", split_for("tenant_id", "group_id").alias("assigned"))


def split_counts(spark, d):
    return split_assignment(spark, d).groupBy("assigned").agg(F.count("*").alias("n"))


def duplicate_predictions(spark, d):
    return checks.duplicate_keys(table(spark, d, "predictions"), "input_id")


def invalid_scores(spark, d):
    return checks.bad_probabilities(predictions(spark, d), "score").select("input_id", "runtime_status")


def stale_predictions(spark, d):
    return checks.stale(predictions(spark, d), inputs(spark, d), "input_id")


def prediction_gaps(spark, d):
    return checks.coverage_gaps(inputs(spark, d), predictions(spark, d), "input_id")


def audit_draws(spark, d):
    t = examples(spark, d).select("tenant_id", "trace_id").distinct()
    return t.select("tenant_id", "trace_id", uniform(42, "audit-v1", json_array("tenant_id", "trace_id")).alias("draw"))


def route_members(spark, d):
    return routing.members(examples(spark, d), predictions(spark, d), CASCADE)


def route_shadow(spark, d):
    return routing.route(examples(spark, d), predictions(spark, d), SHADOW).drop("policy_id")


def route_cascade(spark, d):
    return routing.route(examples(spark, d), predictions(spark, d), CASCADE).drop("policy_id")


def sample_control(spark, d):
    """Every score 0: only safety and audit route."""
    zero = predictions(spark, d).withColumn("score", F.lit(0.0))
    return routing.route(examples(spark, d), zero, CASCADE).drop("policy_id")


def evaluate_routing(spark, d):
    m = routing.members(examples(spark, d), predictions(spark, d), CASCADE)
    return routing.evaluate(m, routing.decide(m, CASCADE), labels(spark, d))


def prevalence_ht(spark, d):
    m = routing.members(examples(spark, d), predictions(spark, d), CASCADE)
    return routing.prevalence(m, routing.decide(m, CASCADE), labels(spark, d))


def clustered_flag(spark, d):
    return routing.clustered(examples(spark, d))


def recall_lower_bound(spark, d):
    """The exact bound of the cascade's trace recall."""
    r = evaluate_routing(spark, d).select("filter_hits", "positive_traces").first()
    return spark.createDataFrame([(r[0], r[1], routing.recall_lower_bound(r[0], r[1]))], "hits long, positives long, lower_bound double")


def _labelled(spark, d):
    return inputs(spark, d).filter("split = 'calibration'").join(labels(spark, d), "input_id")


def stratified_pilot(spark, d):
    return sampling.stratified_pilot(_labelled(spark, d), "input_id", "label", 40)


def top_pilot(spark, d):
    return sampling.top_n(inputs(spark, d), "input_id", 100, "feedback-pilot").select("input_id")


def hash_order(spark, d):
    return sampling.hash_order(inputs(spark, d).filter("split = 'train'").select("input_id"), "input_id", "student-order-v1")


def learning_curve_sets(spark, d):
    g = inputs(spark, d).filter("split = 'train'").groupBy(F.concat_ws("/", "tenant_id", "session_id").alias("session")).agg(F.count("*").alias("n"))
    return sampling.nested_prefix(g, "session", "n", (100, 400))


def greedy_sample(spark, d):
    x = inputs(spark, d).join(labels(spark, d), "input_id").withColumn("session", F.concat_ws("/", "tenant_id", "session_id"))
    return sampling.greedy_exclusive(x, "input_id", "label", "text", "session", 20)


def texts_shared_across_splits(spark, d):
    return dedup.shared_across_splits(inputs(spark, d))


def exact_duplicate_groups(spark, d):
    return dedup.exact_duplicate_groups(inputs(spark, d), "input_id")


def canonical_mapping(spark, d):
    return dedup.canonical_mapping(inputs(spark, d), "input_id", ["tenant_id", "history_available", "text"])


def label_fanout(spark, d):
    """Labels of canonical inputs for all their copies."""
    return canonical_mapping(spark, d).join(labels(spark, d).withColumnRenamed("input_id", "canonical"), "canonical").select("input_id", "canonical", "label")


def near_duplicate_links(spark, d):
    return dedup.near_duplicates(dedup.text_classes(inputs(spark, d), "input_id"), "input_id")


def duplicate_components(spark, d):
    return dedup.duplicate_components(inputs(spark, d), "input_id")


def _cleaned(spark, d):
    x = inputs(spark, d).filter("split IS NOT NULL").withColumn("group_id", F.coalesce("group_id", "session_id"))
    seen = x.filter("split = 'test' AND source_dataset = 'synthetic-seed'")
    return x, dedup.clean_splits(x, dedup.duplicate_components(x, "input_id"), seen, limit=100_000)


def clean_splits(spark, d):
    return _cleaned(spark, d)[1]


def exclusion_counts(spark, d):
    return _cleaned(spark, d)[1].groupBy("split", "reason").agg(F.count("*").alias("n"))


def split_overlap_check(spark, d):
    """Components that still stand in several splits after cleaning: none."""
    x, clean = _cleaned(spark, d)
    kept = clean.filter("reason IS NULL").select("input_id", "split").join(dedup.duplicate_components(x, "input_id"), "input_id")
    return dedup.split_overlaps(kept, "component")


def dataset_manifest(spark, d):
    return inputs(spark, d).groupBy("source_dataset", "split").agg(F.count("*").alias("messages"), F.countDistinct("tenant_id", "session_id").alias("sessions"), F.countDistinct("text").alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (
        split_assignment, split_counts, duplicate_predictions, invalid_scores, stale_predictions, prediction_gaps, audit_draws, route_members, route_shadow, route_cascade, sample_control,
        evaluate_routing, prevalence_ht, clustered_flag, recall_lower_bound, stratified_pilot, top_pilot, hash_order, learning_curve_sets, greedy_sample, texts_shared_across_splits,
        exact_duplicate_groups, canonical_mapping, label_fanout, near_duplicate_links, duplicate_components, clean_splits, exclusion_counts, split_overlap_check, dataset_manifest,
    )
}

INPUTS = f"i AS (SELECT DISTINCT {', '.join(COLUMNS)} FROM feedback_inputs)"
_EX = f"""{INPUTS}, e AS (SELECT input_id, tenant_id, session_id AS trace_id, coalesce(language, 'unknown') AS language, coalesce(group_id, session_id) AS group_id FROM i),
p AS (SELECT DISTINCT input_id, score, runtime_status, model_abstention, model_version, context_status FROM predictions),
lab AS (SELECT input_id, dissatisfaction.label AS label FROM feedback_labels WHERE dissatisfaction.label IS NOT NULL)"""
_IN_JSON = "'\"' || {} || '\"'"


def _members(threshold: float, score: str = "CASE WHEN isnan(p.score) THEN NULL ELSE p.score END") -> str:
    return f"""{_EX}, x AS (SELECT e.*, p.model_version, p.input_id IS NOT NULL AS hasp, coalesce(p.runtime_status, 'missing') AS rs, coalesce(p.model_abstention, false) AS ab,
        CASE WHEN coalesce(p.context_status, 'complete') <> 'complete' THEN 'not_evaluated' ELSE coalesce(p.runtime_status, 'missing') END AS r, {score} AS s FROM e LEFT JOIN p USING (input_id)),
    m AS (SELECT tenant_id, trace_id, input_id, r = 'ok' AND coalesce(s >= {threshold}, false) AS model_selected, r <> 'ok' OR ab OR s IS NULL OR language = 'unknown' AS safety_selected,
        rs = 'ok' AND s IS NOT NULL AS scored, model_version FROM x)"""


def _route(threshold: float, rate: float, shadow: bool, **kw) -> str:
    u = DRAW.format(ns="audit-v1", key="to_json([tenant_id, trace_id])")
    return f"""WITH {_members(threshold, **kw)}, a AS (SELECT tenant_id, trace_id, count(*) AS n_inputs, count(*) FILTER (model_selected) AS n_model_selected, count(*) FILTER (safety_selected) AS n_safety_selected,
        bool_or(model_selected OR safety_selected) AS filter_selected FROM m GROUP BY ALL),
    dec AS (SELECT *, NOT filter_selected AND {u} < {rate} AS audit_selected, filter_selected OR audit_selected AS would_route, {'true' if shadow else 'filter_selected OR audit_selected'} AS routed,
        {'1.0' if shadow else f'CASE WHEN filter_selected THEN 1.0 ELSE {rate} END'}::DOUBLE AS inclusion_probability, (CASE WHEN filter_selected THEN 1.0 ELSE {rate} END)::DOUBLE AS candidate_inclusion_probability FROM a)"""


_C = _route(0.6, 0.2, False)
_EVAL = _C + """, t AS (SELECT m.tenant_id, m.trace_id, count(*) FILTER (label = 'yes') AS ny, count(*) FILTER (label = 'unclear') AS nu, count(*) FILTER (label = 'yes' AND model_selected) AS mh, count(*) FILTER (NOT scored) AS un
        FROM m LEFT JOIN lab USING (input_id) GROUP BY ALL), z AS (SELECT dec.*, ny, nu, mh, un, ny > 0 AS pos, ny = 0 AND nu > 0 AS unc, ny = 0 AND nu = 0 AS neg FROM dec JOIN t USING (tenant_id, trace_id))
    SELECT count(*) AS traces, sum(n_inputs)::BIGINT AS messages, count(*) FILTER (pos) AS positive_traces, count(*) FILTER (neg) AS negative_traces, count(*) FILTER (unc) AS unclear_traces, sum(nu)::BIGINT AS unclear_messages,
        count(*) FILTER (neg AND filter_selected) AS filter_false_positive_traces, count(*) FILTER (filter_selected) AS filter_selected_traces, count(*) FILTER (n_safety_selected > 0) AS safety_selected_traces,
        count(*) FILTER (audit_selected) AS audit_selected_traces, count(*) FILTER (would_route) AS candidate_routed_traces, count(*) FILTER (routed) AS actual_routed_traces,
        coalesce(sum(n_inputs) FILTER (would_route), 0)::BIGINT AS candidate_routed_messages, coalesce(sum(n_inputs) FILTER (routed), 0)::BIGINT AS actual_routed_messages, sum(un)::BIGINT AS unscored_or_failed_messages,
        count(*) FILTER (pos AND filter_selected) / nullif(count(*) FILTER (pos), 0) AS filter_trace_recall, count(*) FILTER (pos AND would_route) / nullif(count(*) FILTER (pos), 0) AS candidate_routing_trace_recall_with_audit,
        count(*) FILTER (pos AND routed) / nullif(count(*) FILTER (pos), 0) AS actual_routing_trace_recall, sum(mh) / nullif(sum(ny), 0) AS model_message_recall,
        coalesce(sum(ny) FILTER (filter_selected), 0) / nullif(sum(ny), 0) AS filter_message_coverage, count(*) FILTER (pos AND filter_selected) AS filter_hits FROM z"""
_SPLIT = DRAW.format(ns="split-v1", key="to_json([tenant_id, group_id])")
# fixed values: what folding changes in these tables (full-width forms, blanks, numero and ordinal signs, sharp s)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def folded_sql(c: str) -> str:
    return f"""trim(regexp_replace(replace(replace(replace(lower(translate({c}, '{_WIDE}' || chr(12288) || chr(160) || chr(8195), '{_NARROW}' || '   ')), chr(8470), 'no'), chr(223), 'ss'), chr(186), 'o'), '\\s+', ' ', 'g'))"""


_GRAMS = "list_distinct([substr({0}, i, 5) for i in range(1, length({0}) - 3)])"


def _near(rows: str) -> str:
    """class, link and component tables of rows (input_id, text)."""
    return f"""fo AS (SELECT input_id, min({folded_sql('text')}) AS folded FROM {rows} WHERE text IS NOT NULL GROUP BY ALL),
cl AS (SELECT input_id, min(input_id) OVER (PARTITION BY folded) AS class, folded FROM fo),
rp AS (SELECT input_id, length(folded) AS len, {_GRAMS.format('folded')} AS grams FROM cl WHERE input_id = class AND length(folded) >= 80),
gr AS (SELECT input_id, len, len(grams) AS k, unnest(grams) AS g FROM rp),
pr AS (SELECT a.input_id AS "left", b.input_id AS "right", a.k AS x, b.k AS y, a.len AS la, b.len AS lb, count(*) AS sh FROM gr a JOIN gr b ON a.g = b.g AND a.input_id < b.input_id GROUP BY ALL),
li AS (SELECT "left", "right", sh / sqrt(x * y) AS cosine, sh / (x + y - sh) AS jaccard FROM pr
       WHERE sh / sqrt(x * y) >= 0.95 - 1e-9 AND sh / (x + y - sh) >= 0.85 AND least(la, lb) >= 0.85 * greatest(la, lb)),
ed AS (SELECT "left" AS a, "right" AS b FROM li UNION SELECT "right", "left" FROM li UNION SELECT DISTINCT class, class FROM cl),
rc AS (SELECT a, b AS root FROM ed UNION SELECT ed.a, rc.root FROM rc JOIN ed ON ed.b = rc.a),
co AS (SELECT a AS class, min(root) AS component FROM rc GROUP BY ALL),
dc AS (SELECT input_id, class, component, (SELECT count(*) FROM li WHERE "left" = class OR "right" = class) AS n_links FROM cl JOIN co USING (class))"""


_CLEAN = f"""WITH RECURSIVE {INPUTS}, x AS (SELECT * REPLACE (coalesce(group_id, session_id) AS group_id) FROM i WHERE split IS NOT NULL), {_near('x')},
d AS (SELECT input_id, split, group_id, text, component, split = 'test' AND source_dataset = 'synthetic-seed' AS seen FROM x JOIN dc USING (input_id)),
e AS (SELECT *, max(seen) OVER (PARTITION BY input_id) AS s FROM d),
f AS (SELECT input_id, split, component, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 'empty_text' WHEN length(text) > 100000 THEN 'judge_input_limit'
        WHEN split = 'test' AND group_id IN (SELECT group_id FROM e WHERE s) THEN 'previously_reviewed_session'
        WHEN split = 'test' AND component IN (SELECT component FROM e WHERE s) THEN 'duplicate_of_reviewed_message' END AS reason FROM e),
r AS (SELECT *, CASE split WHEN 'test' THEN 2 WHEN 'calibration' THEN 1 ELSE 0 END AS rank FROM f),
z AS (SELECT input_id, split, component, CASE WHEN reason IS NULL AND rank < max(rank) FILTER (reason IS NULL) OVER (PARTITION BY component) THEN 'duplicate_in_higher_priority_split' ELSE reason END AS reason FROM r)
"""
_GREEDY = f"""WITH RECURSIVE {_EX}, q AS (SELECT input_id, label, text, tenant_id || '/' || session_id AS session, row_number() OVER (ORDER BY label, sha256('[42,"tuning-v1","' || input_id || '"]'), input_id) AS rn
        FROM i JOIN lab USING (input_id) WHERE text IS NOT NULL),
w AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS ids, []::VARCHAR[] AS labels, []::VARCHAR[] AS texts, []::VARCHAR[] AS sessions
      UNION ALL SELECT n, CASE WHEN ok THEN list_append(ids, input_id) ELSE ids END, CASE WHEN ok THEN list_append(labels, label) ELSE labels END, CASE WHEN ok THEN list_append(texts, text) ELSE texts END,
        CASE WHEN ok THEN list_append(sessions, session) ELSE sessions END
      FROM (SELECT w.ids, w.labels, w.texts, w.sessions, q.rn AS n, q.input_id, q.label, q.text, q.session,
        NOT list_contains(w.texts, q.text) AND NOT list_contains(w.sessions, q.session) AND len(list_filter(w.labels, lambda x: x = q.label)) < 20 AS ok FROM w JOIN q ON q.rn = w.rn + 1))
SELECT unnest(ids) AS input_id, unnest(labels) AS label FROM (SELECT * FROM w ORDER BY rn DESC LIMIT 1)"""
_ORDER = "sha256('[42,\"{ns}\",\"' || {key} || '\"]')"
ORACLE = {
    "split_assignment": f"WITH {_EX}, u AS (SELECT input_id, {_SPLIT} AS u FROM e) SELECT input_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'calibration' ELSE 'test' END AS assigned FROM u",
    "split_counts": f"WITH {_EX}, u AS (SELECT {_SPLIT} AS u FROM e) SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'calibration' ELSE 'test' END AS assigned, count(*) AS n FROM u GROUP BY ALL",
    "duplicate_predictions": "SELECT input_id, count(*) AS n FROM predictions GROUP BY ALL HAVING count(*) > 1 OR input_id IS NULL",
    "invalid_scores": f"WITH {_EX} SELECT input_id, runtime_status FROM p WHERE score IS NOT NULL AND (isnan(score) OR score < 0 OR score > 1)",
    "stale_predictions": "SELECT DISTINCT input_id FROM predictions WHERE input_id NOT IN (SELECT input_id FROM feedback_inputs)",
    "prediction_gaps": """SELECT DISTINCT input_id, 'left_only' AS side FROM feedback_inputs ANTI JOIN predictions USING (input_id)
        UNION ALL SELECT DISTINCT input_id, 'right_only' FROM predictions ANTI JOIN feedback_inputs USING (input_id)""",
    "audit_draws": f"WITH {_EX}, t AS (SELECT DISTINCT tenant_id, trace_id FROM e) SELECT tenant_id, trace_id, {DRAW.format(ns='audit-v1', key='to_json([tenant_id, trace_id])')} AS draw FROM t",
    "route_members": f"WITH {_members(0.6)} SELECT * FROM m",
    "route_shadow": _route(0.5, 0.1, True) + " SELECT * FROM dec",
    "route_cascade": _C + " SELECT * FROM dec",
    "sample_control": _route(0.6, 0.2, False, score="CASE WHEN p.input_id IS NOT NULL THEN 0.0 END") + " SELECT * FROM dec",
    "evaluate_routing": _EVAL,
    "prevalence_ht": _C + """, w AS (SELECT label, 1 / inclusion_probability AS w FROM m JOIN dec USING (tenant_id, trace_id) JOIN lab USING (input_id) WHERE routed),
        h AS (SELECT coalesce(sum(w) FILTER (label = 'yes'), 0)::DOUBLE AS ht_yes, coalesce(sum(w) FILTER (label = 'no'), 0)::DOUBLE AS ht_no, coalesce(sum(w) FILTER (label = 'unclear'), 0)::DOUBLE AS ht_unclear, count(*) AS reviewed_messages FROM w)
        SELECT *, ht_yes / nullif(ht_yes + ht_no, 0) AS yes_among_clear, ht_unclear / nullif(ht_yes + ht_no + ht_unclear, 0) AS unclear_fraction FROM h""",
    "clustered_flag": f"WITH {_EX} SELECT bool_or(n > 1) AS clustered FROM (SELECT count(DISTINCT trace_id) AS n FROM e GROUP BY tenant_id, group_id)",
    "stratified_pilot": f"""WITH {_EX}, c AS (SELECT input_id, label, row_number() OVER (PARTITION BY label ORDER BY {_ORDER.format(ns='judge-pilot-v1', key='input_id')}) AS r, count(*) OVER (PARTITION BY label) AS population
        FROM i JOIN lab USING (input_id) WHERE split = 'calibration') SELECT input_id, label, population, least(40, population) AS sample_size, least(40, population) / population AS inclusion_probability FROM c WHERE r <= 40""",
    "top_pilot": f"WITH {INPUTS} SELECT input_id FROM i ORDER BY {_ORDER.format(ns='feedback-pilot', key='input_id')} LIMIT 100",
    "hash_order": f"WITH {INPUTS} SELECT input_id, row_number() OVER (ORDER BY {_ORDER.format(ns='student-order-v1', key='input_id')}) - 1 AS position FROM i WHERE split = 'train'",
    "learning_curve_sets": f"""WITH {INPUTS}, g AS (SELECT tenant_id || '/' || session_id AS session, count(*) AS n FROM i WHERE split = 'train' GROUP BY ALL),
        o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {_ORDER.format(ns='student-learning-curve-v1', key='session')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
        SELECT size, session, n FROM o, (VALUES (100), (400)) t(size) WHERE before < size""",
    "texts_shared_across_splits": f"WITH {INPUTS} SELECT sha256(text) AS text_hash, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM i WHERE split IS NOT NULL AND text IS NOT NULL GROUP BY text HAVING n_splits > 1",
    "exact_duplicate_groups": f"WITH {INPUTS} SELECT sha256(text) AS text_hash, min(input_id) AS representative, count(*) AS n_rows FROM i WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "canonical_mapping": f"WITH {INPUTS} SELECT input_id, min(input_id) OVER (PARTITION BY tenant_id, history_available, text) AS canonical FROM i",
    "label_fanout": f"WITH {_EX}, c AS (SELECT input_id, min(input_id) OVER (PARTITION BY tenant_id, history_available, text) AS canonical FROM i) SELECT c.input_id, canonical, label FROM c JOIN lab ON lab.input_id = canonical",
    "greedy_sample": _GREEDY,
    "near_duplicate_links": f"WITH {INPUTS}, {_near('i')} SELECT * FROM li".replace("WITH", "WITH RECURSIVE", 1),
    "duplicate_components": f"WITH RECURSIVE {INPUTS}, {_near('i')} SELECT * FROM dc",
    "clean_splits": _CLEAN + "SELECT input_id, split, reason FROM z",
    "exclusion_counts": _CLEAN + "SELECT split, reason, count(*) AS n FROM z GROUP BY ALL",
    "split_overlap_check": _CLEAN + "SELECT component, count(DISTINCT split) AS n_splits FROM z WHERE reason IS NULL GROUP BY ALL HAVING n_splits > 1",
    "dataset_manifest": f"WITH {INPUTS} SELECT source_dataset, split, count(*) AS messages, count(DISTINCT (tenant_id, session_id)) AS sessions, count(DISTINCT text) AS texts FROM i GROUP BY ALL",
}
