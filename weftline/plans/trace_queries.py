"""Queries over trace_events: checks, deliveries, causal contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import context, events
from weftline.session import materialize, table

MAX_CHARS = 12_000


def _raw(spark, d):
    return table(spark, d, "trace_events")


def _events(spark, d):
    return materialize(events.normalize(_raw(spark, d)), "events")[0]


def events_normalized(spark, d):
    return events.normalize(_raw(spark, d))


def event_violations(spark, d):
    return events.violations(_raw(spark, d)).distinct()


def event_conflicts(spark, d):
    return events.conflicts(_raw(spark, d))


def order_violations(spark, d):
    return events.order_violations(events.normalize(_raw(spark, d)))


def trace_group_changes(spark, d):
    return events.group_changes(_raw(spark, d))


def traces_without_targets(spark, d):
    return events.traces_without_targets(events.normalize(_raw(spark, d)))


def ancestor_closure(spark, d):
    return context.ancestors(_events(spark, d))


def context_budget(spark, d):
    """Which ancestors of which target fit the budget of 12,000 characters."""
    return context.budgeted(_events(spark, d), MAX_CHARS).select("tenant_id", "trace_id", "target", "ancestor", "distance", "visible", "kept", "size")


def causal_context(spark, d):
    return context.context_rows(_events(spark, d), MAX_CHARS)


def context_status_counts(spark, d):
    return context.context_rows(_events(spark, d), MAX_CHARS).groupBy("context_status").agg(F.count("*").alias("n"), F.sum("omitted_ancestors").alias("omitted"))


def causal_examples(spark, d):
    """Identity, split and size of every causal example."""
    e = context.examples(_events(spark, d), MAX_CHARS)
    return e.select("input_id", "tenant_id", "trace_id", "target_event_id", "context_status", "group_id", "split", F.size("context").alias("n_context"))


def causal_split_counts(spark, d):
    """Examples by split and context status."""
    e = context.examples(_events(spark, d), MAX_CHARS)
    return e.groupBy("split", "context_status").agg(F.count("*").alias("n"))


def annotation_form(spark, d):
    e = context.annotation_form(context.examples(_events(spark, d), MAX_CHARS))
    return e.select("target_event_id", "metric_version", "context_status", F.size("context").alias("n_context"), "label", "annotator")


QUERIES = {
    f.__name__: f
    for f in (
        events_normalized, event_violations, event_conflicts, order_violations, trace_group_changes, traces_without_targets, ancestor_closure, context_budget, causal_context,
        context_status_counts, causal_examples, causal_split_counts, annotation_form,
    )
}

_PAYLOAD = "parent_id, branch_id, sequence, role, visibility, text, status, language, group_id"
_NORM = f"""n AS (SELECT tenant_id, trace_id, event_id, unnest(p), conflicting FROM (
    SELECT tenant_id, trace_id, event_id, arg_min(struct_pack(parent_id := parent_id, branch_id := branch_id, sequence := sequence, role := role, visibility := visibility, text := text,
        status := status, language := language, group_id := group_id), received_ts) AS p,
        count(DISTINCT ({_PAYLOAD})) > 1 AS conflicting FROM trace_events GROUP BY ALL))"""
_TARGET = "role = 'user' AND visibility = 'user_visible' AND status = 'completed'"
_WALK = f"""WITH RECURSIVE {_NORM},
k AS (SELECT n.*, p.event_id AS hit FROM n LEFT JOIN n p ON p.tenant_id = n.tenant_id AND p.trace_id = n.trace_id AND p.event_id = n.parent_id),
r AS (SELECT tenant_id, trace_id, event_id, CASE WHEN parent_id IS NULL THEN 'complete' ELSE 'missing_parent' END AS chain FROM k WHERE hit IS NULL
      UNION ALL SELECT k.tenant_id, k.trace_id, k.event_id, r.chain FROM r JOIN k ON k.tenant_id = r.tenant_id AND k.trace_id = r.trace_id AND k.hit = r.event_id),
a AS (SELECT tenant_id, trace_id, event_id AS target, event_id AS ancestor, hit, 0::BIGINT AS distance FROM k SEMI JOIN r USING (tenant_id, trace_id, event_id) WHERE {_TARGET}
      UNION ALL SELECT a.tenant_id, a.trace_id, a.target, k.event_id, k.hit, a.distance + 1 FROM a JOIN k ON k.tenant_id = a.tenant_id AND k.trace_id = a.trace_id AND k.event_id = a.hit),
b AS (SELECT a.tenant_id, a.trace_id, a.target, a.ancestor, a.distance, r.chain, k.role, k.text,
        a.distance = 0 OR (k.visibility = 'user_visible' AND k.status = 'completed' AND k.role <> 'system') AS visible, coalesce(length(k.text), 0) AS len
      FROM a JOIN k ON k.tenant_id = a.tenant_id AND k.trace_id = a.trace_id AND k.event_id = a.ancestor JOIN r ON r.tenant_id = a.tenant_id AND r.trace_id = a.trace_id AND r.event_id = a.target),
c AS (SELECT *, sum(CASE WHEN visible THEN len ELSE 0 END) OVER (PARTITION BY tenant_id, trace_id, target ORDER BY distance)::BIGINT AS size FROM b),
d AS (SELECT *, visible AND (size <= {MAX_CHARS} OR distance = 0) AS kept FROM c),
f AS (SELECT tenant_id, trace_id, target AS event_id, min(chain) AS chain, count(*) FILTER (visible AND NOT kept) AS omitted_ancestors, count(*) FILTER (kept) AS n_context,
        max(size) FILTER (kept) AS context_chars FROM d GROUP BY ALL),
g AS (SELECT *, CASE WHEN chain <> 'complete' THEN chain WHEN omitted_ancestors > 0 OR context_chars > {MAX_CHARS} THEN 'truncated' ELSE 'complete' END AS context_status FROM f)
"""
DRAW = "(('0x' || substr(sha256('[42,\"{ns}\",' || {key} || ']'), 1, 16))::UBIGINT >> 11) / 9007199254740992.0"
_SPLIT = DRAW.format(ns="split-v1", key="to_json([tenant_id, group_id])")
_EXAMPLES = _WALK + f""", h AS (SELECT g.*, k.branch_id, coalesce(k.group_id, g.trace_id) AS group_id FROM g JOIN k USING (tenant_id, trace_id, event_id)),
s AS (SELECT *, {_SPLIT} AS u FROM h), x AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'calibration' ELSE 'test' END AS split FROM s),
t AS (SELECT tenant_id, trace_id, target AS event_id, list(struct_pack(event_id := ancestor, role := role, text := coalesce(text, '')) ORDER BY distance DESC) AS context FROM d WHERE kept GROUP BY ALL),
y AS (SELECT x.*, sha256(to_json(struct_pack(branch_id := branch_id, context := context, context_status := context_status, input_version := 'causal-visible-v1', max_chars := {MAX_CHARS},
        metric_version := 'agent-dissatisfaction-v1', omitted_ancestors := omitted_ancestors, target_event_id := event_id, tenant_id := tenant_id, trace_id := trace_id))::VARCHAR) AS input_id
      FROM x JOIN t USING (tenant_id, trace_id, event_id))
"""
ORACLE = {
    "events_normalized": f"WITH {_NORM} SELECT * FROM n",
    "event_violations": """SELECT DISTINCT tenant_id, trace_id, event_id, violation FROM (SELECT *, unnest([
        CASE WHEN coalesce(tenant_id, '') = '' THEN 'empty_tenant_id' END, CASE WHEN coalesce(trace_id, '') = '' THEN 'empty_trace_id' END, CASE WHEN coalesce(event_id, '') = '' THEN 'empty_event_id' END,
        CASE WHEN coalesce(branch_id, '') = '' THEN 'empty_branch_id' END, CASE WHEN coalesce(language, '') = '' THEN 'empty_language' END, CASE WHEN parent_id = '' THEN 'empty_parent_id' END,
        CASE WHEN group_id = '' THEN 'empty_group_id' END, CASE WHEN coalesce(sequence, -1) < 0 THEN 'negative_sequence' END, CASE WHEN text IS NULL THEN 'missing_text' END,
        CASE WHEN coalesce(role, '') NOT IN ('user', 'assistant', 'tool', 'system') THEN 'unknown_role' END, CASE WHEN coalesce(visibility, '') NOT IN ('user_visible', 'internal') THEN 'unknown_visibility' END,
        CASE WHEN coalesce(status, '') NOT IN ('completed', 'partial', 'cancelled') THEN 'unknown_status' END]) AS violation FROM trace_events) WHERE violation IS NOT NULL""",
    "event_conflicts": f"SELECT tenant_id, trace_id, event_id, count(*) AS n_deliveries, count(DISTINCT ({_PAYLOAD})) AS n_payloads FROM trace_events GROUP BY ALL HAVING n_payloads > 1",
    "order_violations": f"""WITH {_NORM} SELECT c.tenant_id, c.trace_id, c.event_id, c.parent_id, c.sequence, p.sequence AS parent_sequence FROM n c
        JOIN n p ON p.tenant_id = c.tenant_id AND p.trace_id = c.trace_id AND p.event_id = c.parent_id WHERE p.sequence >= c.sequence""",
    "trace_group_changes": "SELECT tenant_id, trace_id, count(DISTINCT group_id) + max((group_id IS NULL)::INT) AS n_groups FROM trace_events GROUP BY ALL HAVING n_groups > 1",
    "traces_without_targets": f"WITH {_NORM} SELECT tenant_id, trace_id FROM n GROUP BY ALL HAVING NOT bool_or({_TARGET})",
    "ancestor_closure": _WALK + "SELECT tenant_id, trace_id, target, ancestor, distance, chain FROM b",
    "context_budget": _WALK + "SELECT tenant_id, trace_id, target, ancestor, distance, visible, kept, size FROM d",
    "causal_context": _WALK + "SELECT tenant_id, trace_id, event_id, context_status, omitted_ancestors, n_context, context_chars FROM g",
    "context_status_counts": _WALK + "SELECT context_status, count(*) AS n, sum(omitted_ancestors)::BIGINT AS omitted FROM g GROUP BY ALL",
    "causal_examples": _EXAMPLES + "SELECT input_id, tenant_id, trace_id, event_id AS target_event_id, context_status, group_id, split, n_context FROM y",
    "causal_split_counts": _EXAMPLES + "SELECT split, context_status, count(*) AS n FROM x GROUP BY ALL",
    "annotation_form": _WALK + "SELECT event_id AS target_event_id, 'agent-dissatisfaction-v1' AS metric_version, context_status, n_context, NULL::VARCHAR AS label, NULL::VARCHAR AS annotator FROM g",
}
