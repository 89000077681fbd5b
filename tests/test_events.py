"""Deliveries, causal contexts, routing and prevalence with literal expectations."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions.canon import digest, json_array, split_for, uniform
from weftline.operators import checks, context, events, routing
from weftline.schemas import EVENT


def ev(i, parent=None, seq=None, role="user", text=None, trace="t1", tenant="a", **kw):
    return {"tenant_id": tenant, "trace_id": trace, "event_id": str(i), "parent_id": parent, "branch_id": "main", "sequence": i if seq is None else seq, "role": role, "visibility": "user_visible",
            "text": f"text {i}" if text is None else text, "status": "completed", "language": "en", "group_id": None} | kw


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT) for r in rows], EVENT)


CHAIN = [ev(0), ev(1, "0", role="assistant"), ev(2, "1", role="tool", visibility="internal"), ev(3, "2"), ev(4, "3", role="assistant"), ev(9, "1", role="assistant")]


def context_of(spark, rows, target, **kw):
    x = context.examples(events.normalize(frame(spark, rows), None), **kw).filter(F.col("target_event_id") == target).first()
    return [c["event_id"] for c in x["context"]], x["context_status"], x["input_id"], x["omitted_ancestors"]


def test_context_skips_hidden_and_ignores_order_siblings_and_redelivery(spark):
    a = context_of(spark, CHAIN, "3")
    assert a[:2] == (["0", "1", "3"], "complete")
    assert context_of(spark, CHAIN[::-1] + CHAIN[:2], "3") == a


def test_missing_parent_changes_identity_and_outranks_truncation(spark):
    alone = context_of(spark, [CHAIN[3]], "3")
    assert alone[:2] == (["3"], "missing_parent") and alone[2] != context_of(spark, CHAIN, "3")[2]
    other = context_of(spark, [CHAIN[3], ev(2, None, tenant="b")], "3")
    assert other[1] == "missing_parent"


def test_budget_is_a_contiguous_suffix_and_keeps_the_target(spark):
    ids, status, _, omitted = context_of(spark, CHAIN, "3", max_chars=1)
    assert (ids, status, omitted) == (["3"], "truncated", 2)
    rows = [ev(0, text="ab"), ev(1, "0", role="assistant", text="x" * 50), ev(2, "1", text="yy")]
    assert context_of(spark, rows, "2", max_chars=10)[0] == ["2"]  # the short root doesn't jump over the long reply


def test_identity_is_the_digest_of_canonical_json(spark):
    x = context.examples(events.normalize(frame(spark, CHAIN), None)).filter("target_event_id = '3'").first()
    identity = {k: x[k] for k in ("tenant_id", "trace_id", "branch_id", "target_event_id", "metric_version", "input_version", "context_status", "omitted_ancestors", "max_chars")}
    identity["context"] = [c.asDict() for c in x["context"]]
    assert x["input_id"] == hashlib.sha256(json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_conflicts_groups_order_and_domains(spark):
    rows = [*CHAIN, CHAIN[0], ev(1, "0", role="assistant", text="other"), ev(5, "4", seq=4), ev(6, None, role="bot", group_id="g"), ev(7, None, seq=-1, language="")]
    df = frame(spark, rows)
    assert [r["event_id"] for r in events.conflicts(df).collect()] == ["1"]
    with pytest.raises(ValueError, match="conflict"):
        checks.assert_empty(events.conflicts(df), "conflicting deliveries")
    checks.assert_empty(events.conflicts(frame(spark, CHAIN + CHAIN)), "conflicting deliveries")
    assert events.normalize(df, None).filter("conflicting").count() == 1
    assert [r["n_groups"] for r in events.group_changes(df).collect()] == [2]  # null counts as a value
    assert [r["event_id"] for r in events.order_violations(events.normalize(df, None)).collect()] == ["5"]
    assert {(r["event_id"], r["violation"]) for r in events.violations(df).collect()} == {("6", "unknown_role"), ("7", "negative_sequence"), ("7", "empty_language")}
    assert events.traces_without_targets(frame(spark, [ev(0, role="assistant"), ev(1, trace="t2")])).count() == 1
    assert context.context_rows(frame(spark, [])).count() == 0


def test_draws_match_the_formula(spark):
    keys = [("t", "a"), ("тенант", 'q"u\\o'), ("x\n\t", "😀")]
    df = spark.createDataFrame(keys, "a string, b string").select("a", "b", uniform(42, "split-v1", json_array("a", "b")).alias("u"), split_for("a", "b").alias("s"))
    for r in df.collect():
        h = hashlib.sha256(json.dumps([42, "split-v1", [r["a"], r["b"]]], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        u = (int(h[:16], 16) >> 11) / 2**53
        assert r["u"] == u and r["s"] == ("train" if u < 0.7 else "calibration" if u < 0.85 else "test")
    assert abs(spark.range(10_000).select(uniform(1, "n", json_array(F.col("id").cast("string"))).alias("u")).agg(F.avg("u")).first()[0] - 0.5) < 0.02
    assert len(spark.range(1).select(digest({"b": F.lit(None).cast("string"), "a": F.lit(1)}).alias("d")).first()["d"]) == 64


def _study(spark):
    """Four traces; labels yes, no, no / no, unclear / no / no."""
    ids = [("a", "t1", "i1"), ("a", "t1", "i2"), ("a", "t2", "i3"), ("a", "t2", "i4"), ("a", "t3", "i5"), ("a", "t4", "i6")]
    ex = spark.createDataFrame([(*k, "complete", "en", k[1]) for k in ids], "tenant_id string, trace_id string, input_id string, context_status string, language string, group_id string")
    label = dict(zip(("i1", "i2", "i3", "i4", "i5", "i6"), ("yes", "no", "no", "unclear", "no", "no")))
    pred = spark.createDataFrame([(i, {"yes": 0.9, "no": 0.1}.get(x), "ok", False, "m", None) for i, x in label.items()], "input_id string, score double, runtime_status string, model_abstention boolean, model_version string, context_status string")
    return ex, pred, spark.createDataFrame(list(label.items()), "input_id string, label string")


def test_shadow_routing_and_evaluation(spark):
    ex, pred, lab = _study(spark)
    p = routing.Policy()
    m = routing.members(ex, pred, p)
    d = routing.decide(m, p)
    r = routing.evaluate(m, d, lab).first()
    assert (r["traces"], r["actual_routed_traces"], r["filter_selected_traces"], r["filter_trace_recall"]) == (4, 4, 2, 1.0)
    assert (r["positive_traces"], r["unclear_traces"], r["negative_traces"], r["unscored_or_failed_messages"]) == (1, 1, 2, 1)
    h = routing.prevalence(m, d, lab).first()
    assert (h["ht_yes"], h["ht_no"], h["ht_unclear"], h["yes_among_clear"]) == (1.0, 4.0, 1.0, 0.2)
    assert routing.inconsistent(d, p).count() == 0 and routing.inconsistent(d.withColumn("routed", F.lit(False)), p).count() == 4
    assert not routing.clustered(ex).first()[0]


def test_cascade_weights_audited_traces(spark):
    ex, pred, lab = _study(spark)
    low = pred.withColumn("score", F.lit(0.0))
    hit = None
    for seed in range(200):
        p = routing.Policy(mode="cascade", audit_rate=0.2, seed=seed)
        d = routing.route(ex, low, p)
        if d.filter("trace_id = 't1' AND audit_selected").count():
            hit = routing.prevalence(routing.members(ex, low, p), d, lab).first()["ht_yes"]
            break
    assert hit == 5.0


def test_missing_and_bad_predictions_are_selected_for_safety(spark):
    ex, pred, _ = _study(spark)
    odd = pred.filter("input_id NOT IN ('i5')").withColumn("score", F.when(F.col("input_id") == "i6", float("nan")).otherwise(F.col("score")))
    m = {r["input_id"]: r for r in routing.members(ex, odd, routing.Policy()).collect()}
    assert m["i5"]["safety_selected"] and m["i6"]["safety_selected"] and not m["i2"]["safety_selected"] and not m["i6"]["model_selected"]
    assert checks.bad_probabilities(odd, "score").count() == 1
    assert checks.stale(pred, ex.filter("input_id <> 'i1'"), "input_id").count() == 1
    with pytest.raises(ValueError):
        routing.Policy(audit_rate=0)


@pytest.mark.parametrize(("hits", "n", "want"), [(0, 0, None), (0, 10, 0.0), (59, 59, 0.05 ** (1 / 59)), (1, 2, 1 - 0.95**0.5), (2, 3, 0.13535036217158378)])
def test_recall_bound(hits, n, want):
    got = routing.recall_lower_bound(hits, n)
    assert got == want if want is None else got == pytest.approx(want, abs=1e-9)
