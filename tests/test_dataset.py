"""Imported messages, annotations, comparisons, and the command line end to end."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import checks, dataset

REV = "a" * 40


def canon(x):
    return hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_import_keeps_sessions_together_and_labels_apart(spark):
    rows = [(i, "src", f"s{i // 2}", f"text {i}", ("NEGATIVE", "NEUTRAL", "POSITIVE")[i % 3], "secret reason", 9) for i in range(12)] + [(99, None, "s", "t", "NEUTRAL", "", 1)]
    df = spark.createDataFrame(rows, "id long, source_dataset string, session_id string, content_text string, sentiment_label string, sentiment_reason string, nTurns int")
    ex, refs = dataset.imported(df, "d", REV)
    got = ex.collect()
    assert len(got) == 12 and refs.count() == 12 and "secret" not in str(got) and "NEGATIVE" not in str(got)
    assert all(len({r["split"] for r in got if r["group_id"] == g}) == 1 for g in {r["group_id"] for r in got}) and len({r["group_id"] for r in got}) == 6
    r = got[0]
    keys = ("tenant_id", "trace_id", "branch_id", "target_event_id", "metric_version", "input_version", "context_status", "context_scope", "history_available", "dataset_id", "dataset_revision")
    assert r["input_id"] == canon({k: r[k] for k in keys} | {"context": [c.asDict() for c in r["context"]]}) and r["group_id"] == canon(["src", "s0"])
    with pytest.raises(ValueError):
        dataset.imported(df, "d", "main")


def test_keys_contexts_and_limits(spark):
    m = spark.createDataFrame([("t", "s1", "m1", "same"), ("t", "s2", "m2", "same"), ("u", "s1", "m1", "same"), ("t", "s1", "m3", None)], "tenant_id string, session_id string, message_id string, text string")
    ex = dataset.message_input(m)
    k = {r["tenant_id"] + r["target_event_id"]: r["k"] for r in ex.select("tenant_id", "target_event_id", dataset.cache_key(ex).alias("k")).collect()}
    assert k["tm1"] == k["tm2"] != k["um1"] and len(k) == 3
    assert dataset.context_errors(ex).count() == 0
    assert {r["error"] for r in dataset.context_errors(ex.withColumn("target_event_id", F.lit("x"))).collect()} == {"not_ending_at_target"}
    assert {r["error"] for r in dataset.context_errors(ex.withColumn("context", F.concat("context", "context"))).collect()} == {"repeated_event"}
    t = ex.select(dataset.request_text(ex, F.lit(True)).alias("a"), dataset.request_text(ex, F.lit(False)).alias("b")).first()
    assert t["a"] == "same" and json.loads(t["b"])["events"][0]["text"] == "same"
    r = ex.filter("target_event_id = 'm2'").first()
    names = ("tenant_id", "trace_id", "branch_id", "target_event_id", "metric_version", "input_version", "context_status", "context_scope", "history_available")
    assert r["trace_id"] == canon(["t", "s2"]) and r["input_id"] == canon({n: r[n] for n in names} | {"context": [c.asDict() for c in r["context"]]})
    assert k["tm2"] == canon(["t", "message_only", "complete", False, "user", "same"])
    f = dataset.feedback_input(ex)
    g = f.filter("target_event_id = 'm2'").first()
    assert g["original_input_id"] == r["input_id"] and g["input_id"] == canon({n: g[n] for n in names} | {"context": [c.asDict() for c in g["context"]]})
    again = dataset.feedback_input(f).filter("target_event_id = 'm2'").first()
    assert (again["input_id"], again["original_input_id"]) == (g["input_id"], g["original_input_id"])
    assert [r[0] for r in m.select(dataset.over_input_limit("ab", F.col("text"), 5)).collect()] == [True, True, True, None]


def test_annotation_and_drift_checks(spark):
    ex = spark.createDataFrame([(i, "t", [("c",), ("t",)]) for i in "abcdefgh"], "input_id string, target_event_id string, context array<struct<event_id:string>>")
    ann = [("a", "yes", "human", "me", ["t"]), ("b", "yes", "human", "me", ["c"]), ("c", "no", "human", "me", ["zz"]), ("d", "no", "robot", "me", []), ("e", "no", "human", " ", None), ("f", "so", "human", "me", []), ("g", "no", "human", "me", []), ("g", "no", "human", "me", []), ("q", "no", "human", "me", [])]
    got = {r["input_id"]: r["error"] for r in checks.annotation_errors(ex, spark.createDataFrame(ann, "input_id string, label string, label_source string, annotator string, evidence_event_ids array<string>")).collect()}
    assert got == {"b": "yes_without_target", "c": "evidence_outside_context", "d": "wrong_source", "e": "no_annotator", "f": "wrong_label", "g": "repeated_annotation", "h": "missing_annotation", "q": "unknown_input"}
    a = spark.createDataFrame([("1", "x", 0.5), ("2", "y", None), ("3", "x", 0.1)], "k string, l string, s double")
    b = spark.createDataFrame([("1", "x", 0.7), ("2", "z", 0.2)], "k string, l string, s double")
    r = checks.prediction_drift(a, b, "k", "l", "s").first()
    assert (r["n_both"], r["n_only_one"], r["label_changes"], r["score_presence_changes"]) == (2, 1, 1, 1) and r["max_score_change"] == pytest.approx(0.2)
    t = spark.createDataFrame([("t", None, "train"), ("t", "g", "train"), ("t", None, "test"), ("u", "g", "test")], "tenant string, g string, split string")
    assert checks.leaking_groups(t.filter("split = 'train'"), t.filter("split = 'test'"), "tenant", "g").count() == 1


def test_command_line(spark, tmp_path, monkeypatch):
    from weftline import __main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    ev = lambda t, e, p, s, role, text: {"tenant_id": "a", "trace_id": t, "event_id": e, "parent_id": p, "branch_id": "m", "sequence": s, "role": role, "visibility": "user_visible", "text": text}
    rows = [ev("t1", "u", None, 0, "user", "why again?"), ev("t1", "v", "u", 1, "assistant", "sorry"), ev("t1", "w", "v", 2, "user", "ok"), ev("t2", "u", None, 0, "user", "thanks")]
    src = tmp_path / "Ereignisse ё.jsonl"
    src.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    out = tmp_path / "out"
    assert cli.main(["prepare", str(src), str(out)]) == 0
    ex = spark.read.parquet(f"{out}/examples.parquet")
    assert ex.count() == 3 and sum(json.loads((out / "manifest.json").read_text())["splits"].values()) == 3
    ids = {(r["trace_id"], r["target_event_id"]): r["input_id"] for r in ex.collect()}
    pred, lab = tmp_path / "p.jsonl", tmp_path / "l.jsonl"
    pred.write_text("\n".join(json.dumps({"input_id": i, "score": 0.9 if k == ("t1", "u") else 0.1, "runtime_status": "ok", "model_abstention": False, "model_version": "m"}) for k, i in ids.items()))
    lab.write_text("\n".join(json.dumps({"input_id": i, "label": "yes" if k == ("t1", "u") else "no"}) for k, i in ids.items()))
    args = [f"{out}/examples.parquet", str(pred)]
    assert cli.main(["route", *args, str(tmp_path / "r")]) == 0 and spark.read.parquet(str(tmp_path / "r/decisions.parquet")).filter("routed").count() == 2
    assert cli.main(["evaluate", *args, str(lab), str(tmp_path / "e.json")]) == 0
    r = json.loads((tmp_path / "e.json").read_text())
    assert r["filter_trace_recall"] == 1.0 and r["filter_trace_recall_lower_95_one_sided"] == 0.05
    assert cli.main(["prevalence", *args, str(lab), str(tmp_path / "h.json")]) == 0 and json.loads((tmp_path / "h.json").read_text())["ht_yes"] == 1.0
    assert cli.main(["sample", f"{out}/examples.parquet", str(tmp_path / "s")]) == 0
    src.write_text("\n".join(json.dumps(r) for r in [*rows, rows[0] | {"text": "changed"}]))
    assert cli.main(["prepare", str(src), str(tmp_path / "bad")]) == 2 and not (tmp_path / "bad").exists()
