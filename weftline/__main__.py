"""python -m weftline COMMAND: a thin command line over the operators; files in, files out."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from weftline.operators import checks, context, dataset, events, features, journal, judging, routing, study
from weftline.plans import registry
from weftline.schemas import EVENT, PREDICTION
from weftline.session import local_session, materialize
from weftline.sources import demo, files, frozen


def _events(spark, path: str):
    """Checked events of a JSON-lines file: domain errors, conflicting deliveries, changing groups and non-causal order are errors."""
    raw = files.read_jsonl(spark, path, EVENT).fillna({"status": "completed", "language": "unknown"})
    checks.assert_empty(events.violations(raw), "invalid events")
    checks.assert_empty(events.conflicts(raw), "conflicting deliveries")
    checks.assert_empty(events.group_changes(raw), "group_id changes inside a trace")
    e = events.normalize(raw, None).drop("conflicting")
    checks.assert_empty(events.order_violations(e), "a parent doesn't come before its child")
    return e


def _policy(a: argparse.Namespace) -> routing.Policy:
    return routing.Policy(a.mode, a.threshold, a.audit_rate, a.seed)


def _demo(spark, output: str) -> None:
    """Events to examples, decisions, quality and prevalence, with a report."""
    ex, _ = materialize(context.examples(events.normalize(demo.events(spark), None).drop("conflicting")), "demo")
    policy = routing.Policy()
    m = routing.members(ex, demo.predictions(ex), policy)
    d = routing.decide(m, policy)
    labels = demo.labels(ex)
    quality, shares = routing.evaluate(m, d, labels), routing.prevalence(m, d, labels)
    frozen.freeze({"examples": (ex, ["input_id"]), "decisions": (d, ["tenant_id", "trace_id"])}, output, {"policy_id": policy.policy_id})
    files.write_text(spark, f"{output}/report.md", frozen.markdown("Demo", {"Decisions": d.select("trace_id", "n_inputs", "filter_selected", "audit_selected", "routed"), "Quality": quality, "Prevalence": shares}))


def _report(spark, calls, references, output: str) -> None:
    last = journal.latest(calls)
    sections = {
        "Calls": journal.status_counts(calls), "Usage": journal.usage(journal.attempts(calls)), "Agreement": judging.coverage_agreement(last, references),
        "Repeats": judging.repeat_agreement(last), "Disagreements": judging.disagreements(last, references),
    }
    files.write_text(spark, output, frozen.markdown("Labelling run", sections))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("prepare", help="events to causal examples, annotation form and manifest")
    q.add_argument("events")
    q.add_argument("output")
    q.add_argument("--max-chars", type=int, default=12000)
    q.add_argument("--seed", type=int, default=42)
    for name in ("route", "sample", "evaluate", "prevalence"):
        q = sub.add_parser(name)
        q.add_argument("examples", help="examples.parquet of prepare")
        if name != "sample":
            q.add_argument("predictions", help="JSON lines")
        if name in ("evaluate", "prevalence"):
            q.add_argument("labels", help="JSON lines of input_id and label")
        q.add_argument("output")
        q.add_argument("--mode", default="cascade" if name == "sample" else "shadow")
        q.add_argument("--threshold", type=float, default=0.5)
        q.add_argument("--audit-rate", type=float, default=0.1)
        q.add_argument("--seed", type=int, default=42)
    q = sub.add_parser("demo", help="a made-up study from events to its report")
    q.add_argument("output")
    q = sub.add_parser("import", help="rows of a published dataset to examples and references")
    q.add_argument("rows", help="Parquet")
    q.add_argument("output")
    q.add_argument("--dataset", required=True)
    q.add_argument("--revision", required=True)
    q = sub.add_parser("judge-plan", help="the calls of a labelling run")
    q.add_argument("examples")
    q.add_argument("output")
    q.add_argument("--repeats", type=int, default=2)
    q.add_argument("--version", required=True)
    q = sub.add_parser("judge", help="run planned calls against recorded answers, resuming the journal")
    q.add_argument("plan", help="Parquet of judge-plan")
    q.add_argument("answers", help="JSON lines of call_id and label")
    q.add_argument("journal")
    q = sub.add_parser("judge-report", help="a report of a journal in Markdown")
    q.add_argument("journal")
    q.add_argument("references", help="JSON lines of input_id and reference")
    q.add_argument("output")
    q = sub.add_parser("train", help="a head on vectors: the best of a small grid")
    q.add_argument("vectors", help="Parquet of input_id and vector")
    q.add_argument("labels", help="JSON lines of input_id, label and split")
    q.add_argument("output")
    q = sub.add_parser("predict", help="probabilities of a trained head")
    q.add_argument("head")
    q.add_argument("vectors")
    q.add_argument("output")
    q = sub.add_parser("query", help="a registered query over a folder of tables")
    q.add_argument("name", choices=sorted(registry.queries()))
    q.add_argument("tables")
    q.add_argument("output")
    a = p.parse_args(argv)
    spark = local_session()
    try:
        if a.command == "query":
            registry.queries()[a.name](spark, a.tables).write.parquet(a.output)
        elif a.command == "demo":
            _demo(spark, a.output)
        elif a.command == "import":
            ex, refs = dataset.imported(spark.read.parquet(a.rows), a.dataset, a.revision)
            checks.assert_empty(checks.duplicate_keys(ex, "target_event_id"), "repeated row ids")
            frozen.freeze({"examples": (ex, ["input_id"]), "references": (refs, ["input_id"])}, a.output, {"dataset": a.dataset, "revision": a.revision})
        elif a.command == "judge-plan":
            journal.planned(spark.read.parquet(a.examples), a.repeats, a.version).write.parquet(a.output)
        elif a.command == "judge":
            answers = {r["call_id"]: r["label"] for r in files.read_jsonl(spark, a.answers, "call_id string, label string").collect()}  # recorded by hand: a few

            def replay(call: dict) -> dict:
                label = answers.get(call["call_id"])
                return {"status": "ok", "label": label} if label else {"status": "error", "error_type": "no_answer"}

            print(json.dumps(journal.run_resumable(spark.read.parquet(a.plan), a.journal, replay)))
        elif a.command == "judge-report":
            _report(spark, journal.read_journal(spark, a.journal), files.read_jsonl(spark, a.references, "input_id string, reference string"), a.output)
        elif a.command == "train":
            x = spark.read.parquet(a.vectors).join(files.read_jsonl(spark, a.labels, "input_id string, label int, split string"), "input_id")
            table, heads = study.grid_search(x.filter("split = 'train'"), x.filter("split = 'calibration'"), "vector", "label")
            won = study.best(table, study.GRID).first().asDict()
            head = heads[won["name"]]
            made = {"selection": won, "coef": head.coef, "intercept": head.intercept, "classes": list(head.classes)}
            files.write_json(spark, a.output, made | {"model_version": frozen.fingerprint(made)})
        elif a.command == "predict":
            m = frozen.read_json(spark, a.head)
            if m["model_version"] != frozen.fingerprint(m, without=("model_version",)):
                raise ValueError("the head was changed")
            h = features.Head(m["coef"], m["intercept"], tuple(m["classes"]))
            spark.read.parquet(a.vectors).select("input_id", h.probabilities(F.col("vector")).alias("probabilities"), F.lit(m["model_version"]).alias("model_version")).write.parquet(a.output)
        elif a.command == "prepare":
            ex = context.examples(_events(spark, a.events), a.max_chars, a.seed)
            ex.write.parquet(f"{a.output}/examples.parquet")
            ex = spark.read.parquet(f"{a.output}/examples.parquet")
            files.write_jsonl(context.annotation_form(ex), f"{a.output}/annotations")
            files.write_splits(ex, f"{a.output}/splits", f"{a.output}/manifest.json")
        else:
            ex, policy = spark.read.parquet(a.examples), _policy(a)
            if a.command == "sample":  # every score 0: only safety and audit select
                pred = ex.select("input_id", F.lit(0.0).alias("score"), F.lit("ok").alias("runtime_status"), F.lit(False).alias("model_abstention"), F.lit("control").alias("model_version"), F.lit(None).cast("string").alias("context_status"))
            else:
                pred = files.read_jsonl(spark, a.predictions, PREDICTION)
            checks.assert_empty(checks.duplicate_keys(pred, "input_id"), "repeated predictions")
            checks.assert_empty(checks.stale(pred, ex, "input_id"), "predictions of unknown inputs")
            checks.assert_empty(checks.bad_probabilities(pred, "score"), "scores outside [0, 1]")
            m = routing.members(ex, pred, policy)
            d = routing.decide(m, policy)
            if a.command in ("route", "sample"):
                d.write.parquet(f"{a.output}/decisions.parquet")
                m.write.parquet(f"{a.output}/members.parquet")
            else:
                labels = files.read_jsonl(spark, a.labels, "input_id string, label string")
                checks.assert_empty(checks.duplicate_keys(labels, "input_id"), "repeated labels")
                if a.command == "evaluate":
                    checks.assert_empty(checks.coverage_gaps(ex, labels, "input_id"), "labels must cover exactly the examples")
                    r = routing.evaluate(m, d, labels).first().asDict()
                    several = routing.clustered(ex).first()[0]
                    r["multiple_traces_per_group"] = several
                    r["filter_trace_recall_lower_95_one_sided"] = None if several else routing.recall_lower_bound(r["filter_hits"], r["positive_traces"])
                else:
                    r = routing.prevalence(m, d, labels).first().asDict()
                files.write_json(spark, a.output, r)
    except ValueError as x:
        print(json.dumps({"error": str(x)}, ensure_ascii=False), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
