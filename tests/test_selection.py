"""Selections, frozen tables, resumable runs, reports, SQL functions; candidates that caps would lose."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.__main__ import main
from weftline.functions import udfs
from weftline.operators import classification, context, hierarchy, journal, ranking, sampling, study, textsim
from weftline.schemas import EVENT
from weftline.sources import demo, files, frozen
from weftline.streaming import events as stream


def test_greedy_sample_keeps_every_pick(spark):
    rng = random.Random(5)
    hot = [(f"h{i}", "yes", "stock reply", f"s{i}") for i in range(3000)] + [(f"d{i}", "yes", f"text {i}", f"z{i}") for i in range(30)]
    hot += [(f"q{i}", "no", f"other {i}", "one session") for i in range(3000)] + [(f"e{i}", "no", f"more {i}", f"y{i}") for i in range(4)]
    mixed = [(f"k{i}", rng.choice(["yes", "no", None]), rng.choice(["a", "b", "c", "d", None]), f"s{rng.randrange(6)}") for i in range(80)]
    for rows, per_class in ((hot, 3), (mixed, 2), (mixed, 3), ([], 3)):
        df = spark.createDataFrame(rows, "id string, label string, text string, session string")
        order = {r["id"]: r["__h"] for r in sampling.ordering(df, "id", "tuning-v1").collect()}
        texts, sessions, want = set(), set(), []
        for label in ("no", "yes"):
            taken = 0
            for k, lab, t, s in sorted((r for r in rows if r[1] == label and r[2] is not None), key=lambda r: (order[r[0]], r[0])):
                if taken < per_class and t not in texts and s not in sessions:
                    texts.add(t), sessions.add(s), want.append((k, lab))
                    taken += 1
        got = sampling.greedy_exclusive(df.repartition(5), "id", "label", "text", "session", per_class)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_running_sums_and_steps(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, x int")
    got = {(r["g"], r["o"]): r["run_x"] for r in ranking.running_sums(df, ["g"], [F.desc("o")], ["x"]).collect()}
    assert got == {(g, o): sum(x for h, p, x in rows if h == g and p >= o) for g, o, _ in rows}
    assert ranking.running_sums(df.limit(0), [], [F.col("o")], ["x"]).count() == 0
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, float("nan")), (1, None)], "y int, s double")
    steps = classification.score_steps(s, F.col("y") == 1, "s").orderBy(F.desc("score")).collect()
    assert [(r["score"], r["tp"], r["fp"], r["positives"]) for r in steps] == [(0.9, 1, 1, 2), (0.5, 2, 1, 2), (0.1, 2, 2, 2)]


def test_context_of_deep_and_branching_traces(spark):
    rng = random.Random(2)
    rows = []
    for t in range(12):
        for i in range(40 if t else 150):
            parent = None if i == 0 else f"e{i - 1 if t < 2 else rng.randrange(i)}"
            rows.append(("a", f"t{t}", f"e{i}", parent if rng.random() > 0.01 else "gone", "main", i, rng.choice(["user", "assistant", "system"]), rng.choice(["user_visible"] * 4 + ["internal"]), "x" * rng.randrange(9), "completed", "en", None))
    rows += [("a", "loop", "p", "q", "main", 1, "user", "user_visible", "hi", "completed", "en", None), ("a", "loop", "q", "p", "main", 2, "user", "user_visible", "hi", "completed", "en", None)]
    by = {(r[1], r[2]): r for r in rows}
    want = {}
    for r in rows:
        if r[6] != "user" or r[7] != "user_visible" or r[1] == "loop":
            continue
        up, size, kept, omitted, full, chain = by.get((r[1], r[3])), len(r[8]), 1, 0, False, "complete" if r[3] != "gone" else "missing_parent"
        while up:
            if up[7] == "user_visible" and up[6] != "system":
                full = full or size + len(up[8]) > 40
                if full:
                    omitted += 1
                else:
                    size, kept = size + len(up[8]), kept + 1
            chain = "missing_parent" if up[3] == "gone" else chain
            up = by.get((up[1], up[3]))
        want[r[1], r[2]] = (chain if chain != "complete" else "truncated" if omitted else "complete", omitted, kept, size)
    got = context.context_rows(spark.createDataFrame(rows, EVENT), 40)
    assert {(r["trace_id"], r["event_id"]): (r["context_status"], r["omitted_ancestors"], r["n_context"], r["context_chars"]) for r in got.collect()} == want
    ex = {(r["trace_id"], r["target_event_id"]): r for r in context.examples(spark.createDataFrame(rows, EVENT), 40).collect()}
    assert set(ex) == set(want) and all(len(ex[k]["context"]) == w[2] and ex[k]["context"][-1]["event_id"] == k[1] for k, w in want.items())
    assert context.context_rows(spark.createDataFrame([], EVENT)).count() == 0


def test_deep_tree_beside_many_shallow_ones(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(64)] + [(f"s{i}", None if i % 2 else f"s{i + 1}") for i in range(2000)]
    t = {r["id"]: r for r in hierarchy.hierarchy(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()}
    assert t["n63"]["depth"] == 63 and len(t) == len(rows) and t["n63"]["path"][0] == "n0" and t["s0"]["root"] == "s1"


def test_prefix_join_finds_all_pairs(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))) for _ in range(150)] + ["", "abcd", "abcde", "abcdef", "aaaaaaaaaaaa", "aaaaaa", "x" * 3000]
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for t in (0.5, 0.8):
        want = {(i, k) for i, a in enumerate(texts) for k, b in enumerate(texts) if i < k and (g := textsim.grams(a)) and (h := textsim.grams(b)) and len(g & h) / len(g | h) >= t}
        got = [tuple(sorted((r["left_id"], r["right_id"]))) for r in textsim.similar_texts(df, df, t).collect()]
        assert set(got) == want and len(got) == len(want)


def test_frozen_tables_and_settings(spark, tmp_path):
    p = str(tmp_path / "study")
    df = spark.createDataFrame([("a", 1), ("b", None)], "input_id string, n int")
    m = frozen.freeze({"rows": (df, ["input_id"])}, p, {"policy_id": "x"})
    assert frozen.load_frozen(spark, p, "rows", {"policy_id": "x"}).count() == 2 and m["tables"]["rows"]["rows"] == 2
    with pytest.raises(ValueError, match="another study"):
        frozen.load_frozen(spark, p, "rows", {"policy_id": "y"})
    df.write.mode("append").parquet(f"{p}/rows")
    with pytest.raises(ValueError, match="was changed"):
        frozen.load_frozen(spark, p, "rows")
    files.write_json(spark, f"{p}/manifest.json", m | {"policy_id": "z"})
    with pytest.raises(ValueError, match="manifest was changed"):
        frozen.checked_manifest(spark, p)
    files.write_text(spark, f"{p}/note.txt", "é")
    files.write_text(spark, f"{p}/note.txt", "ü")
    assert files.read_text(spark, f"{p}/note.txt") == "ü"
    v = str(tmp_path / "vectors")
    frozen.write_vectors(spark.createDataFrame([("b", [1.0]), ("a", [2.0])], "input_id string, vector array<double>"), v, "enc")
    assert {r["input_id"]: r["vector"] for r in frozen.read_vectors(spark, v, df, "enc").collect()} == {"a": [2.0], "b": [1.0]}
    with pytest.raises(ValueError, match="no vector"):
        frozen.read_vectors(spark, v, spark.createDataFrame([("c",)], "input_id string"), "enc")
    for bad in ('{"a": 1, "a": 2}', "NaN", "{"):
        with pytest.raises(ValueError):
            frozen.parse_json(bad)
    s = frozen.run_settings({"model": "m", "task": "t", "prompt_name": "p", "key_variable": "K"}, {"K": "hidden"}, {"p": "Say yes."})
    assert s["secret"] == "hidden" and s["version"] == frozen.run_settings({"model": "m", "task": "t", "prompt": "Say yes."}, {}, {})["version"]
    for bad in ({"model": "m", "task": "t"}, {"model": "m", "task": "t", "prompt": "x", "prompt_name": "p"}, {"model": "m", "task": "t", "prompt": "x", "repeats": 0}, {"model": "m", "task": "t", "prompt": "x", "port": 1}):
        with pytest.raises(ValueError):
            frozen.run_settings(bad, {}, {"p": "x"})


def test_resumable_run(spark, tmp_path):
    path, told = str(tmp_path / "journal"), []
    plan = journal.planned(spark.createDataFrame([(f"i{k}",) for k in range(6)], "input_id string"), 2, "v")
    down = lambda row: {"status": "error", "http_status": 401, "error_type": "denied"}
    assert journal.run_resumable(plan, path, down) == {"error": 1, "unattempted": 11}  # the first call goes alone
    last = max(r["call_id"] for r in plan.collect())
    some = lambda row: {"status": "error", "http_status": 400} if row["call_id"] == last else {"status": "ok", "label": "yes"}
    assert journal.run_resumable(plan, path, some, batch=4, progress=lambda a, b: told.append((a, b))) == {"ok": 11, "error": 1} and told[-1] == (12, 12) and told[1] == (5, 12)
    third = sorted(r["call_id"] for r in plan.collect())[2]
    outage = lambda row: {"status": "ok", "label": "yes"} if row["call_id"] < third else {"status": "error"}
    assert journal.run_resumable(plan, str(tmp_path / "other"), outage, batch=4, max_failures=1) == {"ok": 2, "error": 3, "unattempted": 7}
    good = lambda row: {"status": "ok", "label": "yes"}
    assert journal.run_resumable(plan, path, good) == {"ok": 12} and journal.run_resumable(plan, path, down) == {"ok": 12}
    scores = spark.createDataFrame([(f"i{k}", k / 10) for k in range(10)] + [(None, 1.0), ("i3", 0.3)], "input_id string, score double")
    at = str(tmp_path / "scores")
    assert journal.append_scores(scores.filter("score < 0.5"), at, parts=2) == 5 and journal.append_scores(scores, at, parts=3) == 5 and spark.read.parquet(at).count() == 10


def test_selection_rules(spark):
    c = spark.createDataFrame([("b", 0.5, 0.7, 10, 1.0, 0), ("a", 0.5, 0.7, 10, 1.0, 0), ("n", float("nan"), 0.9, 1, 1.0, 0), ("z", None, 0.9, 1, 1.0, 1)], "name string, macro_f1 double, agreement double, bytes int, c double, balanced int")
    assert study.best(c, study.STUDENT).first()["name"] == "a" and study.best(c.limit(0), study.STUDENT).count() == 0
    assert {r["g"]: r["name"] for r in study.best_in_group(c.withColumn("g", F.col("balanced")), "g", study.GRID).collect()} == {0: "a", 1: "z"}
    o = spark.createDataFrame([("x", False, True)] * 30 + [("x", True, True)] * 50 + [("y", True, False)] * 20 + [(None, True, True), ("y", None, True)], "s string, old boolean, new boolean")
    r = study.stratified_gain(o, "s").first()
    assert r["gain"] == 0.1 and r["low"] <= 0.1 <= r["high"] and r["low"] > 0 and study.stratified_gain(o.limit(0), "s").first()["gain"] is None
    t = spark.createDataFrame([("a", [2.0, 0.0, 0.0], 0), ("a", [2.0, 0.0, 0.0], 1), ("b", [3.0, 0.0, 0.0], 0), ("b", [1.0, 0.0, 0.0], None)], "task string, logits array<double>, label int")
    got = study.task_temperatures(t)
    assert got["a"] > 2 and got["b"] < 0.5 and study.task_temperatures(t.limit(0)) == {}
    text = frozen.markdown("T", {"A": c.select("name", "macro_f1").orderBy("name"), "B": "plain"}, 2)
    assert "| a | 0.5000 |" in text and "2 more rows." in text and text.endswith("plain\n")


def test_conflicts_go_to_a_side_output(spark, tmp_path):
    row = lambda e, text, day: ("a", "t", e, None, "main", 0, "user", "user_visible", text, "completed", "en", None, f"2030-01-0{day}")
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT.fields) + ", received_ts string"
    src, p = str(tmp_path / "in"), lambda x: str(tmp_path / x)
    for i, rows in enumerate([[row("u", "x", 1), row("v", "x", 1), row("v", "x", 2)], [row("u", "other", 3)]]):
        spark.createDataFrame(rows, cols).withColumn("received_ts", F.to_timestamp("received_ts")).coalesce(1).write.mode("append").parquet(src)
        q = stream.split_conflicts(stream.read_events(spark, src, spark.read.parquet(src).schema), p("store"), p("out"), p("bad"), p("check"))
        q.awaitTermination()
        assert stream.progress(q)[-1]["rows"] >= len(rows) and i < 2
    assert {(r["event_id"], r["n_payloads"]) for r in spark.read.parquet(p("bad")).collect()} == {("u", 2)}
    assert {r["event_id"] for r in spark.read.parquet(p("out")).filter("batch = 0").collect()} == {"u", "v"}


def test_sql_functions_and_demo(spark, tmp_path):
    assert udfs.register(spark) == ["fold_text", "recall_lower_bound", "split_text"]
    r = spark.sql("SELECT fold_text(' ＡB  c ') AS a, recall_lower_bound(59, 59) AS b, recall_lower_bound(NULL, 1) AS c").first()
    assert r["a"] == "ab c" and abs(r["b"] - 0.05 ** (1 / 59)) < 1e-12 and r["c"] is None
    assert "".join(x["piece"] for x in spark.sql("SELECT * FROM split_text('one two three', 5)").collect()) == "one two three"
    assert demo.events(spark).count() == 8
    out = str(tmp_path / "demo")
    assert main(["demo", out]) == 0
    text = files.read_text(spark, f"{out}/report.md")
    assert "## Prevalence" in text and frozen.load_frozen(spark, out, "examples").count() == 6


def test_command_line_of_a_labelling_run(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    rows = [(i, "src", f"s{i // 2}", f"text {i}", "NEUTRAL") for i in range(6)]
    spark.createDataFrame(rows, "id long, source_dataset string, session_id string, content_text string, sentiment_label string").write.parquet(p("rows"))
    assert main(["import", p("rows"), p("data"), "--dataset", "d", "--revision", "0" * 40]) == 0 and main(["import", p("rows"), p("data2"), "--dataset", "d", "--revision", "short"]) == 2
    assert main(["judge-plan", p("data") + "/examples", p("plan"), "--version", "v1"]) == 0
    plan = spark.read.parquet(p("plan")).collect()
    (tmp_path / "answers.jsonl").write_text("\n".join(json.dumps({"call_id": r["call_id"], "label": "yes"}) for r in plan if r["input_id"] != plan[0]["input_id"]))
    (tmp_path / "refs.jsonl").write_text("\n".join(json.dumps({"input_id": i, "reference": "yes"}) for i in {r["input_id"] for r in plan}))
    for _ in range(3):
        assert main(["judge", p("plan"), p("answers.jsonl"), p("journal")]) == 0
    assert main(["judge-report", p("journal"), p("refs.jsonl"), p("report.md")]) == 0
    assert "## Agreement" in files.read_text(spark, p("report.md"))
    rng = random.Random(0)
    vec = [(f"i{i}", [float(i % 3 == k) + rng.random() / 9 for k in range(3)]) for i in range(60)]
    spark.createDataFrame(vec, "input_id string, vector array<double>").write.parquet(p("vec"))
    (tmp_path / "labels.jsonl").write_text("\n".join(json.dumps({"input_id": f"i{i}", "label": i % 3, "split": "train" if i < 45 else "calibration"}) for i in range(60)))
    assert main(["train", p("vec"), p("labels.jsonl"), p("head.json")]) == 0 and main(["predict", p("head.json"), p("vec"), p("out")]) == 0
    got = {r["input_id"]: r["probabilities"] for r in spark.read.parquet(p("out")).collect()}
    assert all(max(range(3), key=lambda k: got[f"i{i}"][k]) == i % 3 for i in range(60))


def test_windows_of_a_tokenizer_and_draws(spark):
    from weftline.operators import features, simulation

    df = spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, None), (4, "ab")], "k int, text string")
    got = {}
    for r in features.tokenized_windows(df, "k", "text", list, 4, 2, prefix="#").orderBy("k", "window_no").collect():
        got.setdefault(r["k"], []).append(("".join(r["tokens"]), r["weight"]))
    assert got == {1: [("#abc", 3), ("#cde", 2), ("#efg", 2), ("#gh", 1)], 2: [("#", 0)], 4: [("#ab", 2)]}
    import numpy as np

    u = simulation._uniforms(np.arange(400, dtype=np.uint64), 42, 500)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.2 and abs(u.std() - 12**-0.5) < 0.01 and len(np.unique(u)) == u.size
    w = simulation._weights(np.arange(400, dtype=np.uint64), 42, 500)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    df, path = session.materialize(spark.range(3))
    assert df.count() == 3 and session.release(spark) >= 1 and session.release(spark) == 0
