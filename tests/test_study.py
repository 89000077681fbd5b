"""Journal, answers, metrics, thresholds, simulation, features and census with literal expectations."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import census, features, judging, simulation
from weftline.operators import classification as cl
from weftline.operators import journal as jr
from weftline.schemas import CALL


def test_journal_resumes(spark):
    inputs = spark.createDataFrame([(f"i{k}",) for k in range(6)] + [("i0",), (None,)], "input_id string")
    plan = jr.planned(inputs, 2, "v1")
    assert plan.count() == 12 and plan.select("call_id").distinct().count() == 12
    assert plan.filter("input_id = 'i3' AND repeat = 1").first()["call_id"] == hashlib.sha256(b'["i3","v1",1]').hexdigest()

    def flaky(row):
        if row["input_id"] == "i5":
            return {"status": "error", "http_status": 503, "elapsed_seconds": 1.0}
        if row["input_id"] == "i4" and row["repeat"] == 1:
            raise RuntimeError("down")
        return {"status": "ok", "http_status": 200, "elapsed_seconds": 10.0, "usage": {"prompt_tokens": 100, "completion_tokens": 20, "total_tokens": 120}, "label": "no" if row["repeat"] else "yes"}

    j1 = spark.createDataFrame(jr.run_calls(plan, flaky, 1).collect(), CALL)
    assert {r["runtime_status"]: r["n"] for r in jr.status_counts(j1).collect()} == {"ok": 9, "error": 3}
    todo = jr.pending(plan, j1)
    assert todo.count() == 3 and jr.pending(plan, j1.limit(0)).count() == 12
    j2 = j1.union(spark.createDataFrame(jr.run_calls(todo, lambda r: {"status": "ok", "elapsed_seconds": 2.0, "label": "yes"}, 2).collect(), CALL))
    assert jr.pending(plan, j2).count() == 0 and jr.history(j2).count() == 3 and jr.latest(j2).filter("n_previous = 1").count() == 3
    a = jr.attempts(j1)
    assert a.count() == 9 + 1 + 2 * 3  # retried three times on 503, once on the exception
    assert jr.usage(a.filter("runtime_status = 'ok'")).first()["total_tokens"] == 1080
    assert jr.insert_if_absent(j1, j2).count() == 0 and jr.guarded_merge(j1, j2.filter("attempt_no = 2")).count() == 3
    assert jr.remaining(plan, j1.limit(0)).first()["estimate_seconds"] == 2400.0


def test_remaining_time(spark):
    plan = spark.createDataFrame([(f"c{k}",) for k in range(5)], "call_id string")
    one = lambda k, s: (k, "i", 0, "v", None, 1, s, None, [(s, 10.0, None, None, None, None, None)], None)
    j = spark.createDataFrame([one("c0", "ok"), one("c1", "not_evaluated"), one("c2", "error")], CALL)
    r = jr.remaining(plan, j).first()
    assert (r["n_remaining"], r["estimate_seconds"]) == (3, 2440.5)


def test_answers(spark):
    cases = {
        '{"label":"yes","reason":"said so"}': None, '```json\n{"label":"no","reason":"x"}\n```': None, "```\n[1]\n```": "not_json", "yes": "not_json", '{"label":"yes"}': "wrong_keys",
        '{"label":"yes","reason":"r","x":1}': "wrong_keys", '{"label":"maybe","reason":"r"}': "wrong_label", '{"label":"no","reason":"   "}': "wrong_text", json.dumps({"label": "no", "reason": "r" * 601}): "wrong_text",
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r["c"]: r["e"] for r in df.select("c", judging.answer_error(F.col("c"), {"label": ("yes", "no", "unclear"), "reason": None}).alias("e")).collect()}
    assert got == cases
    sig = "struct<label:string,reason:string,evidence:array<string>>"
    rows = [(("yes", None, ["is bad"]), None), (("yes", None, []), "yes_without_evidence"), (("no", None, None), None), (("yes", None, ["was bad"]), "evidence_not_in_text"), (None, "missing"), ((None, None, []), "missing"),
            (("bad", None, []), "wrong_label"), (("yes", None, ["a", "b", "c"]), "too_much_evidence"), (("yes", None, [""]), "empty_or_long_evidence")]
    df = spark.createDataFrame([(i, "this is bad", r[0]) for i, r in enumerate(rows)], f"i int, t string, s {sig}")
    assert [r["e"] for r in df.select("i", judging.feedback_error(F.col("t"), F.col("s")).alias("e")).orderBy("i").collect()] == [r[1] for r in rows]
    tags = spark.createDataFrame([(["a"], True), (["a", "a"], True), (["q"], True), (["a"], False), ([], False), (None, False)], "t array<string>, y boolean")
    assert [r[0] for r in tags.select(judging.tags_error(F.col("t"), ("a", "b"), F.col("y"))).collect()] == [None, "repeated_tag", "unknown_tag", "tag_without_yes", None, None]


def test_consensus(spark):
    calls = spark.createDataFrame([("a", 0, "ok", "yes"), ("a", 1, "ok", "yes"), ("b", 0, "ok", "yes"), ("b", 1, "ok", "no"), ("c", 0, "ok", "no"), ("c", 1, "error", None)], "input_id string, repeat int, runtime_status string, label string")
    inputs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "input_id string")
    assert {r["input_id"]: (r["outcome"], r["label"]) for r in judging.consensus(inputs, calls, 2).collect()} == {"a": ("agreed", "yes"), "b": ("unresolved", None), "c": ("incomplete", None), "d": ("incomplete", None)}
    assert judging.repeat_agreement(calls).first()["fraction"] == 0.5
    ref = spark.createDataFrame([("a", "yes"), ("b", "no"), ("c", "no"), ("d", "no")], "input_id string, reference string")
    r = judging.coverage_agreement(calls, ref).first()
    assert (r["agreement_on_ok"], r["agreement_with_failures"]) == (2 / 3, 0.5) and judging.disagreements(calls, ref).count() == 1


def test_two_macro_f1_conventions_and_nulls(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (None, 1)], "y int, p int")
    c = cl.confusion(df, "y", "p", (0, 1, 2))
    assert c.count() == 9 and c.agg(F.sum("n")).first()[0] == 3
    per = {r["class"]: r["f1"] for r in cl.per_class(c).collect()}
    assert per[2] is None and per[0] == pytest.approx(2 / 3)
    assert cl.agreement(c, False).first()["macro_f1"] == pytest.approx(2 / 3) and cl.agreement(c, True).first()["macro_f1"] == pytest.approx(4 / 9)
    assert cl.agreement(cl.confusion(df.limit(0), "y", "p", (0, 1, 2)), True).first()["agreement"] is None


def test_thresholds(spark):
    s = cl.score_steps(spark.createDataFrame([(0, 0.8), (0, 0.8), (0, 0.2), (1, 0.1)], "y int, s double"), F.col("y") == 0, "s")
    assert [(r["threshold"]) for r in cl.recall_thresholds(s, (2 / 3, 1.0)).orderBy("target").collect()] == [0.8, 0.2]
    t = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (2, 0.1), (-1, 0.95)], "y int, s double").filter("y >= 0")
    r = cl.precise_threshold(cl.score_steps(t, F.col("y") == 1, "s"), 1.0).first()
    assert (r["threshold"], r["precision"], r["n_selected"]) == (0.5, pytest.approx(2 / 3), 3)
    ap = cl.average_precision(cl.score_steps(t, F.col("y") == 1, "s")).first()["average_precision"]
    assert ap == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert cl.precise_threshold(cl.score_steps(t.filter("y <> 1"), F.col("y") == 1, "s"), 0.9).count() == 0
    b = cl.binary_metrics(t.limit(0), F.col("y") == 1, F.col("s"), 0.5).first()
    assert (b["tp"], b["precision"]) == (0, 0.0)


def test_simulation_is_unbiased(spark):
    rows = [(f"s{i}", 2, 2, 1 if i < 5 else 0, i < 3) for i in range(20)]
    s = spark.createDataFrame(rows, "key string, n long, known long, neg long, selected boolean")
    exact = {r["design"]: r for r in simulation.design_exact(s, 0.25).collect()}
    assert exact["teacher_census"]["standard_error"] == 0 and exact["cascade_with_audit"]["expected_calls"] == 2 * (3 + 17 * 0.25)
    sim = {r["design"]: r for r in simulation.design_simulation(s, 0.25, 4000).collect()}
    for k, r in sim.items():
        assert abs(r["bias"]) < 0.01 and r["rmse"] == pytest.approx(exact[k]["standard_error"], abs=0.01)
    again = {r["design"]: r["mean_estimate"] for r in simulation.design_simulation(s.repartition(7), 0.25, 4000).collect()}
    assert all(again[k] == pytest.approx(sim[k]["mean_estimate"]) for k in sim)


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 60}", int(y), int(y if rng.random() < 0.8 else (y + 1) % 3)) for i, y in enumerate(rng.integers(0, 3, 900))]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    ci = {r["metric"]: (r["low"], r["high"]) for r in simulation.cluster_bootstrap(simulation.group_confusions(df, ["g"], "y", "p"), ["g"], 400).collect()}
    hit = np.mean([y == p for _, y, p in rows])
    assert ci["agreement"][0] < hit < ci["agreement"][1] and 0.03 < ci["agreement"][1] - ci["agreement"][0] < 0.09
    g = simulation.group_confusions(df, ["g"], "y", "p")
    same = simulation.paired_bootstrap(g.withColumnRenamed("m", "old").join(g.withColumnRenamed("m", "new"), "g"), ["g"], 100).collect()
    assert all(r["low"] == r["high"] == 0 for r in same)
    assert all(r["low"] is None for r in simulation.cluster_bootstrap(g.limit(0), ["g"], 10).collect())


def test_features(spark):
    one = spark.createDataFrame([("Ab cde",), ("",), (None,)], "t string")
    assert [r[0] for r in one.select(features.char_ngrams(F.col("t"), 3, 4)).collect()][:2] == [["Ab ", "b c", " cd", "cde", "Ab c", "b cd", " cde"], []]
    assert one.select(features.word_ngrams(F.lit("The big, big été a"))).first()[0] == ["the", "big", "big", "été", "the big", "big big", "big été"]
    w = features.tfidf(spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, None)], "k int, t string"), "k", features.word_ngrams(F.col("t"))).collect()
    assert {(r["k"], r["term"], r["weight"]) for r in w} == {(1, "aa", 1.0), (2, "aa", 1.0)}
    v = spark.createDataFrame([("o", [3.0, 4.0], 1), ("o", [0.0, 0.0], 5)], "o string, v array<double>, w int")
    assert features.pooled(v, ["o"], "v", "w").first()["vector"] == pytest.approx([0.6, 0.8])
    lg = spark.createDataFrame([("d", 0, 1.0), ("d", 0, 3.0), ("d", 1, 2.0)], "d string, c int, z double")
    assert {r["c"]: r["logit"] for r in features.aggregate_logits(lg, ["d"], "c", "z").collect()} == {0: 3.0, 1: 2.0}
    with pytest.raises(Exception, match="NaN"):
        features.aggregate_logits(lg.withColumn("z", F.lit(float("nan"))), ["d"], "c", "z").collect()
    x = spark.createDataFrame([(0,), (5,), (64,), (130,)], "n int").select("n", features.token_windows(F.col("n"), 64).alias("w")).collect()
    for r in x:
        assert sum(a["weight"] for a in r["w"]) == r["n"] and max(a["end"] for a in r["w"]) == r["n"]
    assert spark.range(1).select(cl.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))).first()[0] == 1
    assert spark.range(1).select(cl.logistic(F.lit(-1e9))).first()[0] == pytest.approx(0.0, abs=1e-300)


def test_heads_and_temperature(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 120)
    rows = [([float(v) for v in np.eye(3)[k] + rng.normal(0, 0.2, 3)], int(k)) for k in y] + [([9.0, 9.0, 9.0], -1)]
    df = spark.createDataFrame(rows, "v array<double>, y int")
    h = features.fit_head(df, "v", "y", c=10.0)
    acc = df.filter("y >= 0").agg(F.avg((cl.argmax(h.probabilities(F.col("v"))) == F.col("y")).cast("int"))).first()[0]
    assert acc > 0.95
    two, one = features.fit_head(df.filter("y <> 2"), "v", "y"), features.fit_head(df.filter("y = 1"), "v", "y")
    assert two.intercept[2] == -30 and two.coef[0] == pytest.approx([-x for x in two.coef[1]]) and one.classes == (1,)
    p = df.select(one.probabilities(F.col("v")).alias("p")).first()["p"]
    assert len(p) == 3 and p[1] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        features.fit_head(df.limit(0), "v", "y")
    z = spark.createDataFrame([([4.0, 0.0, 0.0], 0), ([4.0, 0.0, 0.0], 1), ([0.0, 4.0, 0.0], 1), ([0.0, 0.0, 4.0], 2)], "z array<double>, y int")
    t = features.fit_temperature(z, "z", "y")
    assert 1 < t <= 4
    loss = lambda t: -np.mean([math.log(math.exp(r[0][r[1]] / t) / sum(math.exp(x / t) for x in r[0])) for r in [([4, 0, 0], 0), ([4, 0, 0], 1), ([0, 4, 0], 1), ([0, 0, 4], 2)]])
    assert loss(t) <= min(loss(x) for x in np.linspace(0.25, 4, 300)) + 1e-4


def test_census(spark):
    sig = "struct<label:string,reason:string,evidence:array<string>>"
    lab = spark.createDataFrame([("a", ("yes", None, []), ("no", None, []), ["t"]), ("b", None, ("unclear", None, []), []), ("c", ("no", None, []), None, ["t", "u"])], f"input_id string, dissatisfaction {sig}, correction {sig}, reason_tags array<string>")
    inp = spark.createDataFrame([("a", "t", "s"), ("b", "t", "s"), ("c", "t", "r"), ("d", "t", "r")], "input_id string, tenant_id string, session_id string")
    y = {r["input_id"]: (r["y_dissatisfaction"], r["y_correction"]) for r in census.target_matrix(inp, lab).collect()}
    assert y == {"a": (0, 1), "b": (-1, 2), "c": (1, -1), "d": (-1, -1)}
    b = {r["task"]: (r["known"], r["yes_fraction"], r["low"], r["high"]) for r in census.bounds(census.task_counts(inp, lab)).collect()}
    assert b == {"dissatisfaction": (2, 0.5, 0.25, 0.75), "correction": (1, 0.0, 0.0, 0.75)}
    assert {r["tag"]: r["n"] for r in census.tag_counts(lab).collect()} == {"t": 2, "u": 1}
    assert census.sessions_with_yes(inp, lab).first()["sessions"] == 1 and census.task_overlap(lab).count() == 1


def test_features_of_documents(spark, tmp_path):
    from weftline.plans import registry

    texts = {1: "The Export stops,  the export", 2: "the EXPORT resumed at noon", 3: "ab", 4: "Noon at\n\nthe export " * 8, 5: None, 6: "стоп Стоп"}
    spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    low = {k: " ".join(t.lower().split()) + (" " if t != t.rstrip() else "") for k, t in texts.items() if t}
    tf = {k: {} for k in low}
    for k, t in low.items():
        for n in (3, 4, 5):
            for i in range(len(t) - n + 1):
                tf[k][t[i : i + n]] = tf[k].get(t[i : i + n], 0) + 1
    df = {}
    for x in tf.values():
        for g in x:
            df[g] = df.get(g, 0) + 1
    assert {r["gram"]: r["n_documents"] for r in run("document_char_shingles")} == df and df["expor"] == 3
    want = {}
    for k, x in tf.items():
        w = {g: (1 + math.log(n)) * (math.log(7 / (1 + df[g])) + 1) for g, n in x.items() if df[g] >= 2}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want |= {(k, g): v / norm for g, v in w.items()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in run("document_tfidf_char")}
    assert set(got) == set(want) and all(abs(got[p] - v) < 1e-7 for p, v in want.items())
    words = {(r["doc_id"], r["term"]) for r in run("document_tfidf_word")}
    assert {(1, "the export"), (2, "noon"), (4, "at")} <= words and not any(t == "resumed" for _, t in words)
    cover = {}
    for r in run("document_token_windows"):
        cover[r["doc_id"]] = cover.get(r["doc_id"], 0) + r["weight"]
    assert {k: cover[k] for k in low} == {k: len(texts[k]) for k in low}


def test_char_weights_of_any_alphabet(spark, monkeypatch):
    import random

    rng = random.Random(9)
    many = "".join(chr(0x4E00 + i) for i in range(5000))
    rows = [("a", "the export\0stops 😀\0"), ("a", "the export\0stops 😀\0"), ("a", "another text of a"), ("b", "the export\0stops"), ("c", None), ("d", ""), ("e", "ab"), ("f", many), ("g", many[:4500] + "the"), (None, "the export")]
    rows += [(f"r{i}", "".join(rng.choice("abc é") for _ in range(rng.randrange(60)))) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, t string")
    monkeypatch.setattr(features, "ROWS", 50)
    for min_df, cap in ((2, 100), (1, 40_000)):
        want = {(r["k"], r["term"]): r["weight"] for r in features.tfidf(df.distinct(), "k", features.char_ngrams(F.col("t")), min_df, cap).collect()}
        got = [(r["k"], r["term"], r["weight"]) for r in features.char_tfidf(df, "k", "t", 3, 5, min_df, cap).collect()]
        assert len(got) == len(want) > 500 and all(abs(want[k, g] - w) < 1e-12 for k, g, w in got)
    assert features.char_tfidf(df.limit(0), "k", "t").count() == 0


def test_char_weights_shuffle_no_grams(spark, tmp_path):
    from weftline.plans import registry

    spark.createDataFrame([(i, f"planner report {i % 7} " * 40) for i in range(600)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sc, none = spark.sparkContext, spark.sparkContext._jvm.java.util.ArrayList

    def written() -> tuple[int, int]:
        found = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
        stages = [found.apply(i) for i in range(found.size())]
        return len(stages), sum(s.shuffleWriteRecords() for s in stages)

    seen, before = written()
    weights = registry.queries()["document_tfidf_char"](spark, str(tmp_path)).count()
    stages, after = written()
    assert weights > 30_000 and stages > seen and after - before < weights / 4


def test_rounded_is_round(spark):
    x = spark.range(200_000).select(((F.col("id") - 100_000) / 99_991).alias("w")).union(spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.0, -1.0, 0.5, 0.123456785, 0.000000005, -0.000000005, 0.999999995, None)], "w double"))
    assert x.filter(~F.round("w", 8).eqNullSafe(features.rounded("w", 8))).count() == 0
