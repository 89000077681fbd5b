"""Queries over orders, damaged decisions, reused calls, candidates, drift and digests.

The tables hold no candidates and no damaged decisions, so these are derived from seeded draws: the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.canon import json_array, string_json, uniform
from weftline.operators import checks, classification, events, features, journal, ranking, routing, simulation, study
from weftline.plans import feedback_queries as fq
from weftline.plans import study_queries as sq
from weftline.plans.trace_queries import _NORM, DRAW
from weftline.session import table
from weftline.sources import files, frozen

CANDIDATES = ("plain", "short", "steps", "strict")


def event_order(spark, d):
    """The total order of events: tenant, trace, sequence, event."""
    e = events.normalize(table(spark, d, "trace_events")).select("tenant_id", "trace_id", "sequence", "event_id")
    return ranking.global_sequence(e, ["tenant_id", "trace_id", "sequence", "event_id"], "position").select("tenant_id", "trace_id", "event_id", "position")


def routing_order(spark, d):
    """Decisions in the order of tenant and trace."""
    r = fq.route_cascade(spark, d).select("tenant_id", "trace_id", "routed")
    return ranking.global_sequence(r, ["tenant_id", "trace_id"], "position")


def decision_errors(spark, d):
    """Decisions, one in ten with a turned audit flag, that don't follow from their policy."""
    x = routing.route(fq.examples(spark, d), fq.predictions(spark, d), fq.CASCADE)
    hurt = uniform(42, "damage-v1", json_array("tenant_id", "trace_id")) < 0.1
    x = x.withColumn("audit_selected", F.when(hurt, ~F.col("audit_selected")).otherwise(F.col("audit_selected")))
    return routing.inconsistent(x, fq.CASCADE).select("tenant_id", "trace_id")


def target_validation(spark, d):
    return checks.target_coverage(fq.inputs(spark, d), table(spark, d, "feedback_labels").select("input_id", F.col("dissatisfaction.label").alias("label"), "judge_version"))


def window_audit(spark, d):
    """How many windows of 64 characters the documents take."""
    x = table(spark, d, "documents").filter("text IS NOT NULL").select(F.size(features.token_windows(F.length("text"), 64)).cast("long").alias("n"))
    return x.agg(F.sum("n").alias("windows"), F.count_if(F.col("n") > 1).alias("windowed_documents"), F.max("n").alias("most_windows"))


def reused_calls(spark, d):
    """Calls of an earlier run that answer planned ones; one request in five was another one."""
    other = uniform(42, "prompt-v1", string_json("input_id")) < 0.2
    plan = sq._plan(spark, d).withColumn("prompt_hash", F.sha2("input_id", 256))
    prior = sq._journal(spark, d).withColumns({"call_id": F.concat(F.lit("prior-"), "call_id"), "prompt_hash": F.sha2(F.concat("input_id", F.when(other, "x").otherwise("")), 256)})
    return journal.reusable(plan, prior)


def _answers(spark, d):
    """Answers of four prompt candidates to the labelled inputs: each fails on some and errs on more than the one before."""
    x = table(spark, d, "feedback_labels").select("input_id", F.col("dissatisfaction.label").alias("own")).filter("own IS NOT NULL")
    x = x.select("input_id", "own", F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), uniform(42, f"candidate-{c}", string_json("input_id")).alias("u"), F.lit(i).alias("i")) for i, c in enumerate(CANDIDATES)])).alias("c")).select("input_id", "own", "c.*")
    label = F.when(F.col("u") < 0.03 * (F.col("i") + 1), None).when(F.col("u") < 0.2 + 0.05 * F.col("i"), "unclear").otherwise(F.col("own"))
    return x.select("candidate", "input_id", label.alias("label"))


def _summary(spark, d):
    return study.tuning_summary(_answers(spark, d), sq._references(spark, d))


def tuning_summary(spark, d):
    return _summary(spark, d)


def prompt_winner(spark, d):
    return study.best_prompt(_summary(spark, d), 0.9)


def _candidates(spark, d):
    s = _summary(spark, d).select(F.col("candidate").alias("name"), F.col("accuracy_on_answered").alias("macro_f1"), F.col("accuracy_on_all").alias("agreement"), F.col("coverage").alias("yes_f1"))
    s = s.withColumns({"bytes": F.length("name") * 100, "c": F.length("name").cast("double"), "balanced": F.length("name") % 2})
    return study.union_candidates({"large": s.filter("length(name) > 5").drop("yes_f1"), "small": s.filter("length(name) <= 5")})


def student_winner(spark, d):
    return study.best(_candidates(spark, d), study.STUDENT).select("family", "name", "macro_f1")


def feedback_winner(spark, d):
    return study.best(_candidates(spark, d).filter("yes_f1 IS NOT NULL"), study.FEEDBACK).select("family", "name", "yes_f1")


def named_winner(spark, d):
    return study.best(_candidates(spark, d), study.NAMED).select("name", "macro_f1")


def grid_winners(spark, d):
    """The best setting of each family."""
    return study.best_in_group(_candidates(spark, d), "family", study.GRID).select("family", "name", "macro_f1", "agreement")


def candidate_gaps(spark, d):
    """Expected candidates against those that have answers."""
    want = spark.createDataFrame([(c,) for c in (*CANDIDATES[1:], "absent")], "name string")
    return checks.coverage_gaps(want, _candidates(spark, d), "name")


def stratified_gain(spark, d):
    """Gain of one candidate over another inside the classes of the references."""
    a = _answers(spark, d).join(sq._references(spark, d), "input_id")
    right = lambda c: F.coalesce(F.max(F.when(F.col("candidate") == c, F.col("label") == F.col("reference"))), F.lit(False))
    x = a.groupBy("input_id", "reference").agg(right("strict").alias("old"), right("plain").alias("new"))
    return study.stratified_gain(x, "reference")


def task_temperatures(spark, d):
    s = sq._scored(spark, d)
    x = s.select(F.lit("dissatisfaction").alias("task"), "logits", F.col("y").alias("label")).unionByName(s.select(F.lit("correction").alias("task"), "logits", F.col("y2").alias("label")))
    return spark.createDataFrame(sorted(study.task_temperatures(x).items()), "task string, temperature double")


def head_grid(spark, d):
    """A grid of heads fitted on three quarters of the vectors and measured on the rest."""
    x = table(spark, d, "embeddings").withColumn("y", F.col("label") % 4 - 1).withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    return study.grid_search(x.filter("h > 0"), x.filter("h = 0"), "embedding", "y", (0.1, 1.0))[0]


def _raw(spark, d):
    x = table(spark, d, "feedback_inputs").filter("input_id IS NOT NULL").select("input_id", "language", "source_dataset", F.length("text").alias("n"), F.unix_micros("ingested_ts").alias("t"))
    return x.groupBy("input_id").agg(F.min("t").alias("t"), F.min("language").alias("language"), F.min("source_dataset").alias("source_dataset"), F.expr("min(n) div 100").alias("length"))


def drift_report(spark, d):
    """Language, source and length of the messages of the earlier and the later half of the time covered."""
    x = _raw(spark, d)
    mid = x.agg(((F.min("t") + F.max("t")) / 2).alias("mid"))
    x = x.crossJoin(F.broadcast(mid)).withColumn("half", F.when(F.col("t") < F.col("mid"), "before").otherwise("after"))  # one row
    r = study.drift(x, ["language", "source_dataset", "length"], "half")
    return r.select("dimension", "value", "n_before", "n_after", *[F.round(c, 9).alias(c) for c in ("share_before", "share_after", "change")])


def routing_growth(spark, d):
    """Traces by size: the share that the filter selects, and what independent messages would give."""
    m = fq.route_members(spark, d)
    q = m.agg(F.avg((F.col("model_selected") | F.col("safety_selected")).cast("double")).alias("q"))
    t = m.groupBy("tenant_id", "trace_id").agg(F.count("*").alias("n_inputs"), F.max(F.col("model_selected") | F.col("safety_selected")).alias("hit"))
    g = t.groupBy("n_inputs").agg(F.count("*").alias("traces"), F.avg(F.col("hit").cast("double")).alias("selected"))
    g = g.crossJoin(F.broadcast(q))  # one row
    return g.select("n_inputs", "traces", F.round("selected", 9).alias("selected"), F.round(study.routing_growth(F.col("q"), F.col("n_inputs")), 9).alias("expected"))


def end_to_end_recall(spark, d):
    """Recall of routing, and of routing and the labelling calls together."""
    m = fq.route_members(spark, d)
    return routing.end_to_end(m, routing.decide(m, fq.CASCADE), fq.labels(spark, d), sq._calls(spark, d).filter("repeat = 0"))


def vectors_aligned(spark, d):
    """Vectors in the documents' order of ids; documents beyond the vectors have none."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("input_id"), F.col("embedding").alias("vector"))
    return frozen.aligned(table(spark, d, "documents").select(F.col("doc_id").alias("input_id")), v).select("input_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def input_digest(spark, d):
    """Rows and digest of the inputs: what a manifest of frozen data holds."""
    return files.collection_digest(fq.inputs(spark, d).select("input_id", "language", "message_id", "session_id", "split", "tenant_id", "text"), ["input_id"])


def miscalibrated_scores(spark, d):
    """Scores of a stretched export outside [0, 1], NaN among them."""
    x = fq.predictions(spark, d).withColumn("score", F.col("score") * 1.25 - 0.1)
    return checks.bad_probabilities(x, "score").select("input_id", "runtime_status")


def predictions_without_split(spark, d):
    """Predictions of inputs that no split holds."""
    return checks.stale(fq.predictions(spark, d), fq.inputs(spark, d).filter("split IS NOT NULL"), "input_id")


def session_group_changes(spark, d):
    """Sessions whose messages don't agree about their group."""
    return events.group_changes(fq.inputs(spark, d).withColumnRenamed("session_id", "trace_id"))


def step_counts(spark, d):
    """Cumulative counts at every distinct score of each split."""
    return classification.score_steps(sq._scored(spark, d).filter("y >= 0"), F.col("y") == 0, "score", ["split"]).select("split", F.round("score", 9).alias("score"), "tp", "fp", "positives")


def session_confusions(spark, d):
    """Confusion counts of each session: what resampling draws from."""
    g = simulation.group_confusions(sq._scored(spark, d), ["tenant_id", "session_id"], "y", "predicted")
    return g.select("tenant_id", "session_id", *[F.col("m")[i].alias(f"m{i}") for i in range(9)])


QUERIES = {
    f.__name__: f
    for f in (
        event_order, routing_order, decision_errors, target_validation, window_audit, reused_calls, tuning_summary, prompt_winner, student_winner, feedback_winner, named_winner, grid_winners, candidate_gaps,
        stratified_gain, task_temperatures, head_grid, drift_report, routing_growth, end_to_end_recall, vectors_aligned, input_digest, miscalibrated_scores, predictions_without_split, session_group_changes,
        step_counts, session_confusions,
    )
}

_A = " UNION ALL ".join(f"SELECT '{c}' AS candidate, input_id, own, {DRAW.format(ns=f'candidate-{c}', key='to_json(input_id)')} AS u, {i} AS i FROM own" for i, c in enumerate(CANDIDATES))
_SUM = f"""own AS (SELECT input_id, dissatisfaction.label AS own FROM feedback_labels WHERE dissatisfaction.label IS NOT NULL), ca AS ({_A}),
an AS (SELECT candidate, input_id, own, CASE WHEN u < 0.03 * (i + 1) THEN NULL WHEN u < 0.2 + 0.05 * i THEN 'unclear' ELSE own END AS label FROM ca),
su AS (SELECT candidate, (SELECT count(*) FROM own) AS inputs, count(label) AS answered, count(label) / (SELECT count(*) FROM own) AS coverage, count(*) FILTER (label = own) / count(label) AS accuracy_on_answered,
    count(*) FILTER (label = own) / (SELECT count(*) FROM own) AS accuracy_on_all FROM an GROUP BY ALL),
cd AS (SELECT candidate AS name, accuracy_on_answered AS macro_f1, accuracy_on_all AS agreement, coverage AS yes_f1, length(candidate) * 100 AS bytes, length(candidate) AS c, length(candidate) % 2 AS balanced,
    CASE WHEN length(candidate) > 5 THEN 'large' ELSE 'small' END AS family FROM su)"""
_RAW = """r AS (SELECT input_id, min(epoch_us(ingested_ts)) AS t, min(language) AS language, min(source_dataset) AS source_dataset, min(length(text)) // 100 AS length FROM feedback_inputs WHERE input_id IS NOT NULL GROUP BY ALL),
h AS (SELECT *, t < (SELECT (min(t) + max(t)) / 2 FROM r) AS early FROM r),
u AS (SELECT early, 'language' AS dimension, coalesce(language, '(none)') AS value FROM h UNION ALL SELECT early, 'source_dataset', coalesce(source_dataset, '(none)') FROM h UNION ALL SELECT early, 'length', coalesce(length::VARCHAR, '(none)') FROM h)"""
_PART = "coalesce(sum(('0x' || substr(h, {0}, 12))::UBIGINT::HUGEINT), 0)::VARCHAR"
ORACLE = {
    "event_order": f"WITH {_NORM} SELECT tenant_id, trace_id, event_id, row_number() OVER (ORDER BY tenant_id, trace_id, sequence, event_id) - 1 AS position FROM n",
    "routing_order": fq._C + " SELECT tenant_id, trace_id, routed, row_number() OVER (ORDER BY tenant_id, trace_id) - 1 AS position FROM dec",
    "decision_errors": fq._C + f" SELECT tenant_id, trace_id FROM dec WHERE {DRAW.format(ns='damage-v1', key='to_json([tenant_id, trace_id])')} < 0.1",
    "target_validation": f"""WITH {fq.INPUTS}, t AS (SELECT DISTINCT input_id FROM i), l AS (SELECT input_id, dissatisfaction.label AS label, judge_version FROM feedback_labels)
        SELECT count(*) AS n_inputs, count(*) FILTER (n > 0) AS n_labelled, count(*) FILTER (n IS NULL) AS n_missing, (SELECT count(DISTINCT judge_version) FROM l JOIN t USING (input_id) WHERE label IS NOT NULL) AS n_versions
        FROM t LEFT JOIN (SELECT input_id, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL) USING (input_id)""",
    "window_audit": """WITH w AS (SELECT CASE WHEN length(text) <= 64 THEN 1 ELSE ceil(length(text) / 64)::BIGINT END AS n FROM documents WHERE text IS NOT NULL)
        SELECT sum(n)::BIGINT AS windows, count(*) FILTER (n > 1) AS windowed_documents, max(n)::BIGINT AS most_windows FROM w""",
    "reused_calls": f"""WITH {sq._J} SELECT call_id, 'prior-' || call_id AS prior_call_id, NOT {DRAW.format(ns='prompt-v1', key='to_json(input_id)')} < 0.2 AS same_request FROM la WHERE runtime_status = 'ok'""",
    "tuning_summary": f"WITH {_SUM} SELECT * FROM su",
    "prompt_winner": f"WITH {_SUM} SELECT * FROM su WHERE coverage >= 0.9 ORDER BY accuracy_on_all DESC, coverage DESC, candidate LIMIT 1",
    "student_winner": f"WITH {_SUM} SELECT family, name, macro_f1 FROM cd ORDER BY macro_f1 DESC, agreement DESC, bytes, name LIMIT 1",
    "feedback_winner": f"WITH {_SUM} SELECT family, name, yes_f1 FROM cd WHERE family = 'small' ORDER BY macro_f1 DESC, yes_f1 DESC, bytes, name LIMIT 1",
    "named_winner": f"WITH {_SUM} SELECT name, macro_f1 FROM cd ORDER BY macro_f1 DESC, name LIMIT 1",
    "grid_winners": f"WITH {_SUM} SELECT family, name, macro_f1, agreement FROM cd QUALIFY row_number() OVER (PARTITION BY family ORDER BY macro_f1 DESC, agreement DESC, c, balanced, name) = 1",
    "candidate_gaps": f"WITH {_SUM}, w AS (SELECT unnest(['short', 'steps', 'strict', 'absent']) AS name) SELECT name, 'left_only' AS side FROM w ANTI JOIN cd USING (name) UNION ALL SELECT name, 'right_only' FROM cd ANTI JOIN w USING (name)",
    "drift_report": f"""WITH {_RAW}, g AS (SELECT dimension, value, count(*) FILTER (early) AS b, count(*) FILTER (NOT early) AS a FROM u GROUP BY ALL),
        s AS (SELECT *, coalesce(b / nullif(sum(b) OVER (PARTITION BY dimension), 0), 0) AS x, coalesce(a / nullif(sum(a) OVER (PARTITION BY dimension), 0), 0) AS y FROM g)
        SELECT dimension, value, b AS n_before, a AS n_after, round(x, 9) AS share_before, round(y, 9) AS share_after, round(y - x, 9) AS change FROM s""",
    "routing_growth": f"""WITH {fq._members(0.6)}, t AS (SELECT count(*) AS n_inputs, max((model_selected OR safety_selected)::INT) AS hit FROM m GROUP BY tenant_id, trace_id)
        SELECT n_inputs, count(*) AS traces, round(avg(hit), 9) AS selected, round(1 - pow(1 - (SELECT avg((model_selected OR safety_selected)::INT) FROM m), n_inputs), 9) AS expected FROM t GROUP BY ALL""",
    "end_to_end_recall": fq._C + f""", {sq._J}, ee AS (SELECT routed, la.runtime_status = 'ok' AND la.label = 'yes' AS hit FROM m JOIN dec USING (tenant_id, trace_id) JOIN lab USING (input_id) LEFT JOIN la ON la.input_id = m.input_id AND repeat = 0 WHERE lab.label = 'yes')
        SELECT count(*) AS positives, count(*) FILTER (routed) AS routed_positives, count(*) FILTER (routed AND hit) AS found_positives, count(*) FILTER (routed) / nullif(count(*), 0) AS routing_recall,
        count(*) FILTER (routed AND hit) / nullif(count(*), 0) AS end_to_end_recall FROM ee""",
    "vectors_aligned": "SELECT doc_id AS input_id, round(embedding[1]::DOUBLE, 6) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "input_digest": f"""WITH {fq.INPUTS}, j AS (SELECT sha256(to_json(struct_pack(input_id := input_id, language := language, message_id := message_id, session_id := session_id, split := split, tenant_id := tenant_id, text := text))::VARCHAR) AS h FROM i)
        SELECT count(*) AS rows, sha256(count(*) || ',' || {" || ',' || ".join(_PART.format(1 + 12 * k) for k in range(5))}) AS digest FROM j""",
    "miscalibrated_scores": f"WITH {fq._EX} SELECT input_id, runtime_status FROM p WHERE score IS NOT NULL AND (isnan(score) OR score * 1.25 - 0.1 < 0 OR score * 1.25 - 0.1 > 1)",
    "predictions_without_split": "SELECT DISTINCT input_id FROM predictions WHERE input_id NOT IN (SELECT input_id FROM feedback_inputs WHERE split IS NOT NULL)",
    "session_group_changes": f"WITH {fq.INPUTS} SELECT tenant_id, session_id AS trace_id, count(DISTINCT group_id) + max((group_id IS NULL)::INT) AS n_groups FROM i GROUP BY ALL HAVING n_groups > 1",
    "step_counts": f"""WITH {sq._S}, g AS (SELECT split, score, count(*) FILTER (y = 0) AS p, count(*) FILTER (y <> 0) AS q FROM sk GROUP BY ALL)
        SELECT split, round(score, 9) AS score, sum(p) OVER (PARTITION BY split ORDER BY score DESC)::BIGINT AS tp, sum(q) OVER (PARTITION BY split ORDER BY score DESC)::BIGINT AS fp, sum(p) OVER (PARTITION BY split)::BIGINT AS positives FROM g""",
    "session_confusions": f"WITH {sq._S} SELECT tenant_id, session_id, {', '.join(f'count(*) FILTER (y = {i // 3} AND predicted = {i % 3}) AS m{i}' for i in range(9))} FROM sk GROUP BY ALL",
}
