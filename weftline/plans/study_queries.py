"""Queries over labels and derived calls and scores: journal, consensus, metrics, thresholds, simulation, features, census.

The tables hold labels but no logits and no call records, so both are derived from seeded draws of the input id: the same
values in every engine. Class numbers: yes 0, no 1, unclear 2.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.canon import json_array, string_json, uniform
from weftline.operators import census, features, judging, simulation
from weftline.operators import classification as cl
from weftline.operators import journal as jr
from weftline.plans.feedback_queries import INPUTS, inputs
from weftline.plans.trace_queries import DRAW
from weftline.schemas import LABELS
from weftline.session import table

VERSION, REPEATS = "jv-12", 2
TAGS = ("wrong_result", "ignored_requirement", "repeated_mistake", "unnecessary_action", "reported_loop", "reported_backtracking")


def _labels(spark, d):
    return table(spark, d, "feedback_labels")


def _plan(spark, d):
    return jr.planned(_labels(spark, d), REPEATS, VERSION)


def _journal(spark, d):
    """A first record of every planned call and a second one of the failed calls with an even repeat."""
    k = json_array("input_id", F.col("repeat").cast("string"))
    j = _plan(spark, d).join(_labels(spark, d).select("input_id", F.col("dissatisfaction.label").alias("own")), "input_id").withColumn("u", uniform(42, "call-v1", k))
    status = F.when(F.col("u") < 0.8, "ok").when(F.col("u") < 0.9, "error").otherwise("not_evaluated")
    label = F.when(uniform(42, "flip-v1", k) < 0.1, "unclear").otherwise(F.coalesce("own", F.lit("no")))
    first = j.select("call_id", "input_id", "repeat", "judge_version", F.lit(1).cast("long").alias("attempt_no"), status.alias("runtime_status"), "u", label.alias("label"))
    again = first.filter("runtime_status = 'error' AND repeat = 0").withColumns({"attempt_no": F.lit(2).cast("long"), "runtime_status": F.lit("ok")})
    tokens = F.floor(F.col("u") * 50).cast("long")
    one = F.struct(
        F.col("runtime_status"), (1 + F.col("u") * F.col("attempt_no")).alias("elapsed_seconds"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error_type"),
        (100 + tokens).alias("prompt_tokens"), tokens.alias("completion_tokens"), (100 + 2 * tokens).alias("total_tokens"),
    )
    return first.unionByName(again).withColumn("attempts", F.array(one)).withColumn("label", F.when(F.col("runtime_status") == "ok", F.col("label"))).drop("u")


def pending_calls(spark, d):
    return jr.pending(_plan(spark, d), _journal(spark, d))


def latest_calls(spark, d):
    return jr.latest(_journal(spark, d)).select("call_id", "input_id", "repeat", "attempt_no", "runtime_status", "label", "n_previous")


def call_history(spark, d):
    return jr.history(_journal(spark, d))


def call_status_counts(spark, d):
    return jr.status_counts(_journal(spark, d))


def attempt_flatten(spark, d):
    return jr.attempts(_journal(spark, d)).drop("error_type")


def token_latency_summary(spark, d):
    return jr.usage(jr.attempts(_journal(spark, d)))


def journal_insert(spark, d):
    """Planned calls that an insert-if-absent into the journal of repeat 0 would add."""
    j = _journal(spark, d)
    return jr.insert_if_absent(j.filter("repeat = 0"), j.filter("attempt_no = 1")).select("call_id", "repeat", "runtime_status")


def journal_merge(spark, d):
    """Second records that may go over the first: none over a final one."""
    j = _journal(spark, d)
    return jr.guarded_merge(j.filter("attempt_no = 1"), j.filter("repeat = 0").withColumn("attempt_no", F.lit(3))).groupBy("runtime_status").agg(F.count("*").alias("n"))


def remaining_estimate(spark, d):
    return jr.remaining(_plan(spark, d), _journal(spark, d))


def _calls(spark, d):
    return jr.latest(_journal(spark, d))


def _references(spark, d):
    return _labels(spark, d).select("input_id", F.col("dissatisfaction.label").alias("reference")).filter("reference IS NOT NULL")


def judge_consensus(spark, d):
    return judging.consensus(_labels(spark, d), _calls(spark, d), REPEATS)


def unresolved_inputs(spark, d):
    return judge_consensus(spark, d).filter("outcome <> 'agreed'").select("input_id", "outcome")


def repeat_agreement(spark, d):
    return judging.repeat_agreement(_calls(spark, d))


def _primary(spark, d):
    return judging.primary(_calls(spark, d)).filter("runtime_status = 'ok'").join(_references(spark, d), "input_id")


def judge_confusion(spark, d):
    return cl.confusion(_primary(spark, d), "reference", "label", LABELS)


def judge_per_class(spark, d):
    return cl.per_class(judge_confusion(spark, d))


def judge_agreement(spark, d):
    return judging.coverage_agreement(_calls(spark, d), _references(spark, d))


def disagreements(spark, d):
    return judging.disagreements(_calls(spark, d), _references(spark, d))


def feedback_validation(spark, d):
    """The first broken rule of each signal of each label; null for valid ones."""
    x = _labels(spark, d).join(inputs(spark, d).select("input_id", "text"), "input_id")
    yes = (F.coalesce("dissatisfaction.label", F.lit("")) == "yes") | (F.coalesce("correction.label", F.lit("")) == "yes")
    return x.select("input_id", *[judging.feedback_error(F.col("text"), F.col(t)).alias(f"{t}_error") for t in census.TASKS], judging.tags_error(F.col("reason_tags"), TAGS, yes).alias("tags_error"))


def answer_validation(spark, d):
    """Answers built from the labels, one in three damaged, against the strict answer schema."""
    x = _labels(spark, d).select("input_id", F.coalesce("dissatisfaction.label", F.lit("?")).alias("l"), uniform(42, "answer-v1", string_json("input_id")).alias("u"))
    body = F.concat(F.lit('{"label":"'), F.col("l"), F.lit('","reason":"seen"}'))
    content = F.when(F.col("u") < 0.1, F.lit("no json")).when(F.col("u") < 0.2, F.concat(F.lit('{"extra":1,"label":"'), F.col("l"), F.lit('"}'))).when(F.col("u") < 0.33, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return x.select("input_id", judging.answer_error(content, {"label": LABELS, "reason": None}).alias("error"))


def _scored(spark, d):
    """(input_id, tenant, session, y, logits, p, predicted, score) of labelled inputs, y from dissatisfaction."""
    key = string_json("input_id")
    logits = F.array(*[4 * uniform(42, f"logit-{i}", key) for i in range(3)])
    x = inputs(spark, d).join(_labels(spark, d), "input_id").select("input_id", "tenant_id", "session_id", "split", census.label_index(F.col("dissatisfaction.label")).alias("y"), census.label_index(F.col("correction.label")).alias("y2"), logits.alias("logits"))
    x = x.withColumn("p", cl.softmax(F.col("logits")))
    return x.withColumns({"predicted": cl.argmax(F.col("p")), "score": F.col("p")[0]})


def softmax_probabilities(spark, d):
    return _scored(spark, d).select("input_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"), F.col("p")[2].alias("p2"), "predicted")


def confusion3(spark, d):
    return cl.confusion(_scored(spark, d).filter("y >= 0"), "y", "predicted", (0, 1, 2))


def classification_metrics(spark, d):
    """Agreement and macro-F1 under both conventions."""
    c = confusion3(spark, d)
    both = cl.agreement(c, True).withColumn("convention", F.lit("zero_division")).unionByName(cl.agreement(c, False).withColumn("convention", F.lit("observed")))
    return both.select("convention", "messages", "agreement", "macro_f1")


def nll_brier(spark, d):
    return cl.log_loss_and_brier(_scored(spark, d), "y", "p")


def task_metrics(spark, d):
    """Per task: masked agreement and the F1 of yes."""
    x = _scored(spark, d)
    out = None
    for t, y in (("dissatisfaction", "y"), ("correction", "y2")):
        c = cl.confusion(x.filter(f"{y} >= 0"), y, "predicted", (0, 1, 2))
        yes = cl.per_class(c).filter("class = 0").select(F.coalesce("f1", F.lit(0.0)).alias("yes_f1"))
        r = cl.agreement(c, True).crossJoin(F.broadcast(yes)).withColumn("task", F.lit(t))  # one row each
        out = r if out is None else out.unionByName(r)
    return out


def choose_thresholds(spark, d):
    return cl.recall_thresholds(cl.score_steps(_scored(spark, d).filter("y >= 0"), F.col("y") == 0, "score"), (0.5, 0.8, 0.95, 1.0))


def recall_precision_threshold(spark, d):
    return cl.precise_threshold(cl.score_steps(_scored(spark, d).filter("y >= 0"), F.col("y") == 0, "score"), 0.8)


def average_precision(spark, d):
    return cl.average_precision(cl.score_steps(_scored(spark, d).filter("y >= 0"), F.col("y") == 0, "score", ["split"]), ["split"])


def yes_metrics(spark, d):
    return cl.binary_metrics(_scored(spark, d).filter("y >= 0"), F.col("y") == 0, F.col("score"), 0.5)


def label_prior(spark, d):
    return cl.label_prior(_labels(spark, d).select(F.col("dissatisfaction.label").alias("label")), "label", LABELS)


def threshold_winner(spark, d):
    """The grid threshold with the best F1 of yes (ties: the larger one)."""
    x = _scored(spark, d).filter("y >= 0").select("y", "score", F.explode(F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("threshold"))
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 0
    g = x.groupBy("threshold").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    return cl.winner(g.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))), F.desc("f1"), F.desc("threshold"))


def paired_outcomes(spark, d):
    x = _scored(spark, d).filter("y >= 0").withColumn("old", F.lit(1))
    return cl.paired_outcomes(x, "y", "old", "predicted")


def session_routing(spark, d):
    x = _scored(spark, d).select("tenant_id", "session_id", (F.col("score") >= 0.6).alias("selected"), F.when(F.col("y") >= 0, F.col("y") == 0).alias("negative"))
    return cl.session_routing(x, ["tenant_id", "session_id"], 0.1)


def _sessions(spark, d):
    x = _scored(spark, d)
    return x.groupBy(F.concat_ws("/", "tenant_id", "session_id").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("y") >= 0).alias("known"), F.count_if(F.col("y") == 0).alias("neg"), F.max(F.col("score") >= 0.6).alias("selected"))


def prevalence_design_exact(spark, d):
    return simulation.design_exact(_sessions(spark, d), 0.1)


def prevalence_simulation(spark, d):
    return simulation.design_simulation(_sessions(spark, d), 0.1, 500)


def cluster_bootstrap(spark, d):
    g = simulation.group_confusions(_scored(spark, d), ["tenant_id", "session_id"], "y", "predicted")
    return simulation.cluster_bootstrap(g, ["tenant_id", "session_id"], 500)


def paired_bootstrap(spark, d):
    x = _scored(spark, d).withColumn("flat", F.lit(1))
    keys = ["tenant_id", "session_id"]
    a = simulation.group_confusions(x, keys, "y", "flat").withColumnRenamed("m", "old")
    b = simulation.group_confusions(x, keys, "y", "predicted").withColumnRenamed("m", "new")
    return simulation.paired_bootstrap(a.join(b, keys), keys, 500)


def char_shingles(spark, d):
    """How many of the eval_items hold each character 3- to 5-gram."""
    t = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(features.char_ngrams(F.lower("text")))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n_items"))


def tfidf_word(spark, d):
    x = table(spark, d, "eval_items")
    return features.tfidf(x, "item_id", features.word_ngrams(F.col("text")), 2, 40_000).withColumn("weight", F.round("weight", 8))


def tfidf_char(spark, d):
    x = table(spark, d, "eval_items")
    return features.tfidf(x, "item_id", features.char_ngrams(F.lower("text")), 2, 60_000).withColumn("weight", F.round("weight", 8))


def tfidf_joint(spark, d):
    """Words and characters side by side: two blocks of weights, each of length 1, not normalised together."""
    x = table(spark, d, "eval_items")
    return features.tfidf_blocks(x, "item_id", {"word": (features.word_ngrams(F.col("text")), 40_000), "char": (features.char_ngrams(F.lower("text")), 60_000)}).withColumn("weight", F.round("weight", 8))


def ablation_metrics(spark, d):
    """Metrics of yes with all rows, without unclear ones, and for rows of one split alone."""
    x = _scored(spark, d).filter("y >= 0")
    out = None
    for name, rows in (("all", x), ("without_unclear", x.filter("y <> 2")), ("calibration", x.filter("split = 'calibration'"))):
        r = cl.binary_metrics(rows, F.col("y") == 0, F.col("score"), 0.5).withColumn("variant", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def _documents(spark, d):
    return table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text").distinct()


def _lowered(spark, d):
    """Texts in lower case with runs of white space as one space, made once for each row: grams would repeat the work at every offset."""
    return table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.regexp_replace(F.lower("text"), r"(?U)\s\s+", " ").alias("text"))


def document_char_shingles(spark, d):
    """Document frequency of character 3- to 5-grams of documents in lower case."""
    t = _lowered(spark, d).distinct().select("doc_id", F.explode(F.array_distinct(features.char_ngrams(F.col("text")))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n_documents"))


def document_tfidf_word(spark, d):
    return features.tfidf(_documents(spark, d), "doc_id", features.word_ngrams(F.col("text")), 2, 40_000).withColumn("weight", F.round("weight", 8))


def document_tfidf_char(spark, d):
    return features.char_tfidf(_lowered(spark, d), "doc_id", "text", 3, 5, 2, 60_000).withColumn("weight", features.rounded("weight", 8))


def document_token_windows(spark, d):
    """Windows of 64 characters over documents with the weight of newly covered characters."""
    x = _documents(spark, d).select("doc_id", F.explode(features.token_windows(F.length("text"), 64)).alias("w"))
    return x.select("doc_id", "w.start", "w.end", "w.weight")


def linear_head_scores(spark, d):
    """Three fixed linear heads on the stored vectors."""
    dim = len(table(spark, d, "embeddings").select("embedding").first()[0])
    coef = [[((i + 1) * (k + 1) % 7 - 3) / 3 for k in range(dim)] for i in range(3)]
    x = table(spark, d, "embeddings").withColumn("z", features.linear_logits(F.col("embedding"), coef, [0.1, 0.0, -0.1]))
    return x.select("vec_id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(3)])


def weighted_pooling(spark, d):
    """Vectors pooled over owners of ten consecutive ids, weights 1 to 3; squared length and first coordinate."""
    x = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("owner"), "embedding", (F.col("vec_id") % 3 + 1).alias("w"))
    p = features.pooled(x, ["owner"], "embedding", "w")
    return p.select("owner", F.round(F.col("vector")[0], 6).alias("first"), F.round(features.dot(F.col("vector"), F.col("vector")), 6).alias("length"))


def logit_window_aggregate(spark, d):
    """Logits of four windows for each owner and class by maximum, then mean."""
    x = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("owner"), F.posexplode(F.slice("embedding", 1, 3)).alias("cls", "z")).withColumn("z", F.col("z").cast("double"))
    a = features.aggregate_logits(x, ["owner"], "cls", "z", "max").withColumnRenamed("logit", "max_logit")
    b = features.aggregate_logits(x, ["owner"], "cls", "z", "mean").withColumnRenamed("logit", "mean_logit")
    return a.join(b, ["owner", "cls"]).select("owner", "cls", F.round("max_logit", 6).alias("max_logit"), F.round("mean_logit", 6).alias("mean_logit"))


def token_windows(spark, d):
    """Windows of 64 characters over the eval items with the weight of newly covered characters."""
    x = table(spark, d, "eval_items").select("item_id", F.explode(features.token_windows(F.length("text"), 64)).alias("w"))
    return x.select("item_id", "w.start", "w.end", "w.weight")


def lr_head(spark, d):
    """A three-class head fitted on the vectors with label mod 4 - 1 (so a fourth is masked); predictions by class."""
    x = table(spark, d, "embeddings").withColumn("y", F.col("label") % 4 - 1)
    h = features.fit_head(x, "embedding", "y", c=1.0, balanced=True)
    p = x.withColumn("predicted", cl.argmax(h.probabilities(F.col("embedding"))))
    return p.groupBy("y", "predicted").agg(F.count("*").alias("n"))


def temperature_fit(spark, d):
    x = _scored(spark, d).select("logits", "y")
    return spark.createDataFrame([(features.fit_temperature(x, "logits", "y"),)], "temperature double")


def census_counts(spark, d):
    return census.task_counts(inputs(spark, d), _labels(spark, d))


def census_bounds(spark, d):
    return census.bounds(census_counts(spark, d))


def census_sessions(spark, d):
    return census.sessions_with_yes(inputs(spark, d), _labels(spark, d))


def tag_counts(spark, d):
    return census.tag_counts(_labels(spark, d))


def task_overlap(spark, d):
    return census.task_overlap(_labels(spark, d))


def target_matrix(spark, d):
    return census.target_matrix(inputs(spark, d), _labels(spark, d))


def pilot_gate(spark, d):
    return census.gate(F.col("judge_version") == VERSION, _labels(spark, d), 0.3)


_ALL = (
    pending_calls, latest_calls, call_history, call_status_counts, attempt_flatten, token_latency_summary, journal_insert, journal_merge, remaining_estimate, judge_consensus, unresolved_inputs,
    repeat_agreement, judge_confusion, judge_per_class, judge_agreement, disagreements, feedback_validation, answer_validation, softmax_probabilities, confusion3, classification_metrics, nll_brier,
    task_metrics, choose_thresholds, recall_precision_threshold, average_precision, yes_metrics, label_prior, threshold_winner, paired_outcomes, session_routing, prevalence_design_exact,
    prevalence_simulation, cluster_bootstrap, paired_bootstrap, char_shingles, tfidf_word, tfidf_char, tfidf_joint, ablation_metrics, linear_head_scores, weighted_pooling, logit_window_aggregate, token_windows, lr_head,
    document_char_shingles, document_tfidf_word, document_tfidf_char, document_token_windows,
    temperature_fit, census_counts, census_bounds, census_sessions, tag_counts, task_overlap, target_matrix, pilot_gate,
)
QUERIES = {f.__name__: f for f in _ALL}

_K = "to_json([input_id, repeat::VARCHAR])"
_J = f"""pl AS (SELECT DISTINCT input_id, repeat::INT AS repeat, sha256('["' || input_id || '","{VERSION}",' || repeat || ']') AS call_id, '{VERSION}' AS judge_version
        FROM feedback_labels, range(2) t(repeat)),
a0 AS (SELECT pl.*, dissatisfaction.label AS own FROM pl JOIN feedback_labels USING (input_id)),
a1 AS (SELECT *, {DRAW.format(ns='call-v1', key=_K)} AS u, {DRAW.format(ns='flip-v1', key=_K)} AS fl FROM a0),
f1 AS (SELECT call_id, input_id, repeat, judge_version, 1::BIGINT AS attempt_no, CASE WHEN u < 0.8 THEN 'ok' WHEN u < 0.9 THEN 'error' ELSE 'not_evaluated' END AS runtime_status, u, CASE WHEN fl < 0.1 THEN 'unclear' ELSE coalesce(own, 'no') END AS label FROM a1),
ju AS (SELECT * FROM f1 UNION ALL SELECT call_id, input_id, repeat, judge_version, 2, 'ok', u, label FROM f1 WHERE runtime_status = 'error' AND repeat = 0),
jj AS (SELECT call_id, input_id, repeat, judge_version, attempt_no, runtime_status, u, CASE WHEN runtime_status = 'ok' THEN label END AS label FROM ju),
la AS (SELECT *, count(*) OVER (PARTITION BY call_id) - 1 AS n_previous FROM jj QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY attempt_no DESC) = 1),
re AS (SELECT input_id, dissatisfaction.label AS reference FROM feedback_labels WHERE dissatisfaction.label IS NOT NULL),
pr AS (SELECT la.input_id, runtime_status, label, reference FROM re LEFT JOIN la ON la.input_id = re.input_id AND repeat = 0)"""
_ATT = """atm AS (SELECT call_id, input_id, attempt_no AS record_no, 0 AS attempt_no, runtime_status, 1 + u * attempt_no AS elapsed_seconds, 200 AS http_status, 100 + floor(u * 50)::BIGINT AS prompt_tokens,
    floor(u * 50)::BIGINT AS completion_tokens, 100 + 2 * floor(u * 50)::BIGINT AS total_tokens FROM jj)"""
_CONS = """co AS (SELECT input_id, coalesce(n_ok, 0) AS n_ok, CASE WHEN coalesce(n_ok, 0) <> 2 THEN 'incomplete' WHEN lo = hi AND nolabel = 0 THEN 'agreed' ELSE 'unresolved' END AS outcome, lo FROM (SELECT DISTINCT input_id FROM feedback_labels)
    LEFT JOIN (SELECT input_id, count(*) FILTER (runtime_status = 'ok') AS n_ok, min(label) FILTER (runtime_status = 'ok') AS lo, max(label) FILTER (runtime_status = 'ok') AS hi, count(*) FILTER (runtime_status = 'ok' AND label IS NULL) AS nolabel FROM la GROUP BY 1) USING (input_id))"""
_GRID = "gr AS (SELECT a AS truth, b AS predicted FROM (VALUES {0}) x(a), (VALUES {0}) y(b))"
_NAMES = _GRID.format("('yes'), ('no'), ('unclear')")
_CLASS = "cf AS (SELECT truth, predicted, coalesce(n, 0) AS n FROM gr LEFT JOIN (SELECT {t} AS truth, {p} AS predicted, count(*) AS n FROM {src} GROUP BY ALL) USING (truth, predicted)), pc AS (SELECT c AS class, sum(n) FILTER (truth = c) AS s, sum(n) FILTER (predicted = c) AS q, sum(n) FILTER (truth = c AND predicted = c) AS h FROM cf, (SELECT DISTINCT truth AS c FROM gr) GROUP BY c)"
_PER = "SELECT class, s::BIGINT AS support, h / nullif(q, 0) AS precision, h / nullif(s, 0) AS recall, 2 * h / nullif(s + q, 0) AS f1 FROM pc"
_IX = "CASE {0} WHEN 'yes' THEN 0 WHEN 'no' THEN 1 WHEN 'unclear' THEN 2 ELSE -1 END"
_U = [f"4 * {DRAW.format(ns=f'logit-{i}', key='to_json(input_id)')}" for i in range(3)]
_S = f"""{INPUTS}, s0 AS (SELECT input_id, tenant_id, session_id, split, {_IX.format('dissatisfaction.label')} AS y, {_IX.format('correction.label')} AS y2, [{', '.join(_U)}] AS z FROM i JOIN feedback_labels USING (input_id)),
s1 AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM s0), s2 AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s1),
sc AS (SELECT *, list_position(p, list_max(p)) - 1 AS predicted, p[1] AS score FROM s2), sk AS (SELECT * FROM sc WHERE y >= 0)"""
_NUM = _GRID.format("(0), (1), (2)")
_CONF3 = f"WITH {_S}, {_NUM}, {_CLASS.format(t='y', p='predicted', src='sk')}"
_STEP = """st AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos FROM (SELECT score, count(*) FILTER (y = 0) AS p, count(*) FILTER (y <> 0) AS q FROM sk GROUP BY 1))"""
_SES = "se AS (SELECT tenant_id || '/' || session_id AS key, count(*) AS n, count(*) FILTER (y >= 0) AS known, count(*) FILTER (y = 0) AS neg, bool_or(score >= 0.6) AS selected FROM sc GROUP BY ALL)"
_TF = """g AS (SELECT item_id, unnest({g}) AS term FROM eval_items), tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT {cap}),
w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT item_id) FROM eval_items)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 8) AS weight FROM w"""
_CHARS = "list_concat(" * 2 + ", ".join(f"list_transform(range(1, greatest(length(text) - {n - 2}, 1)), lambda i: substr(text, i, {n}))" + (")" if n > 3 else "") for n in (3, 4, 5))
_WORDS = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_LOW = "FROM (SELECT item_id, lower(text) AS text FROM eval_items)"
_CUT = "FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS ws FROM eval_items)"


def _tfidf(source: str, grams: str, cap: int, key: str = "item_id") -> str:
    table_ = "documents" if key == "doc_id" else "eval_items"
    sql = _TF.format(g=grams, cap=cap).replace("FROM eval_items), tf", f"{source}), tf").replace("count(DISTINCT item_id) FROM eval_items", f"count(DISTINCT {key}) FROM {table_}")
    return sql.replace("SELECT item_id, term, round(", f"SELECT item_id{'' if key == 'item_id' else ' AS doc_id'}, term, round(")


_TASKS = f"tc AS (SELECT t AS task, coalesce(CASE WHEN l IN ('yes', 'no', 'unclear') THEN l END, 'missing') AS label, count(*) AS n FROM (SELECT unnest(['dissatisfaction', 'correction']) AS t, unnest([dissatisfaction.label, correction.label]) AS l FROM (SELECT DISTINCT input_id FROM feedback_inputs) LEFT JOIN feedback_labels USING (input_id)) GROUP BY ALL)"
_ERR = """CASE WHEN {s} IS NULL OR {s}.label IS NULL THEN 'missing' WHEN {s}.label NOT IN ('yes', 'no', 'unclear') THEN 'wrong_label' WHEN len(coalesce({s}.evidence, [])) > 2 THEN 'too_much_evidence'
    WHEN len(list_filter(coalesce({s}.evidence, []), lambda e: e IS NULL OR length(e) < 1 OR length(e) > 240)) > 0 THEN 'empty_or_long_evidence' WHEN len(list_filter(coalesce({s}.evidence, []), lambda e: NOT coalesce(contains(text, e), false))) > 0 THEN 'evidence_not_in_text'
    WHEN {s}.label = 'yes' AND len(coalesce({s}.evidence, [])) = 0 THEN 'yes_without_evidence' END"""
_JW = f"WITH {_J}"
ORACLE = {
    "pending_calls": _JW + " SELECT call_id, input_id, repeat, judge_version FROM pl WHERE call_id NOT IN (SELECT call_id FROM la WHERE runtime_status = 'ok')",
    "latest_calls": _JW + " SELECT call_id, input_id, repeat, attempt_no, runtime_status, label, n_previous FROM la",
    "call_history": _JW + " SELECT call_id, attempt_no, runtime_status FROM jj j WHERE attempt_no < (SELECT max(attempt_no) FROM jj k WHERE k.call_id = j.call_id)",
    "call_status_counts": _JW + " SELECT runtime_status, count(*) AS n FROM la GROUP BY 1",
    "attempt_flatten": _JW + f", {_ATT} SELECT * FROM atm",
    "token_latency_summary": _JW + f""", {_ATT} SELECT count(*) AS attempts, sum(elapsed_seconds) AS seconds, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
        quantile_cont(elapsed_seconds, 0.5) AS p50_seconds, quantile_cont(elapsed_seconds, 0.95) AS p95_seconds, avg(elapsed_seconds) AS mean_seconds FROM atm""",
    "journal_insert": _JW + " SELECT call_id, repeat, runtime_status FROM jj WHERE attempt_no = 1 AND call_id NOT IN (SELECT call_id FROM jj WHERE repeat = 0)",
    "journal_merge": _JW + " SELECT runtime_status, count(*) AS n FROM jj WHERE repeat = 0 AND call_id NOT IN (SELECT call_id FROM jj WHERE attempt_no = 1 AND runtime_status IN ('ok', 'not_evaluated')) GROUP BY 1",
    "remaining_estimate": _JW + """, x AS (SELECT count(*) AS n_planned, count(*) FILTER (runtime_status IN ('ok', 'not_evaluated')) AS n_final, avg(1 + u * attempt_no) AS mean_seconds FROM la)
        SELECT *, n_planned - n_final AS n_remaining, (n_planned - n_final) * mean_seconds * 1.35 + 2400 AS estimate_seconds FROM x""",
    "judge_consensus": _JW + f", {_CONS} SELECT input_id, n_ok, outcome, CASE WHEN outcome = 'agreed' THEN lo END AS label FROM co",
    "unresolved_inputs": _JW + f", {_CONS} SELECT input_id, outcome FROM co WHERE outcome <> 'agreed'",
    "repeat_agreement": _JW + """, x AS (SELECT min(label) = max(label) AS same FROM la WHERE runtime_status = 'ok' GROUP BY input_id HAVING count(*) > 1)
        SELECT count(*) AS inputs_with_repeats, count(*) FILTER (same) AS agreeing, count(*) FILTER (same) / nullif(count(*), 0) AS fraction FROM x""",
    "judge_confusion": _JW + f", ok AS (SELECT * FROM pr WHERE runtime_status = 'ok'), {_NAMES}, {_CLASS.format(t='reference', p='label', src='ok')} SELECT * FROM cf",
    "judge_per_class": _JW + f", ok AS (SELECT * FROM pr WHERE runtime_status = 'ok'), {_NAMES}, {_CLASS.format(t='reference', p='label', src='ok')} {_PER}",
    "judge_agreement": _JW + """ SELECT count(*) AS inputs, count(*) FILTER (runtime_status = 'ok') AS ok, count(*) FILTER (runtime_status = 'ok' AND label = reference) AS agreeing,
        count(*) FILTER (runtime_status = 'ok' AND label = reference) / nullif(count(*) FILTER (runtime_status = 'ok'), 0) AS agreement_on_ok, count(*) FILTER (runtime_status = 'ok' AND label = reference) / nullif(count(*), 0) AS agreement_with_failures FROM pr""",
    "disagreements": _JW + " SELECT input_id, label, reference FROM pr WHERE runtime_status = 'ok' AND label <> reference",
    "feedback_validation": f"""WITH {INPUTS} SELECT input_id, {_ERR.format(s='dissatisfaction')} AS dissatisfaction_error, {_ERR.format(s='correction')} AS correction_error,
        CASE WHEN len(list_distinct(reason_tags)) <> len(reason_tags) THEN 'repeated_tag' WHEN len(list_filter(reason_tags, lambda t: NOT list_contains([{', '.join(f"'{t}'" for t in TAGS)}], t))) > 0 THEN 'unknown_tag'
        WHEN len(reason_tags) > 0 AND NOT (coalesce(dissatisfaction.label, '') = 'yes' OR coalesce(correction.label, '') = 'yes') THEN 'tag_without_yes' END AS tags_error FROM feedback_labels JOIN i USING (input_id)""",
    "answer_validation": f"""WITH x AS (SELECT input_id, coalesce(dissatisfaction.label, '?') AS l, {DRAW.format(ns='answer-v1', key='to_json(input_id)')} AS u FROM feedback_labels)
        SELECT input_id, CASE WHEN u < 0.1 THEN 'not_json' WHEN u < 0.2 THEN 'wrong_keys' WHEN l NOT IN ('yes', 'no', 'unclear') THEN 'wrong_label' END AS error FROM x""",
    "softmax_probabilities": f"WITH {_S} SELECT input_id, p[1] AS p0, p[2] AS p1, p[3] AS p2, predicted FROM sc",
    "confusion3": _CONF3 + " SELECT * FROM cf",
    "classification_metrics": _CONF3 + """, ag AS (SELECT sum(n)::BIGINT AS messages, sum(n) FILTER (truth = predicted) / nullif(sum(n), 0) AS agreement FROM cf)
        SELECT 'zero_division' AS convention, messages, agreement, (SELECT avg(coalesce(2 * h / nullif(s + q, 0), 0)) FROM pc) AS macro_f1 FROM ag UNION ALL SELECT 'observed', messages, agreement, (SELECT avg(2 * h / nullif(s + q, 0)) FROM pc) FROM ag""",
    "nll_brier": f"WITH {_S} SELECT count(*) AS messages, avg(-ln(greatest(p[y + 1], 1e-12))) AS nll, avg(p[1] * p[1] + p[2] * p[2] + p[3] * p[3] - 2 * p[y + 1] + 1) AS brier FROM sk",
    "task_metrics": " UNION ALL ".join(
        f"(WITH {_S}, {_NUM}, tk AS (SELECT * FROM sc WHERE {y} >= 0), {_CLASS.format(t=y, p='predicted', src='tk')} SELECT '{t}' AS task, (SELECT sum(n)::BIGINT FROM cf) AS messages, (SELECT sum(n) FILTER (truth = predicted) / nullif(sum(n), 0) FROM cf) AS agreement, (SELECT avg(coalesce(2 * h / nullif(s + q, 0), 0)) FROM pc) AS macro_f1, (SELECT coalesce(2 * h / nullif(s + q, 0), 0) FROM pc WHERE class = 0) AS yes_f1)"
        for t, y in (("dissatisfaction", "y"), ("correction", "y2"))
    ),
    "choose_thresholds": f"WITH {_S}, {_STEP} SELECT target::DOUBLE AS target, max(score) AS threshold, arg_max(tp, score) / arg_max(pos, score) AS recall, (arg_max(tp, score) + arg_max(fp, score))::BIGINT AS n_selected FROM st, (VALUES (0.5), (0.8), (0.95), (1.0)) t(target) WHERE tp >= target * pos - 1e-9 GROUP BY target",
    "recall_precision_threshold": f"WITH {_S}, {_STEP} SELECT score AS threshold, tp / (tp + fp) AS precision, (tp + fp)::BIGINT AS n_selected FROM st WHERE tp >= 0.8 * pos - 1e-9 ORDER BY precision DESC, score DESC LIMIT 1",
    "average_precision": f"""WITH {_S}, q AS (SELECT split, score, count(*) FILTER (y = 0) AS p, count(*) FILTER (y <> 0) AS q FROM sk GROUP BY ALL),
        st AS (SELECT split, p, sum(p) OVER (PARTITION BY split ORDER BY score DESC) AS tp, sum(q) OVER (PARTITION BY split ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY split) AS pos FROM q)
        SELECT split, sum(p / pos * tp / (tp + fp)) AS average_precision FROM st WHERE pos > 0 GROUP BY split""",
    "yes_metrics": f"""WITH {_S}, x AS (SELECT count(*) FILTER (y = 0 AND score >= 0.5) AS tp, count(*) FILTER (y <> 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 0 AND score < 0.5) AS fn FROM sk)
        SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM x""",
    "label_prior": """SELECT c AS class, coalesce(n, 0) AS n, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER () + 3) AS prior FROM (VALUES ('yes'), ('no'), ('unclear')) v(c)
        LEFT JOIN (SELECT dissatisfaction.label AS c, count(*) AS n FROM feedback_labels GROUP BY 1) USING (c)""",
    "threshold_winner": f"""WITH {_S}, x AS (SELECT t / 10.0::DOUBLE AS threshold, count(*) FILTER (y = 0 AND score >= t / 10.0::DOUBLE) AS tp, count(*) FILTER (y <> 0 AND score >= t / 10.0::DOUBLE) AS fp, count(*) FILTER (y = 0 AND score < t / 10.0::DOUBLE) AS fn
        FROM sk, range(1, 10) r(t) GROUP BY 1) SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM x ORDER BY f1 DESC, threshold DESC LIMIT 1""",
    "paired_outcomes": f'WITH {_S} SELECT count(*) FILTER (y = 1 AND predicted = y) AS "both", count(*) FILTER (y = 1 AND predicted <> y) AS only_old, count(*) FILTER (y <> 1 AND predicted = y) AS only_new, count(*) FILTER (y <> 1 AND predicted <> y) AS neither FROM sk',
    "session_routing": f"""WITH {_S}, x AS (SELECT count(*) AS n, bool_or(score >= 0.6) AS routed, count(*) FILTER (y = 0) AS neg, count(*) FILTER (y < 0) AS miss, count(*) FILTER (y = 0 AND score >= 0.6) AS hit, count(*) FILTER (y >= 0 AND score >= 0.6) AS sel FROM sc GROUP BY tenant_id, session_id),
        t AS (SELECT sum(n)::BIGINT AS n, sum(miss)::BIGINT AS miss, count(*) AS s, count(*) FILTER (routed) AS rs, coalesce(sum(n) FILTER (routed), 0)::BIGINT AS rn, count(*) FILTER (neg > 0) AS ps, count(*) FILTER (neg > 0 AND routed) AS prs, sum(neg)::BIGINT AS neg, coalesce(sum(neg) FILTER (routed), 0)::BIGINT AS rneg, sum(hit)::BIGINT AS hit, sum(sel)::BIGINT AS sel FROM x)
        SELECT n AS eligible_messages, miss AS unknown_messages, s AS sessions, rs AS routed_sessions, rn AS session_routed_messages, hit / nullif(neg, 0) AS message_recall, hit / nullif(sel, 0) AS message_precision, rn / nullif(n, 0) AS routed_fraction,
        prs / nullif(ps, 0) AS session_recall, rneg / nullif(neg, 0) AS message_coverage, (rneg + 0.1 * (neg - rneg))::DOUBLE / nullif(neg, 0) AS expected_coverage, (rn + 0.1 * (n - rn))::DOUBLE AS expected_calls, rneg / nullif(neg + miss, 0) AS coverage_low, (rneg + miss) / nullif(neg + miss, 0) AS coverage_high FROM t""",
    "prevalence_design_exact": f"""WITH {_S}, {_SES}, pi AS (SELECT *, (CASE WHEN selected THEN 1.0 ELSE 0.1 END)::DOUBLE AS pi FROM se), eq AS (SELECT sum(pi * n) / sum(n) AS e FROM pi),
        d AS (SELECT unnest(['teacher_census', 'random_audit_rate', 'cascade_with_audit', 'random_equal_expected_calls']) AS design, unnest([1.0::DOUBLE, 0.1::DOUBLE, pi, e]) AS pi, n, known, neg FROM pi, eq)
        SELECT design, sum(neg) / nullif(sum(known), 0) AS truth, sum(pi * n) AS expected_calls, sqrt(sum((1 - pi) / pi * neg * neg)) / nullif(sum(known), 0) AS standard_error FROM d GROUP BY 1""",
    "char_shingles": f"SELECT gram, count(*) AS n_items FROM (SELECT item_id, unnest(list_distinct({_CHARS})) AS gram {_LOW}) GROUP BY 1",
    "tfidf_word": "WITH " + _tfidf(_CUT, _WORDS, 40_000),
    "tfidf_char": "WITH " + _tfidf(_LOW, _CHARS, 60_000),
    "tfidf_joint": f"SELECT 'word' AS block, * FROM (WITH {_tfidf(_CUT, _WORDS, 40_000)}) UNION ALL SELECT 'char', * FROM (WITH {_tfidf(_LOW, _CHARS, 60_000)})",
    "document_tfidf_word": "WITH " + _tfidf(_CUT.replace("item_id", "doc_id AS item_id").replace("eval_items", "documents"), _WORDS, 40_000, "doc_id"),
    "document_token_windows": """SELECT doc_id, s::INT AS start, least(s + 64, length(text))::INT AS "end", (least(s + 64, length(text)) - s)::INT AS weight FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 64)) AS s FROM documents WHERE text IS NOT NULL)""",
    "ablation_metrics": " UNION ALL ".join(f"""(WITH {_S}, x AS (SELECT count(*) FILTER (y = 0 AND score >= 0.5) AS tp, count(*) FILTER (y <> 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 0 AND score < 0.5) AS fn FROM sk WHERE {w})
        SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1, '{v}' AS variant FROM x)""" for v, w in (("all", "true"), ("without_unclear", "y <> 2"), ("calibration", "split = 'calibration'"))),
    "linear_head_scores": "SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: embedding[k]::DOUBLE * (({i} + 1) * k % 7 - 3) / 3)) + {b}, 6) AS z{i}" for i, b in ((0, 0.1), (1, 0.0), (2, -0.1))) + " FROM embeddings",
    "weighted_pooling": """WITH u AS (SELECT vec_id // 10 AS owner, vec_id % 3 + 1 AS w, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
        s AS (SELECT owner, i, sum(w * v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY ALL), l AS (SELECT owner, sqrt(sum(x * x)) AS n, max(x) FILTER (i = 1) AS f FROM s GROUP BY 1) SELECT owner, round(f / n, 6) AS first, 1.0::DOUBLE AS length FROM l""",
    "logit_window_aggregate": "SELECT vec_id // 4 AS owner, (i - 1)::INT AS cls, round(max(embedding[i]::DOUBLE), 6) AS max_logit, round(avg(embedding[i]::DOUBLE), 6) AS mean_logit FROM embeddings, range(1, 4) r(i) GROUP BY ALL",
    "token_windows": """SELECT item_id, s::INT AS start, least(s + 64, length(text))::INT AS "end", (least(s + 64, length(text)) - s)::INT AS weight FROM (SELECT item_id, text, unnest(range(0, greatest(length(text), 1), 64)) AS s FROM eval_items WHERE text IS NOT NULL)""",
    "census_counts": f"WITH {_TASKS} SELECT * FROM tc",
    "census_bounds": f"""WITH {_TASKS}, g AS (SELECT task, sum(n) AS t, coalesce(sum(n) FILTER (label = 'yes'), 0) AS y, coalesce(sum(n) FILTER (label = 'no'), 0) AS no, coalesce(sum(n) FILTER (label IN ('unclear', 'missing')), 0) AS o FROM tc GROUP BY 1)
        SELECT task, t::BIGINT AS n_inputs, (y + no)::BIGINT AS known, y / nullif(y + no, 0) AS yes_fraction, y / nullif(t, 0) AS low, (y + o) / nullif(t, 0) AS high FROM g""",
    "census_sessions": f"""WITH {INPUTS}, x AS (SELECT input_id, unnest(['dissatisfaction', 'correction']) AS task, unnest([dissatisfaction.label, correction.label]) AS l FROM feedback_labels)
        SELECT task, count(DISTINCT (tenant_id, session_id)) AS sessions, count(DISTINCT input_id) AS messages FROM x JOIN i USING (input_id) WHERE l = 'yes' GROUP BY 1""",
    "tag_counts": "SELECT tag, count(*) AS n FROM (SELECT unnest(reason_tags) AS tag FROM feedback_labels) GROUP BY 1",
    "task_overlap": "SELECT dissatisfaction.label AS dissatisfaction_label, correction.label AS correction_label, count(*) AS n FROM feedback_labels WHERE dissatisfaction.label IS NOT NULL AND correction.label IS NOT NULL GROUP BY ALL",
    "target_matrix": f"SELECT DISTINCT input_id, {_IX.format('dissatisfaction.label')} AS y_dissatisfaction, {_IX.format('correction.label')} AS y_correction FROM feedback_inputs LEFT JOIN feedback_labels USING (input_id)",
    "pilot_gate": f"SELECT count(*) AS n, count(*) FILTER (judge_version = '{VERSION}') AS valid, count(*) FILTER (judge_version = '{VERSION}') / nullif(count(*), 0) AS fraction, coalesce(count(*) FILTER (judge_version = '{VERSION}') / nullif(count(*), 0) >= 0.3, false) AS passed FROM feedback_labels",
}
