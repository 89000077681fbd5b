"""Classification metrics, thresholds and selections from long tables of labels and scores.

Two conventions of macro-F1 are kept apart: the report's, where a class without predictions and labels has no F1 and is
left out of the mean, and the student's, where 0/0 is 0 and every class counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import running_sums


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Probabilities of an array of logits, shifted by the maximum."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(709.0)), F.lit(-709.0))))


def argmax(p: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """(truth, predicted, n) over the full grid of classes; rows with a null on either side or another class don't count."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], f"truth {dict(df.dtypes)[truth]}, predicted {dict(df.dtypes)[predicted]}")
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(n, ["truth", "predicted"], "left").fillna(0, ["n"])  # classes squared


def per_class(conf: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) with nulls for 0/0."""
    side = conf.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
                                         F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    g = side.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    return g.select(
        "class", "support", F.try_divide("hits", "predicted").alias("precision"), F.try_divide("hits", "support").alias("recall"),
        F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def agreement(conf: DataFrame, zero_division: bool) -> DataFrame:
    """(messages, agreement, macro_f1); with zero_division every class counts and 0/0 is 0, else classes without F1 are left out."""
    f = F.coalesce("f1", F.lit(0.0)) if zero_division else F.col("f1")
    m = per_class(conf).agg(F.avg(f).alias("macro_f1"))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    return conf.agg(F.sum("n").alias("messages"), F.try_divide(F.sum(hit), F.sum("n")).alias("agreement")).crossJoin(F.broadcast(m))  # one row each


def log_loss_and_brier(df: DataFrame, truth: str, p: str) -> DataFrame:
    """(messages, nll, brier) of a 0-based class column and an array of probabilities; rows with a null or negative class are left out."""
    d = df.filter(F.col(truth) >= 0)
    own = F.element_at(p, F.col(truth).cast("int") + 1)
    sq = F.aggregate(F.col(p), F.lit(0.0), lambda a, x: a + x * x)
    return d.agg(F.count("*").alias("messages"), F.avg(-F.ln(F.least(F.greatest(own, F.lit(1e-12)), F.lit(1.0)))).alias("nll"), F.avg(sq - 2 * own + 1).alias("brier"))


def binary_metrics(df: DataFrame, positive: Column, score: Column, threshold: float) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) at score >= threshold; here 0/0 is 0."""
    hit = score >= threshold
    r = df.agg(F.count_if(positive & hit).alias("tp"), F.count_if(~positive & hit).alias("fp"), F.count_if(positive & ~hit).alias("fn"))
    one = lambda c: F.greatest(c, F.lit(1))
    return r.withColumns({"precision": F.col("tp") / one(F.col("tp") + F.col("fp")), "recall": F.col("tp") / one(F.col("tp") + F.col("fn")), "f1": 2 * F.col("tp") / one(2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def score_steps(df: DataFrame, positive: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, hits, tp, fp, positives): positives at each distinct score and cumulative counts, descending; ties fall in one step.

    Null and NaN scores are left out. The running sums come from range partitions, so one group may have any number of scores.
    """
    d = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(positive).alias("hits"), F.count_if(~positive).alias("misses"))
    r = running_sums(d, by, [F.desc("score")], ["hits", "misses"]).withColumnsRenamed({"run_hits": "tp", "run_misses": "fp"})
    if not by:
        return r.crossJoin(F.broadcast(d.agg(F.sum("hits").alias("positives")))).select("score", "hits", "tp", "fp", "positives")  # one row
    total = r.groupBy(*[F.col(b).alias(f"__k_{b}") for b in by]).agg(F.max("tp").alias("positives"))
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return r.join(total, cond).select(*by, "score", "hits", "tp", "fp", "positives")


def average_precision(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision): sum of recall gains times precision; null without positives."""
    d = steps.filter("positives > 0").withColumn("__x", F.col("hits") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return d.groupBy(*by).agg(F.sum("__x").alias("average_precision"))


def recall_thresholds(steps: DataFrame, recalls: Sequence[float]) -> DataFrame:
    """(target, threshold, recall, n_selected): for each target recall the largest score that reaches it."""
    t = steps.withColumn("target", F.explode(F.array(*[F.lit(float(r)) for r in recalls]))).filter((F.col("positives") > 0) & (F.col("tp") >= F.col("target") * F.col("positives") - 1e-9))
    best = t.groupBy("target").agg(F.max(F.struct("score", "tp", "fp", "positives")).alias("x"))
    return best.select("target", F.col("x.score").alias("threshold"), (F.col("x.tp") / F.col("x.positives")).alias("recall"), (F.col("x.tp") + F.col("x.fp")).alias("n_selected"))


def precise_threshold(steps: DataFrame, recall: float) -> DataFrame:
    """(threshold, precision, n_selected): among scores with at least that recall the highest precision, then the highest score."""
    t = steps.filter((F.col("positives") > 0) & (F.col("tp") >= recall * F.col("positives") - 1e-9)).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    x = t.agg(F.max(F.struct("precision", "score", "tp", "fp")).alias("x")).filter("x IS NOT NULL")
    return x.select(F.col("x.score").alias("threshold"), F.col("x.precision").alias("precision"), (F.col("x.tp") + F.col("x.fp")).alias("n_selected"))


def winner(candidates: DataFrame, *order: Column) -> DataFrame:
    """The first row in the given order; the caller ends it with a name so ties have one answer."""
    return candidates.orderBy(*order).limit(1)


def paired_outcomes(df: DataFrame, truth: str, old: str, new: str) -> DataFrame:
    """(both, only_old, only_new, neither): correct answers of two systems on the same rows; null answers are wrong and stay in."""
    a, b = F.coalesce(F.col(old) == F.col(truth), F.lit(False)), F.coalesce(F.col(new) == F.col(truth), F.lit(False))
    return df.filter(F.col(truth).isNotNull()).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_old"), F.count_if(~a & b).alias("only_new"), F.count_if(~a & ~b).alias("neither"))


def label_prior(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """(class, n, prior): Laplace-smoothed class shares; the majority baseline is the largest."""
    n = df.filter(F.col(label).isin(*classes)).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    d = F.broadcast(grid).join(n, "class", "left").fillna(0, ["n"])  # the classes
    return d.withColumn("prior", (F.col("n") + 1) / (F.sum("n").over(Window.partitionBy()) + len(classes)))


def session_routing(df: DataFrame, session: list[str], audit_rate: float) -> DataFrame:
    """One row of session-level routing; df: session columns, selected (bool), negative (bool, null if unknown).

    A session is routed as a whole if any message is selected; other sessions are audited at audit_rate. Coverage bounds
    take unknown answers as all covered negatives or all uncovered ones.
    """
    s = df.groupBy(*session).agg(
        F.count("*").alias("n"), F.max("selected").alias("routed"), F.count_if(F.col("negative")).alias("neg"), F.count_if(F.col("negative").isNull()).alias("miss"),
        F.count_if(F.col("selected") & F.col("negative")).alias("hit"), F.count_if(F.col("selected") & F.col("negative").isNotNull()).alias("sel"),
    )
    on = lambda c: F.coalesce(F.sum(F.when(F.col("routed"), F.col(c)).otherwise(0)), F.lit(0))
    t = s.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_messages"), F.coalesce(F.sum("miss"), F.lit(0)).alias("unknown_messages"), F.count("*").alias("sessions"), F.count_if("routed").alias("routed_sessions"),
        on("n").alias("session_routed_messages"), F.count_if(F.col("neg") > 0).alias("__ps"), F.count_if((F.col("neg") > 0) & F.col("routed")).alias("__rs"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("__neg"), on("neg").alias("__rneg"), F.coalesce(F.sum("hit"), F.lit(0)).alias("__hit"), F.coalesce(F.sum("sel"), F.lit(0)).alias("__sel"),
    )
    c = F.col
    return t.select(
        "eligible_messages", "unknown_messages", "sessions", "routed_sessions", "session_routed_messages", F.try_divide("__hit", "__neg").alias("message_recall"),
        F.try_divide("__hit", "__sel").alias("message_precision"), F.try_divide("session_routed_messages", "eligible_messages").alias("routed_fraction"),
        F.try_divide("__rs", "__ps").alias("session_recall"), F.try_divide("__rneg", "__neg").alias("message_coverage"),
        F.try_divide(c("__rneg") + audit_rate * (c("__neg") - c("__rneg")), c("__neg")).alias("expected_coverage"),
        (c("session_routed_messages") + audit_rate * (c("eligible_messages") - c("session_routed_messages"))).alias("expected_calls"),
        F.try_divide("__rneg", c("__neg") + c("unknown_messages")).alias("coverage_low"), F.try_divide(c("__rneg") + c("unknown_messages"), c("__neg") + c("unknown_messages")).alias("coverage_high"),
    )
