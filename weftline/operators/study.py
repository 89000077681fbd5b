"""Selection among candidates, tuning summaries, calibration by task, frozen winners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.classification import softmax, winner
from weftline.operators.features import Head, fit_head

# what decides between candidates, in this order; the name makes ties have one answer
STUDENT = (F.desc, "macro_f1"), (F.desc, "agreement"), (F.asc, "bytes"), (F.asc, "name")
FEEDBACK = (F.desc, "macro_f1"), (F.desc, "yes_f1"), (F.asc, "bytes"), (F.asc, "name")
NAMED = (F.desc, "macro_f1"), (F.asc, "name")
GRID = (F.desc, "macro_f1"), (F.desc, "agreement"), (F.asc, "c"), (F.asc, "balanced"), (F.asc, "name")


def best(candidates: DataFrame, rule: Sequence[tuple]) -> DataFrame:
    """The first candidate by a rule; null and NaN metrics come last, an empty table has no winner."""
    kinds = dict(candidates.dtypes)
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    order = [F.desc_nulls_last(f"__o{i}") if way is F.desc else F.asc_nulls_last(f"__o{i}") for i, (way, _) in enumerate(rule)]
    return winner(candidates.select("*", *[value(c).alias(f"__o{i}") for i, (_, c) in enumerate(rule)]), *order).select(*candidates.columns)


def best_in_group(candidates: DataFrame, group: str, rule: Sequence[tuple]) -> DataFrame:
    """The first candidate of each group by a rule of numeric metrics and a name at its end: one aggregate, no sort."""
    score = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))) if way is F.desc else -F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for way, c in rule[:-1]]
    name = rule[-1][1]
    # of equal scores the smallest name: the set of the best is reduced once more
    top = candidates.groupBy(group).agg(F.max(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])).alias("__top"))
    same = candidates.withColumn("__own", F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])).join(top, group).filter("__own = __top")
    return same.groupBy(group).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != group]), name).alias("__w")).select(group, "__w.*")


def union_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Candidate tables of several families as one, with the family; columns that a family lacks are null."""
    out = None
    for family, t in sorted(tables.items()):
        t = t.withColumn("family", F.lit(family))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def tuning_summary(answers: DataFrame, references: DataFrame, candidate: str = "candidate") -> DataFrame:
    """(candidate, inputs, answered, coverage, accuracy_on_answered, accuracy_on_all): answers (candidate, input_id, label), null for a failure.

    Every candidate is measured on all references: an input that it failed on or never saw is a wrong answer in the last column.
    """
    n = references.select("input_id", "reference").dropna().dropDuplicates(["input_id"])
    j = answers.filter("label IS NOT NULL").groupBy(candidate, "input_id").agg(F.min("label").alias("label")).join(n, "input_id")
    g = j.groupBy(candidate).agg(F.count("*").alias("answered"), F.count_if(F.col("label") == F.col("reference")).alias("right"))
    all_ = answers.select(candidate).distinct().join(g, candidate, "left").fillna(0, ["answered", "right"])
    r = all_.crossJoin(F.broadcast(n.agg(F.count("*").alias("inputs"))))  # one row
    return r.select(
        candidate, "inputs", "answered", F.try_divide("answered", "inputs").alias("coverage"), F.try_divide("right", "answered").alias("accuracy_on_answered"), F.try_divide("right", "inputs").alias("accuracy_on_all")
    )


def best_prompt(summary: DataFrame, least: float, candidate: str = "candidate") -> DataFrame:
    """Among candidates that answer at least that share of the inputs the most accurate on all of them (ties: coverage, name)."""
    return winner(summary.filter(F.col("coverage") >= least), F.desc("accuracy_on_all"), F.desc("coverage"), F.col(candidate))


def stratified_gain(outcomes: DataFrame, stratum: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(gain, low, high, replicates): new minus old accuracy with a 95 % interval from resampling rows inside each stratum.

    outcomes: (stratum, old, new) as booleans. A row has one of three values, gain, loss or no change, so a resample of a
    stratum is a multinomial draw from three counts: the driver holds three numbers for each stratum, whatever the rows are.
    """
    value = F.col("new").cast("int") - F.col("old").cast("int")
    cells = outcomes.filter(F.col(stratum).isNotNull() & F.col("old").isNotNull() & F.col("new").isNotNull()).groupBy(stratum).agg(F.count_if(value > 0).alias("up"), F.count_if(value < 0).alias("down"), F.count("*").alias("n"))
    rows = cells.orderBy(stratum).collect()
    total = sum(r["n"] for r in rows)
    schema = "gain double, low double, high double, replicates int"
    if not total:
        return outcomes.sparkSession.createDataFrame([(None, None, None, replicates)], schema)
    rng = np.random.default_rng(seed)
    drawn = np.zeros(replicates)
    for r in rows:
        x = rng.multinomial(r["n"], np.array([r["up"], r["down"], r["n"] - r["up"] - r["down"]]) / r["n"], replicates)
        drawn += x[:, 0] - x[:, 1]
    low, high = np.quantile(drawn / total, [0.025, 0.975])
    gain = sum(r["up"] - r["down"] for r in rows) / total
    return outcomes.sparkSession.createDataFrame([(float(gain), float(low), float(high), replicates)], schema)


def task_temperatures(df: DataFrame, low: float = 0.25, high: float = 4.0, grid: int = 16, rounds: int = 4) -> dict[str, float]:
    """Temperature of each task from (task, logits, label); rows with a null or negative label are masked. 1 where none is better.

    All tasks share a pass: a round is one aggregate by task over a grid that narrows around each task's own best value.
    """
    d = df.filter("label >= 0").select("task", "logits", F.col("label").cast("int").alias("label"))

    def losses(points: Mapping[str, list[float]]) -> dict[str, list[float]]:
        spark = df.sparkSession
        x = d.join(F.broadcast(spark.createDataFrame(list(points.items()), "task string, ts array<double>")), "task")  # a row for each task
        width = len(next(iter(points.values())))
        loss = [F.avg(-F.ln(F.greatest(F.element_at(softmax(F.col("logits"), F.col("ts")[i]), F.col("label") + 1), F.lit(1e-12)))).alias(f"l{i}") for i in range(width)]
        return {r["task"]: list(r)[1:] for r in x.groupBy("task").agg(*loss).collect()}

    tasks = [r["task"] for r in d.select("task").distinct().collect()]
    if not tasks:
        return {}
    one = losses({t: [1.0] for t in tasks})
    best_ = {t: (one[t][0], 1.0) for t in tasks}
    span = {t: (low, high) for t in tasks}
    for _ in range(rounds):
        points = {t: np.exp(np.linspace(np.log(a), np.log(b), grid)).tolist() for t, (a, b) in span.items()}
        for t, ls in losses(points).items():
            i = int(np.argmin(ls))
            if ls[i] < best_[t][0] - 1e-12:
                best_[t] = (ls[i], points[t][i])
            span[t] = (points[t][max(0, i - 1)], points[t][min(grid - 1, i + 1)])
    return {t: b for t, (_, b) in best_.items()}


def grid_search(train: DataFrame, check: DataFrame, vector: str, label: str, cs: Sequence[float] = (0.1, 1.0, 10.0), n_classes: int = 3) -> tuple[DataFrame, dict[str, Head]]:
    """(table of candidates, heads by name): a head for each C, balanced or not, measured on other rows; best(table, GRID) names the winner."""
    from weftline.operators.classification import agreement, argmax, confusion

    rows, heads = [], {}
    for c in cs:
        for balanced in (False, True):
            name = f"lr_c{c:g}{'_balanced' if balanced else ''}"
            h = heads[name] = fit_head(train, vector, label, c, n_classes, balanced)
            x = check.filter(F.col(label) >= 0).withColumn("__p", argmax(h.probabilities(F.col(vector)))).select(F.col(label).cast("int").alias("y"), "__p")
            m = agreement(confusion(x, "y", "__p", tuple(range(n_classes))), True).first()
            rows.append((name, float(c), int(balanced), m["messages"], m["agreement"], m["macro_f1"]))
    return train.sparkSession.createDataFrame(rows, "name string, c double, balanced int, messages long, agreement double, macro_f1 double"), heads


def drift(df: DataFrame, dims: Sequence[str], half: str) -> DataFrame:
    """(dimension, value, n_before, n_after, share_before, share_after, change) of each value of each dimension between two halves ('before', 'after')."""
    x = df.select(half, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in dims])).alias("x")).select(half, "x.*")
    g = x.groupBy("dimension", "value").agg(F.count_if(F.col(half) == "before").alias("n_before"), F.count_if(F.col(half) == "after").alias("n_after"))
    t = g.groupBy(F.col("dimension").alias("__d")).agg(F.sum("n_before").alias("__b"), F.sum("n_after").alias("__a"))
    j = g.join(F.broadcast(t), F.col("dimension") == F.col("__d"))  # a row for each dimension
    before, after = F.coalesce(F.try_divide("n_before", "__b"), F.lit(0.0)), F.coalesce(F.try_divide("n_after", "__a"), F.lit(0.0))
    return j.select("dimension", "value", "n_before", "n_after", before.alias("share_before"), after.alias("share_after"), (after - before).alias("change"))


def routing_growth(share: Column | float, messages: Column) -> Column:
    """Share of sessions of so many messages that are routed if each message is selected with `share`, independently: 1 - (1 - share) ** messages."""
    return 1 - F.pow(1 - (F.lit(share) if isinstance(share, float) else share), messages)
