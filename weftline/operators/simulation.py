"""Resampling and design-based simulation from group totals.

Groups are reduced to small totals in Spark. Draws are hashes of (seed, replicate, group), so a replicate is the same on
every cluster and no group list has to fit one machine: each task draws for its groups and only sums are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_confusions(df: DataFrame, group: list[str], truth: str, predicted: str) -> DataFrame:
    """(group, m): the flattened 3 x 3 confusion counts of each group; classes are 0, 1, 2, other rows are left out."""
    cell = F.col(truth) * 3 + F.col(predicted)
    d = df.filter(F.col(truth).between(0, 2) & F.col(predicted).between(0, 2))
    return d.groupBy(*group).agg(F.array(*[F.count_if(cell == k) for k in range(9)]).alias("m"))


def _uniforms(keys: np.ndarray, seed: int, replicates: int) -> np.ndarray:
    """Draws in [0, 1) by (key, replicate): 53 bits of a mixed counter, made for all keys at once."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        for salt in (np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95), np.uint64(0)):
            x = x + salt
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) * 2.0**-53


# distribution function of a Poisson variable with mean 1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _weights(keys: np.ndarray, seed: int, replicates: int) -> np.ndarray:
    """Poisson(1) multiplicities by (key, replicate): a bootstrap whose draws need no knowledge of the other groups."""
    return np.searchsorted(_POISSON, _uniforms(keys, seed, replicates), side="right")


def _replicated(groups: DataFrame, cols: list[str], key: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, sums of cols times the replicate's multiplicities)."""
    g = groups.select(F.xxhash64(*key).alias("__k"), *cols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for start in range(0, len(f), 2000):
                part = f.iloc[start : start + 2000]
                w = _weights(part["__k"].to_numpy().view(np.uint64), seed, replicates)
                s = w.T @ np.stack([np.concatenate([np.atleast_1d(x) for x in row]) for row in part[cols].itertuples(index=False, name=None)])
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"replicate": np.arange(replicates), "s": list(total.astype(float))})

    parts = g.mapInPandas(run, "replicate int, s array<double>").select("replicate", F.posexplode("s").alias("i", "x"))
    sums = parts.groupBy("replicate", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select("replicate", F.transform("a", lambda e: e.x).alias("s"))  # a few sums


def _metrics(s: np.ndarray) -> dict[str, np.ndarray]:
    m = s.reshape(-1, 3, 3)
    diag = np.diagonal(m, axis1=1, axis2=2)
    both = m.sum(axis=1) + m.sum(axis=2)
    n, support = m.sum(axis=(1, 2)), m[:, 0].sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"agreement": diag.sum(axis=1) / n, "macro_f1": np.where(both > 0, 2 * diag / np.maximum(both, 1), 0).mean(axis=1), "recall0": np.where(support > 0, diag[:, 0] / support, np.nan)}


def cluster_bootstrap(groups: DataFrame, key: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, low, high, replicates): 95 % percentile intervals of agreement, macro-F1 (0/0 is 0) and class-0 recall, resampling whole groups.

    groups: group_confusions(). Multiplicities are Poisson(1), the limit of resampling many groups with replacement.
    """
    rows = _replicated(groups, ["m"], key, replicates, seed).orderBy("replicate").collect()  # one row a replicate
    return _intervals(groups, _metrics(np.array([r["s"] for r in rows])) if rows else {}, replicates)


def paired_bootstrap(groups: DataFrame, key: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Intervals of the difference new minus old; groups: (key, old, new) with two flattened confusions over the same rows."""
    rows = _replicated(groups, ["old", "new"], key, replicates, seed).orderBy("replicate").collect()
    if not rows:
        return _intervals(groups, {}, replicates)
    s = np.array([r["s"] for r in rows])
    a, b = _metrics(s[:, :9]), _metrics(s[:, 9:])
    return _intervals(groups, {f"delta_{k}": b[k] - a[k] for k in a}, replicates)


def _intervals(df: DataFrame, values: dict[str, np.ndarray], replicates: int) -> DataFrame:
    out = []
    for k, v in values.items():
        v = v[np.isfinite(v)]
        lo, hi = (float(x) for x in np.quantile(v, [0.025, 0.975])) if len(v) else (None, None)
        out.append((k, lo, hi, replicates))
    return df.sparkSession.createDataFrame(out, "metric string, low double, high double, replicates int")


def designs(sessions: DataFrame, audit_rate: float) -> DataFrame:
    """(design, key, pi, neg, known, n): inclusion probabilities of every session under four designs.

    sessions: key, n, known, neg, selected. The equal-budget design has the cascade's expected number of calls.
    """
    pi = F.when(F.col("selected"), 1.0).otherwise(audit_rate)
    rate = sessions.agg(F.try_divide(F.sum(pi * F.col("n")), F.sum("n")).alias("__rate"))
    x = sessions.crossJoin(F.broadcast(rate))  # one row
    kinds = {"teacher_census": F.lit(1.0), "random_audit_rate": F.lit(float(audit_rate)), "cascade_with_audit": pi, "random_equal_expected_calls": F.col("__rate")}
    return x.withColumn("d", F.explode(F.array(*[F.struct(F.lit(k).alias("design"), v.alias("pi")) for k, v in kinds.items()]))).select("d.design", "key", "d.pi", "neg", "known", "n")


def design_exact(sessions: DataFrame, audit_rate: float) -> DataFrame:
    """(design, truth, expected_calls, standard_error): exact moments of the Horvitz-Thompson share over known answers."""
    d = designs(sessions, audit_rate)
    r = d.groupBy("design").agg(F.sum(F.col("pi") * F.col("n")).alias("expected_calls"), F.sum((1 - F.col("pi")) / F.col("pi") * F.col("neg") * F.col("neg")).alias("__v"), F.sum("neg").alias("__neg"), F.sum("known").alias("__known"))
    return r.select("design", F.try_divide("__neg", "__known").alias("truth"), "expected_calls", F.try_divide(F.sqrt("__v"), "__known").alias("standard_error"))


def design_simulation(sessions: DataFrame, audit_rate: float, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(design, mean_estimate, bias, rmse, coverage, mean_calls, zero_fraction) over Bernoulli samples of whole sessions."""
    d = designs(sessions, audit_rate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for design, g in f.groupby("design"):
                est, var, calls = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
                for start in range(0, len(g), 2000):
                    p = g.iloc[start : start + 2000]
                    pi, neg, n = (p[c].to_numpy(dtype=float) for c in ("pi", "neg", "n"))
                    seen = (_uniforms(p["k"].to_numpy().view(np.uint64), seed, replicates) < pi[:, None]).T.astype(float)
                    est += seen @ (neg / pi)
                    var += seen @ ((1 - pi) / pi**2 * neg**2)
                    calls += seen @ n
                yield pd.DataFrame({"design": design, "replicate": np.arange(replicates), "est": est, "var": var, "calls": calls})

    sums = d.withColumn("k", F.xxhash64("design", "key")).select("design", "k", "pi", "neg", "n").mapInPandas(run, "design string, replicate int, est double, var double, calls double")
    sums = sums.groupBy("design", "replicate").agg(F.sum("est").alias("est"), F.sum("var").alias("var"), F.sum("calls").alias("calls"))
    t = sessions.agg(F.sum("neg").alias("__neg"), F.sum("known").alias("__known"))
    x = sums.crossJoin(F.broadcast(t)).withColumns({"e": F.col("est") / F.col("__known"), "truth": F.col("__neg") / F.col("__known"), "m": 1.96 * F.sqrt("var") / F.col("__known")})  # one row
    return x.groupBy("design").agg(
        F.avg("e").alias("mean_estimate"), F.avg(F.col("e") - F.col("truth")).alias("bias"), F.sqrt(F.avg((F.col("e") - F.col("truth")) ** 2)).alias("rmse"),
        F.avg((F.abs(F.col("e") - F.col("truth")) <= F.col("m")).cast("double")).alias("coverage"), F.avg("calls").alias("mean_calls"), F.avg((F.col("calls") == 0).cast("double")).alias("zero_fraction"),
    )
