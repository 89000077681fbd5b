"""Hash-ordered samples: the same rows whatever the order, the partitioning or the engine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.canon import seeded, string_json
from weftline.operators.ranking import global_sequence
from weftline.session import materialize


def ordering(df: DataFrame, key: str, namespace: str, seed: int = 42) -> DataFrame:
    return df.withColumn("__h", seeded(seed, namespace, string_json(key)))


def top_n(df: DataFrame, key: str, n: int, namespace: str, seed: int = 42) -> DataFrame:
    """The n rows whose keys hash lowest; a distributed top-k, not a full sort."""
    return ordering(df, key, namespace, seed).orderBy("__h", key).limit(n).drop("__h")


def hash_order(df: DataFrame, key: str, namespace: str, seed: int = 42, name: str = "position") -> DataFrame:
    """df with its position in hash order."""
    return global_sequence(ordering(df, key, namespace, seed), ["__h", key], name).drop("__h")


def stratified_pilot(df: DataFrame, key: str, stratum: str, per_class: int, namespace: str = "judge-pilot-v1", seed: int = 42) -> DataFrame:
    """(key, stratum, population, sample_size, inclusion_probability): the per_class keys of each stratum that hash lowest.

    Rows with a null stratum take no part. A hot stratum is ranked in 256 hash
    buckets first, so the final rank of a stratum sees at most 256 * per_class keys.
    """
    d = ordering(df.filter(F.col(stratum).isNotNull()).select(key, stratum), key, namespace, seed)
    n = d.groupBy(stratum).agg(F.count("*").alias("population"))
    # 256 buckets by the first hash byte keep every rank group small even where one stratum holds most rows
    d = d.withColumn("__b", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    in_bucket = Window.partitionBy(stratum, "__b").orderBy("__h", key)
    d = d.withColumn("__r", F.row_number().over(in_bucket)).filter(F.col("__r") <= per_class)
    over = Window.partitionBy(stratum).orderBy("__h", key)  # at most 256 * per_class rows
    d = d.withColumn("__r", F.row_number().over(over)).filter(F.col("__r") <= per_class)
    d = d.join(F.broadcast(n), stratum)  # one row for each stratum
    size = F.least(F.lit(per_class).cast("long"), F.col("population"))
    return d.select(key, stratum, "population", size.alias("sample_size"), (size / F.col("population")).alias("inclusion_probability"))


def nested_prefix(groups: DataFrame, group: str, size_col: str, sizes: Sequence[int], namespace: str = "student-learning-curve-v1", seed: int = 42) -> DataFrame:
    """(size, group, n): for each size the shortest prefix of whole groups in hash order with at least `size` rows.

    groups has one row for each group. Running sums come from a global range sort and partition offsets, not from one task.
    """
    ordered = global_sequence(ordering(groups.select(group, F.col(size_col).alias("n")), group, namespace, seed), ["__h", group], "seq")
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = ordered.agg(F.max("seq")).first()[0]
    width = max(1, -(-(total + 1) // max(parts, 1))) if total is not None else 1
    ordered = ordered.withColumn("__c", F.expr(f"seq div {width}"))
    cells = ordered.groupBy("__c").agg(F.sum("n").alias("m"))
    base = cells.select("__c", F.coalesce(F.sum("m").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # one row for each cell
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__c").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = ordered.withColumn("__in", inside).join(F.broadcast(base), "__c").withColumn("before", F.col("__base") + F.col("__in"))
    return run.withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))).filter("before < size").select("size", group, "n")


def _lowest(df: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    """The n rows of each group that hash lowest. 256 buckets by the first hash byte are cut down first, so no task ranks a hot group whole."""
    cell = F.substring("__h", 1, 2)
    part = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by, cell).orderBy("__h", key))).filter(F.col("__r") <= n)
    return part.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key))).filter(F.col("__r") <= n).drop("__r")


def greedy_exclusive(df: DataFrame, key: str, label: str, text: str, session: str, per_class: int, namespace: str = "tuning-v1", seed: int = 42) -> DataFrame:
    """(key, label): per_class keys of each label in hash order, with no text and no session taken twice across all labels.

    Order-dependent by nature: labels in ascending order, keys by hash; rows with a null label, text or session take no
    part. One task decides over candidates that provably hold every pick. With P = labels * per_class picks at most, a pick
    is the lowest row of its (label, text, session); the rows of its (label, text) before it were blocked by the sessions of
    other picks, one session each, so it is among the P + 1 lowest there, and likewise among those of its (label, session).
    Of such rows each pick blocks at most P + 1 by its text and P + 1 by its session, so the picks of a label are among its
    first 2 * P * (P + 1) + per_class.
    """
    d = ordering(df.filter(f"`{label}` IS NOT NULL AND `{text}` IS NOT NULL AND `{session}` IS NOT NULL").select(key, label, text, session), key, namespace, seed)
    d = d.withColumn("__t", F.sha2(text, 256)).drop(text)
    first = d.groupBy(label, "__t", session).agg(F.min(F.struct("__h", key)).alias("x")).select(label, "__t", session, "x.*")
    first, _ = materialize(first, "candidates")
    picks = first.select(label).distinct().count() * per_class
    few = _lowest(_lowest(first, [label, "__t"], key, picks + 1).join(_lowest(first, [label, session], key, picks + 1).select(key, label, "__t", session), [key, label, "__t", session], "left_semi"), [label], key, 2 * picks * (picks + 1) + per_class)

    types = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat([pd.DataFrame(columns=[key, label, "__t", session, "__h"]), *frames], ignore_index=True)
        f = f.sort_values([label, "__h", key])[[key, label, "__t", session]]
        texts, sessions, taken, out = set(), set(), {}, []
        for k, lab, t, s in f.itertuples(index=False, name=None):
            if taken.get(lab, 0) < per_class and t not in texts and s not in sessions:
                texts.add(t)
                sessions.add(s)
                taken[lab] = taken.get(lab, 0) + 1
                out.append((k, lab))
        yield pd.DataFrame(out, columns=[key, label])

    return few.select(key, label, "__t", session, "__h").coalesce(1).mapInPandas(run, f"`{key}` {types[key]}, `{label}` {types[label]}")
