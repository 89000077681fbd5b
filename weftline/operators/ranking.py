"""Positions in a total order without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize

SHIFT = 33  # monotonically_increasing_id puts the partition above these bits


def global_sequence(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """df with its 0-based position in the total order of the given columns (nulls first; they should identify a row).

    A range-partitioned sort numbers rows inside partitions; the offsets are sums of the partitions' counts, one row for
    each partition. The sorted rows are written once, so count and numbering see the same partitions. Only partition
    counts reach the driver, never rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept, _ = materialize(sorted_df, "sorted")
    part = F.shiftrightunsigned("__at", SHIFT)
    counts = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for p, c in counts:
        offsets.append((p, total))
        total += c
    base = spark.createDataFrame(offsets, "__part long, __base long")
    out = kept.withColumn("__part", part.cast("long")).join(F.broadcast(base), "__part")  # one row for each partition
    return out.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND((1 << SHIFT) - 1)).drop("__at", "__part", "__base")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """df with a column run_<s> for each of `sums`: its sum over the rows of the same `by` up to this one in the given order.

    by and order together identify a row. Rows are range-partitioned by (by, order), so even one group with all rows is
    spread over many tasks: a task sums its own rows and adds what the partitions before it hold of the group. The table of
    partition totals has one row for each partition and each group inside it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    kept, _ = materialize(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = kept.groupBy(*by, "__part").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each partition
    base = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__b_{s}") for s in sums])
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # one range partition
    run = kept.select("*", *[F.sum(s).over(inside).alias(f"run_{s}") for s in sums])
    base = base.select(F.col("__part").alias("__at"), *[F.col(b).alias(f"__k_{b}") for b in by], *[f"__b_{s}" for s in sums])
    cond = F.col("__part") == F.col("__at")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return run.join(base, cond).select(*df.columns, *[(F.coalesce(F.col(f"run_{s}"), F.lit(0)) + F.col(f"__b_{s}")).alias(f"run_{s}") for s in sums])
