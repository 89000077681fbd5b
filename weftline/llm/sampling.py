"""Problem 5: a reproducible sample that is stable as data grows.

Records get persistent sequence numbers: their position by (first ingestion, id), null times last. Numbers fall into fixed
blocks and a hash of the block number predetermines which positions of the block are chosen, whether or not they are
filled yet. A record with a later ingestion time takes a later number and disturbs none before it. Where rows may also
come late, the numbers are kept in a store: what has a number keeps it, unseen records take the numbers that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import global_sequence


def numbered(df: DataFrame, id_col: str = "input_id", ts_col: str = "ingested_ts", known: DataFrame | None = None) -> DataFrame:
    """(id, first_ts, seq): redelivered rows count at their first arrival. Rows with a null id are ignored; a null time counts as the latest.

    known (id, first_ts, seq) are records numbered before: they keep their numbers, whatever df says of them now or if it
    lacks them, and the others are numbered after the highest of these, whatever their times are.
    """
    first = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(ts_col).alias("first_ts"))
    if known is not None:
        first = first.join(known.select(id_col), id_col, "left_anti")
    order = first.withColumn("__late", F.col("first_ts").isNull())
    new = global_sequence(order, ["__late", "first_ts", id_col]).select(id_col, "first_ts", "seq")
    if known is None:
        return new
    start = (known.agg(F.max("seq")).first()[0] + 1) if not known.isEmpty() else 0
    return known.select(id_col, "first_ts", "seq").unionByName(new.withColumn("seq", F.col("seq") + F.lit(start)))


def stored_numbers(df: DataFrame, store: str, id_col: str = "input_id", ts_col: str = "ingested_ts") -> DataFrame:
    """numbered() against the numbers kept in the folder `store`; those of unseen records are appended to it. One writer at a time."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.parquet(store) if there else None
    now = numbered(df, id_col, ts_col, known)
    new = now if known is None else now.join(known.select(id_col), id_col, "left_anti")
    new.write.mode("append").parquet(store)
    return spark.read.parquet(store)


def block_sample(df: DataFrame, id_col: str = "input_id", ts_col: str = "ingested_ts", block: int = 100, chosen: int = 10, seed: str = "sample-v1", store: str | None = None) -> DataFrame:
    """(id, first_ts, seq): `chosen` of every `block` sequence numbers, which are those of the store if there is one.

    Positions are ordered by md5(seed:block:position). An earlier sample is a subset of a later one if the rows added have
    a later ingestion time than all before, and with a store whatever rows are added; the last, partly filled block keeps
    its predetermined positions too.
    """
    seq = (stored_numbers(df, store, id_col, ts_col) if store else numbered(df, id_col, ts_col)).withColumns({"__b": F.expr(f"seq div {block}"), "__p": F.expr(f"seq % {block}")})
    order = F.array_sort(
        F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda p: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("__b"), p).cast("binary")).alias("h"), p.cast("long").alias("p")))
    )
    wanted = seq.select("__b").distinct().select("__b", F.explode(F.slice(order, 1, chosen)).alias("x")).select("__b", F.col("x.p").alias("__p"))
    return seq.join(wanted, ["__b", "__p"], "left_semi").select(id_col, "first_ts", "seq")
