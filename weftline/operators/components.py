"""Connected components by alternating large-star and small-star steps.

Every step groups edges by one end with a map-side minimum and joins the minimum back, so a hub vertex is pre-aggregated
before it is shuffled and its edges can be split by the adaptive skew join. Lineage is cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import drop_path, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node of its component.

    Edges may repeat, run either way or be loops (a loop makes its node a component of its own); edges with a null end are
    ignored. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(f"`{src}`").alias("u"), F.col(f"`{dst}`").alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()
    e, first_at = materialize(e, "edges")
    start, at, last = e, first_at, None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        new, new_at = materialize(small, "stars")
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if at != first_at:
            drop_path(spark, at)
        e, at = new, new_at
        if mark == last:
            break
        last = mark
    nodes = start.select(F.col("u").alias("node")).union(start.select(F.col("v").alias("node"))).distinct()
    return nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
