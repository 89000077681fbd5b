"""Problem 6: splits that keep related records together.

Records that share a session, or a group inside a tenant, form components. Components are combined by largest differencing
(Karmarkar-Karp) into many equal bins and whole bins are given to splits by target share.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.operators.ranking import global_sequence
from weftline.session import materialize

BINS = 200


def session_components(df: DataFrame) -> DataFrame:
    """(tenant_id, session_id, component): sessions linked directly or through others by a shared non-null group_id of one tenant.

    Null tenants equal each other; rows with a null session are a session of their own tenant named null. One very large
    group is a star of sessions around one group node, never pairs of sessions.
    """
    name = lambda kind, col: F.concat_ws("\x1f", F.lit(kind), F.coalesce("tenant_id", F.lit("\x00")), F.coalesce(F.col(col), F.lit("\x00")))
    links = df.select("tenant_id", "session_id", "group_id").distinct()
    links = links.select("tenant_id", "session_id", name("s", "session_id").alias("src"), F.when(F.col("group_id").isNotNull(), name("g", "group_id")).otherwise(name("s", "session_id")).alias("dst"))
    comp = connected_components(links, "src", "dst")
    own = links.select("tenant_id", "session_id", F.col("src").alias("node")).distinct()
    return own.join(comp, "node").select("tenant_id", "session_id", "component")


def crossing_sessions(df: DataFrame) -> DataFrame:
    """(tenant_id, session_id) of components with more than one distinct non-null split."""
    comp, _ = materialize(session_components(df), "components")
    eq = lambda a, b: a["tenant_id"].eqNullSafe(b["tenant_id"]) & a["session_id"].eqNullSafe(b["session_id"])
    had = df.select("tenant_id", "session_id", "split").filter("split IS NOT NULL").distinct()
    many = had.join(comp, eq(had, comp)).groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
    return comp.join(many.select("component"), "component", "left_semi").select("tenant_id", "session_id")


def differencing(weights: dict[int, int], bins: int) -> list[dict[int, int]]:
    """Largest differencing into `bins` parts: the two partial solutions with the largest spread are merged, the heavy parts of one with the light parts of the other.

    weights: how many items there are of each weight; a part says how many of each it gets. Items of one weight fill all
    bins evenly first, which leaves no spread; of the fewer than `bins` that remain each gets a bin of its own, which is what
    merging them one by one comes to. So there is one partial solution for each distinct weight.
    """
    even = {w: n // bins for w, n in weights.items()}
    heap: list = []
    for i, w in enumerate(sorted(weights, reverse=True)):
        n = weights[w] % bins
        if n and w:
            sums = np.zeros(bins, dtype=np.int64)
            sums[:n] = w
            heap.append((-w, i, sums, [((w, 1),)] * n + [()] * (bins - n)))
    heapq.heapify(heap)
    tick = len(weights)
    while len(heap) > 1:
        _, _, s1, p1 = heapq.heappop(heap)
        _, _, s2, p2 = heapq.heappop(heap)
        sums = s1 + s2[::-1]
        parts = [x + y for x, y in zip(p1, p2[::-1])]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]  # only differences matter
        heapq.heappush(heap, (-int(sums[0]), tick, sums, [parts[i] for i in order]))
        tick += 1
    rest = heap[0][3] if heap else [()] * bins
    out = []
    for part in rest:
        own = {w: n for w, n in even.items() if n}
        for w, n in part:
            own[w] = own.get(w, 0) + n
        out.append(own)
    return out


def allocate(weights: dict[int, int], shares: Mapping[str, float], bins: int = BINS) -> dict[str, dict[int, int]]:
    """Split to how many items of each weight: whole bins, heaviest first, go to the split furthest below its target (ties by name)."""
    total, norm = sum(w * n for w, n in weights.items()), sum(shares.values())
    left = {s: total * x / norm for s, x in shares.items()}
    out: dict[str, dict[int, int]] = {s: {} for s in shares}
    size = lambda p: sum(w * n for w, n in p.items())
    for part in sorted(differencing(weights, bins), key=lambda p: (-size(p), sorted(p.items()))):
        split = max(sorted(left), key=lambda s: left[s])
        left[split] -= size(part)
        for w, n in part.items():
            out[split][w] = out[split].get(w, 0) + n
    return out


def grouped_splits(df: DataFrame, targets: DataFrame, id_col: str = "input_id", bins: int = BINS) -> DataFrame:
    """(input_id, tenant_id, session_id, component, assigned_split), one row for each id.

    An id that comes in several sessions joins them. Rows with a null id are ignored. All components are balanced one by
    one, but those of one weight are alike: the driver sees only how many components there are of each weight, at most
    sqrt(2 * records) numbers, and says how many of each weight a split gets. Which ones is decided by their hash.
    """
    spark = df.sparkSession
    df = df.filter(F.col(id_col).isNotNull())
    comp, _ = materialize(session_components(df), "components")
    eq = lambda a, b: a["tenant_id"].eqNullSafe(b["tenant_id"]) & a["session_id"].eqNullSafe(b["session_id"])
    ids = df.select(id_col, "tenant_id", "session_id").distinct()
    rows = ids.join(comp, eq(ids, comp)).select(ids[id_col], ids["tenant_id"], ids["session_id"], "component")
    one = rows.groupBy(id_col).agg(F.min(F.struct("component", "tenant_id", "session_id")).alias("x"), F.max("component").alias("other"))
    one, _ = materialize(one, "records")
    twice = one.filter("x.component <> other").select(F.col("x.component").alias("src"), F.col("other").alias("dst"))
    merged = connected_components(twice) if not twice.isEmpty() else None
    rows = one.select(id_col, "x.tenant_id", "x.session_id", "x.component")
    if merged is not None:
        rows = rows.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
    sizes, _ = materialize(rows.groupBy("component").agg(F.count("*").alias("w")), "sizes")
    weights = {r["w"]: r["n"] for r in sizes.groupBy("w").agg(F.count("*").alias("n")).collect()}
    shares = {r["split"]: r["share"] for r in targets.filter("split IS NOT NULL AND share > 0").groupBy("split").agg(F.sum("share").alias("share")).collect()}
    ranges, taken = [], dict.fromkeys(weights, 0)
    for split, own in sorted(allocate(weights, shares, bins).items()):
        for w, n in own.items():
            ranges.append((w, split, taken[w], taken[w] + n))
            taken[w] += n
    ranked = global_sequence(sizes.withColumn("h", F.xxhash64("component")), ["w", "h", "component"])
    before = dict(zip(sorted(weights), [0, *np.cumsum([weights[w] for w in sorted(weights)]).tolist()]))
    given = spark.createDataFrame([(w, s, before[w] + a, before[w] + b) for w, s, a, b in ranges], "w long, assigned_split string, __a long, __b long")
    names = ranked.join(F.broadcast(given), "w").filter("seq >= __a AND seq < __b").select("component", "assigned_split")  # a row for each distinct weight and split
    return rows.join(names, "component").select(id_col, "tenant_id", "session_id", "component", "assigned_split")


def share_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_records, actual_share)."""
    n = assigned.groupBy("assigned_split").agg(F.count("*").alias("n_records"))
    t = targets.join(n, F.col("split") == F.col("assigned_split"), "left").select("split", F.col("share").alias("target_share"), F.coalesce("n_records", F.lit(0)).alias("n_records"))
    total = n.agg(F.sum("n_records").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("split", "target_share", "n_records", F.try_divide("n_records", "total").alias("actual_share"))  # one row
