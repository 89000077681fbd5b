"""Parent-child rows to full hierarchies.

The frontier starts at the roots and advances by level blocks that double: when block k is done every node of depth
below 2**k has its path. A pending node carries its ancestor 2**k levels up and the path segment in between; one join
of the pending nodes with all nodes either attaches the segment to a finished path (the node is reached) or to another
segment (the node waits, now 2**(k+1) levels from its anchor). The number of joins is the logarithm of the depth, not
the depth. A segment that repeats a node has run into a cycle and is given up; nodes that the frontier never reaches lie
on a cycle or below one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.session import drop_path, materialize

ROOT, ORPHAN, CHILD, CYCLE = "root", "orphan_root", "child", "cycle"
ROWS = 25_000  # rows that a round reads for each of its output partitions
SHRINK = 6  # finished trees leave the search when the pending nodes have shrunk by this factor


def _all(blocks: Sequence[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def climb(done: DataFrame, pending: DataFrame, scope: Sequence[str], merge: dict[str, Column], keep: Column | None = None) -> list[DataFrame]:
    """Blocks of finished nodes (scope, __n, payload...), the roots first; nodes on or below a cycle are in none of them.

    done: scope, __n, payload of the roots; pending: scope, __n, __anc and the payload of the path from the node up to, but
    without, its ancestor __anc, the parent. merge makes the payload of the longer path from the node's own columns and
    the ancestor's, which are named with a leading u. keep drops pending rows that can't reach a root. Each round joins the
    pending nodes with all nodes of trees that aren't finished and doubles the levels that a pending node has climbed. A
    round in which nobody reaches a root is the last: what still waits runs in circles.
    """
    spark = done.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = list(merge)
    blocks, live = [done], [done]  # live: what pending nodes may still meet
    size, waiting = done.count() + pending.count(), -1
    while True:
        known = _all(live)
        marks = [f"u{c}" for c in scope]
        upper = lambda x, far: x.select(*[F.col(c).alias(m) for c, m in zip(scope, marks)], F.col("__n").alias("u__n"), far.alias("__far"), *[F.col(c).alias(f"u{c}") for c in payload])
        look = upper(known, F.lit(None).cast(pending.schema["__anc"].dataType)).unionByName(upper(pending, F.col("__anc")))
        cond = pending["__anc"] == look["u__n"]
        for c, m in zip(scope, marks):
            cond = cond & pending[c].eqNullSafe(look[m])
        step = pending.join(look, cond).select(*scope, "__n", F.col("__far").alias("__anc"), *[e.alias(c) for c, e in merge.items()])
        if keep is not None:
            step = step.filter(F.col("__anc").isNull() | keep)
        tasks = 2 * size // ROWS + 1  # by the rows that the join reads on each side
        if tasks < parts:
            step = step.coalesce(tasks)
        seen = Observation()
        made, at = materialize(step.observe(seen, F.count_if(F.col("__anc").isNull()).alias("reached"), F.count_if(F.col("__anc").isNotNull()).alias("pending")), "block")
        reached_now, waiting = seen.get["reached"], seen.get["pending"]
        if not reached_now:
            drop_path(spark, at)
            return blocks
        blocks.append(made.filter("__anc IS NULL").drop("__anc"))
        live.append(blocks[-1])
        if not waiting:
            return blocks
        pending = made.filter("__anc IS NOT NULL")
        if scope and waiting * SHRINK < size:
            # most trees are finished: keep only nodes of scopes that still wait
            near, wait = _all(live), pending.select(*[F.col(c).alias(f"u{c}") for c in scope]).distinct()
            cond = F.lit(True)
            for c in scope:
                cond = cond & near[c].eqNullSafe(wait[f"u{c}"])
            kept = Observation()
            near = near.join(wait, cond, "left_semi")
            if tasks < parts:
                near = near.coalesce(tasks)
            live = [materialize(near.observe(kept, F.count(F.lit(1)).alias("n")), "live")[0]]
            size = kept.get["n"] + waiting


def linked(nodes: DataFrame, scope: Sequence[str], *carried: str) -> DataFrame:
    """nodes (scope, __n, __p, ...) with __state and, named with a leading u, the carried columns of the parent; written once."""
    up = nodes.select(*[F.col(c).alias(f"u{c}") for c in scope], F.col("__n").alias("u__n"), *[F.col(c).alias(f"u{c}") for c in carried])
    cond = nodes["__p"] == up["u__n"]
    for c in scope:
        cond = cond & nodes[c].eqNullSafe(up[f"u{c}"])
    state = F.when(F.col("__p").isNull(), ROOT).when(F.col("__p") == F.col("__n"), CYCLE).when(F.col("u__n").isNull(), ORPHAN).otherwise(CHILD)
    return materialize(nodes.join(up, cond, "left").select(*[nodes[c] for c in nodes.columns], *[f"u{c}" for c in carried], state.alias("__state")), "nodes")[0]


def hierarchy(df: DataFrame, id_col: str, parent_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """One row for each node: scope columns, id, parent, root, depth, path, state.

    * Rows without an id name no node and are ignored; scope values may be null and null equals null.
    * Repeated rows count once. If deliveries of one id disagree about the parent, the smallest non-null parent holds.
    * state: root (no parent), orphan_root (the parent doesn't exist; its chain has ended), child, cycle (its chain never ends).
    * depth is 0 for both kinds of root; root and path are null for state cycle. path runs from the root to the node itself.
    * Other columns of df are not looked at. An empty table gives an empty result.
    """
    s = [f"__s{i}" for i in range(len(scope))]
    plain = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(scope, s)], F.col(f"`{id_col}`").alias("__n"), F.col(f"`{parent_col}`").alias("__p"))
    nodes = linked(plain.filter(F.col("__n").isNotNull()).groupBy(*s, "__n").agg(F.min("__p").alias("__p")), s)
    own = [*s, "__n", "__p"]
    done = nodes.filter(F.col("__state").isin(ROOT, ORPHAN)).select(*own, F.array("__n").alias("__path"), "__state")
    pending = nodes.filter(F.col("__state") == CHILD).select(*own, F.col("__p").alias("__anc"), F.array("__n").alias("__path"), "__state")
    merge = {"__p": F.col("__p"), "__path": F.concat("u__path", "__path"), "__state": F.col("__state")}
    # a path that repeats a node has run into a cycle
    blocks = climb(done, pending, s, merge, F.size(F.array_distinct("__path")) == F.size("__path"))
    late = nodes.filter(F.col("__state").isin(CHILD, CYCLE)).select(*own)
    for b in blocks[1:]:
        hit = b.select(*[F.col(k).alias(f"u{k}") for k in s], F.col("__n").alias("u__n"))
        cond = late["__n"] == hit["u__n"]
        for k in s:
            cond = cond & late[k].eqNullSafe(hit[f"u{k}"])
        late = late.join(hit, cond, "left_anti")
    out = _all([late.select(*own, F.lit(None).cast(done.schema["__path"].dataType).alias("__path"), F.lit(CYCLE).alias("__state")), *blocks])
    taken = {*scope, id_col}
    name = lambda x: x if x not in taken else f"{x}_"
    depth = F.when(F.col("__path").isNotNull(), F.size("__path") - 1).cast("long")
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(scope, s)], F.col("__n").alias(id_col), F.col("__p").alias(name(parent_col)),
        F.col("__path")[0].alias(name("root")), depth.alias(name("depth")), F.col("__path").alias(name("path")), F.col("__state").alias(name("state")),
    )


def descendants(tree: DataFrame, id_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """Pairs (scope, ancestor, descendant, distance) from the paths of hierarchy(); a node isn't its own descendant and nodes of state cycle have none."""
    pair = tree.select(*scope, F.col(id_col).alias("descendant"), F.col("depth").alias("__d"), F.posexplode("path").alias("__i", "ancestor"))
    return pair.filter(F.col("__i") < F.col("__d")).select(*scope, "ancestor", "descendant", (F.col("__d") - F.col("__i")).alias("distance"))


def descendant_counts(tree: DataFrame, id_col: str, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, id, n_descendants) of every node, 0 for leaves, null for state cycle."""
    up = tree.select(*scope, "state", F.explode(F.when(F.col("path").isNull(), F.array(F.col(id_col))).otherwise(F.col("path"))).alias(id_col))
    return up.groupBy(*scope, id_col).agg(F.when(F.max(F.col("state") != CYCLE), F.count("*") - 1).alias("n_descendants"))
