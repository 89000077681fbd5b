"""Causal contexts: for every target the visible history that preceded it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.canon import digest, split_for
from weftline.operators.events import KEY, targets
from weftline.operators.hierarchy import CHILD, ORPHAN, ROOT, climb, hierarchy, linked
from weftline.session import materialize

TRACE = ("tenant_id", "trace_id")
# They are part of hashed identities.
METRIC_VERSION = "agent-dissatisfaction-v1"
INPUT_VERSION = "causal-visible-v1"


def ancestors(events: DataFrame) -> DataFrame:
    """(tenant_id, trace_id, target, ancestor, distance, chain): every ancestor of every target; distance 0 is the target itself.

    chain is complete, or missing_parent where the chain ends at a parent that doesn't exist. Targets on or below a cycle
    have no causal order and no rows. Lookup goes by tenant and trace and ignores the branch.
    """
    tree = hierarchy(events, "event_id", "parent_id", TRACE)
    roots = tree.filter("depth = 0").select(*TRACE, F.col("event_id").alias("root"), F.when(F.col("state") == "root", "complete").otherwise("missing_parent").alias("chain"))
    t = tree.join(targets(events).select(*KEY), list(KEY), "left_semi").filter("path IS NOT NULL")
    t = t.join(roots, [*TRACE, "root"])
    pair = t.select(*TRACE, F.col("event_id").alias("target"), "chain", "depth", F.posexplode("path").alias("at", "ancestor"))
    return pair.select(*TRACE, "target", "ancestor", (F.col("depth") - F.col("at")).alias("distance"), "chain")


def budgeted(events: DataFrame, max_chars: int = 12000) -> DataFrame:
    """(tenant_id, trace_id, target, ancestor, distance, chain, visible, kept, size): which ancestors fit the budget.

    Hidden, unfinished and system ancestors are skipped, not stopping points. Going up from the target, ancestors are kept
    as long as the running length fits; the first that overflows ends the context. The target itself is always kept whole.
    """
    e = events.select(*TRACE, F.col("event_id").alias("ancestor"), F.coalesce(F.length("text"), F.lit(0)).alias("len"), ((F.col("visibility") == "user_visible") & (F.col("status") == "completed") & (F.col("role") != "system")).alias("seen"))
    a = ancestors(events).join(e, [*TRACE, "ancestor"])
    visible = (F.col("distance") == 0) | F.coalesce("seen", F.lit(False))
    w = Window.partitionBy(*TRACE, "target").orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)  # a target's chain
    a = a.withColumn("visible", visible).withColumn("size", F.sum(F.when(F.col("visible"), F.col("len")).otherwise(0)).over(w))
    return a.withColumn("kept", F.col("visible") & ((F.col("size") <= max_chars) | (F.col("distance") == 0))).drop("len", "seen")


def kept_context(events: DataFrame, max_chars: int = 12000) -> DataFrame:
    """One row for each target: its own columns, chain, len, kept, n_visible.

    kept holds the ancestors inside the budget, nearest first: structs (id, size, distance), size being the visible
    characters from that ancestor up to the parent; n_visible counts all visible ancestors. Every node climbs to its root in
    doubling steps (see hierarchy.climb) but carries only what one budget can hold, so a chain of a million turns costs no
    more for each target than the budget does. Targets on or below a cycle have no causal order and no row. Rows with a
    null event_id are ignored; events are expected once each (see events.normalize).
    """
    seen = (F.col("visibility") == "user_visible") & (F.col("status") == "completed") & (F.col("role") != "system")
    s = ["__s0", "__s1"]
    e = events.filter("event_id IS NOT NULL").select(
        F.col("tenant_id").alias("__s0"), F.col("trace_id").alias("__s1"), F.col("event_id").alias("__n"), F.col("parent_id").alias("__p"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("__len"), F.coalesce(seen, F.lit(False)).alias("__seen"),
    )
    nodes = linked(e, s, "__len", "__seen")
    size = F.when(F.col("u__seen"), F.col("u__len")).otherwise(F.lit(0).cast("long"))
    first = F.struct(F.col("__p").alias("id"), size.alias("size"), F.lit(1).cast("long").alias("distance"))
    none = F.array().cast(f"array<struct<id:{e.schema['__n'].dataType.simpleString()},size:bigint,distance:bigint>>")
    zero = F.lit(0).cast("long")
    done = nodes.filter(F.col("__state").isin(ROOT, ORPHAN)).select(
        *s, "__n", F.when(F.col("__state") == ROOT, "complete").otherwise("missing_parent").alias("__chain"), none.alias("__kept"), zero.alias("__total"), zero.alias("__visible"), zero.alias("__levels")
    )
    pending = nodes.filter(F.col("__state") == CHILD).select(
        *s, "__n", F.col("__p").alias("__anc"), F.lit(None).cast("string").alias("__chain"), F.when(F.col("u__seen") & (size <= max_chars), F.array(first)).otherwise(none).alias("__kept"),
        size.alias("__total"), F.col("u__seen").cast("long").alias("__visible"), F.lit(1).cast("long").alias("__levels"),
    )
    further = F.transform(F.filter("u__kept", lambda x: x.size + F.col("__total") <= max_chars), lambda x: F.struct(x.id.alias("id"), (x.size + F.col("__total")).alias("size"), (x.distance + F.col("__levels")).alias("distance")))
    merge = {
        "__chain": F.col("u__chain"), "__kept": F.concat("__kept", further), "__total": F.col("__total") + F.col("u__total"),
        "__visible": F.col("__visible") + F.col("u__visible"), "__levels": F.col("__levels") + F.col("u__levels"),
    }
    blocks = climb(done, pending, s, merge)
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    own = targets(events).withColumn("len", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    cond = own["event_id"].eqNullSafe(out["__n"]) & own["tenant_id"].eqNullSafe(out["__s0"]) & own["trace_id"].eqNullSafe(out["__s1"])
    kept = F.filter("__kept", lambda x: x.size + F.col("len") <= max_chars)
    return own.join(out, cond).select(*own.columns, F.col("__chain").alias("chain"), kept.alias("kept"), F.col("__visible").alias("n_visible"))


def _status(max_chars: int) -> tuple[Column, Column, Column]:
    """(context_status, omitted_ancestors, context_chars) of a row of kept_context()."""
    omitted = F.col("n_visible") - F.size("kept")
    chars = F.col("len") + F.when(F.size("kept") > 0, F.element_at("kept", -1).size).otherwise(0)
    status = F.when(F.col("chain") != "complete", F.col("chain")).when((omitted > 0) | (chars > max_chars), "truncated").otherwise("complete")
    return status, omitted, chars


def context_rows(events: DataFrame, max_chars: int = 12000) -> DataFrame:
    """(key of the target, context_status, omitted_ancestors, n_context, context_chars): one row for each target."""
    status, omitted, chars = _status(max_chars)
    return kept_context(events, max_chars).select(*KEY, status.alias("context_status"), omitted.alias("omitted_ancestors"), (F.size("kept") + 1).cast("long").alias("n_context"), chars.alias("context_chars"))


def examples(events: DataFrame, max_chars: int = 12000, seed: int = 42) -> DataFrame:
    """Causal examples: identity fields, context (oldest first, the target last), input_id, language, group and split.

    input_id is the SHA-256 of the canonical JSON of the identity, so a parent that arrives later changes it.
    """
    status, omitted, _ = _status(max_chars)
    k, _ = materialize(kept_context(events, max_chars).withColumns({"context_status": status, "omitted_ancestors": omitted}), "kept")
    pair = k.select(*TRACE, F.col("event_id").alias("target"), F.explode("kept").alias("x")).select(*TRACE, "target", F.col("x.id").alias("event_id"), F.col("x.distance").alias("distance"))
    turn = lambda text: F.struct("event_id", "role", F.coalesce(text, F.lit("")).alias("text"))
    turns = pair.join(events.select(*KEY, "role", "text"), list(KEY)).select(*TRACE, "target", F.struct((-F.col("distance")).alias("o"), turn(F.col("text")).alias("t")).alias("x"))
    before = turns.groupBy(*TRACE, "target").agg(F.array_sort(F.collect_list("x")).alias("c"))  # at most max_chars of text for each target
    j = k.withColumn("target", F.col("event_id")).withColumn("own", turn(F.col("text"))).drop("event_id", "role", "text").join(before, [*TRACE, "target"], "left")
    past = F.coalesce(F.transform("c", lambda x: x.t), F.array().cast(j.select(F.array("own")).schema[0].dataType))
    j = j.withColumn("context", F.concat(past, F.array("own"))).withColumn("group_id", F.coalesce("group_id", "trace_id"))
    identity = {c: F.col(c) for c in ("tenant_id", "trace_id", "branch_id", "context", "context_status")} | {
        "target_event_id": F.col("target"), "metric_version": F.lit(METRIC_VERSION), "input_version": F.lit(INPUT_VERSION),
        "omitted_ancestors": F.col("omitted_ancestors"), "max_chars": F.lit(max_chars),
    }
    return j.select(
        *[v.alias(k) for k, v in identity.items()], digest(identity).alias("input_id"), F.coalesce("language", F.lit("unknown")).alias("language"), "group_id",
        split_for("tenant_id", "group_id", seed).alias("split"), F.lit(seed).alias("split_seed"),
    )


def annotation_form(ex: DataFrame) -> DataFrame:
    """What an annotator sees: no score, label or split."""
    return ex.select("input_id", "metric_version", "target_event_id", "context_status", "context", F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("evidence_event_ids"), F.lit(None).cast("string").alias("annotator"))
