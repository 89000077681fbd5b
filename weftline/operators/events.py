"""The event log: domain checks, deliveries, causal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schemas import ROLES, STATUSES, VISIBILITIES

KEY = ("tenant_id", "trace_id", "event_id")
PAYLOAD = ("parent_id", "branch_id", "sequence", "role", "visibility", "text", "status", "language", "group_id")


def violations(events: DataFrame) -> DataFrame:
    """(key, violation): one row for each broken domain rule of each row. Null counts as missing where a value is required."""
    bad = lambda c, ok: ~F.coalesce(ok, F.lit(False))
    filled = lambda c: F.length(c) > 0
    rules = [F.when(bad(c, filled(c)), F.lit(f"empty_{c}")) for c in (*KEY, "branch_id", "language")]
    rules += [F.when(F.col(c) == "", F.lit(f"empty_{c}")) for c in ("parent_id", "group_id")]
    rules += [F.when(bad("sequence", F.col("sequence") >= 0), F.lit("negative_sequence")), F.when(F.col("text").isNull(), F.lit("missing_text"))]
    rules += [F.when(bad(c, F.col(c).isin(*allowed)), F.lit(f"unknown_{c}")) for c, allowed in (("role", ROLES), ("visibility", VISIBILITIES), ("status", STATUSES))]
    return events.select(*KEY, F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def payload_hash(payload: tuple[str, ...] = PAYLOAD) -> Column:
    """64 bits of the payload; null positions count, so a value can't move to the next column unseen."""
    return F.xxhash64(*payload, *[F.isnull(c) for c in payload])


def conflicts(events: DataFrame) -> DataFrame:
    """(key, n_deliveries, n_payloads) of events whose deliveries differ in anything but their arrival."""
    e = events.filter(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).select(*KEY, payload_hash().alias("h"))
    n = e.groupBy(*KEY).agg(F.count("*").alias("n_deliveries"), F.countDistinct("h").alias("n_payloads"))
    return n.filter("n_payloads > 1")


def normalize(events: DataFrame, arrival: str | None = "received_ts") -> DataFrame:
    """One row for each event key, with conflict flags; redeliveries of one payload are dropped.

    The payload of the first arrival stands (ties: the smaller payload hash); conflicting is true where deliveries differ.
    A reader who wants the strict contract raises on any conflicting row (see checks.assert_empty).
    """
    order = F.struct(*([F.col(arrival)] if arrival else []), payload_hash())
    e = events.filter(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).select(*KEY, order.alias("__o"), payload_hash().alias("__h"), F.struct(*PAYLOAD).alias("__v"))
    out = e.groupBy(*KEY).agg(F.min_by("__v", "__o").alias("__v"), (F.min("__h") != F.max("__h")).alias("conflicting"))
    return out.select(*KEY, "__v.*", "conflicting")


def group_changes(events: DataFrame) -> DataFrame:
    """(tenant_id, trace_id, n_groups) of traces whose group_id is not constant; null counts as a value."""
    g = events.groupBy("tenant_id", "trace_id").agg((F.countDistinct("group_id") + F.max(F.col("group_id").isNull().cast("int"))).alias("n_groups"))
    return g.filter("n_groups > 1")


def order_violations(events: DataFrame) -> DataFrame:
    """(key, parent_id, sequence, parent_sequence) of events whose parent exists and doesn't come before them."""
    p = events.select("tenant_id", "trace_id", F.col("event_id").alias("parent_id"), F.col("sequence").alias("parent_sequence"))
    return events.join(p, ["tenant_id", "trace_id", "parent_id"]).filter("parent_sequence >= sequence").select(*KEY, "parent_id", "sequence", "parent_sequence")


def targets(events: DataFrame) -> DataFrame:
    """Events that start an example: completed, visible user messages."""
    return events.filter("role = 'user' AND visibility = 'user_visible' AND status = 'completed'")


def traces_without_targets(events: DataFrame) -> DataFrame:
    return events.select("tenant_id", "trace_id").distinct().join(targets(events).select("tenant_id", "trace_id").distinct(), ["tenant_id", "trace_id"], "left_anti")
