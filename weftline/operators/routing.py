"""Trace routing under a recorded policy, and reports that use the design's inclusion probabilities.

Decisions are two tables: one row for each trace, one for each member message. A trace of any size stays spread over
tasks; arrays of ids are never collected.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.canon import json_array, uniform

TRACE = ("tenant_id", "trace_id")


@dataclass(frozen=True)
class Policy:
    mode: str = "shadow"
    threshold: float = 0.5
    audit_rate: float = 0.1
    seed: int = 42
    version: str = "routing-v1"

    def __post_init__(self) -> None:
        if self.mode not in ("shadow", "cascade"):
            raise ValueError("mode is shadow or cascade")
        if not (0 <= self.threshold <= 1 and 0 < self.audit_rate <= 1):
            raise ValueError("threshold lies in [0, 1], audit_rate in (0, 1]")

    @property
    def policy_id(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def members(examples: DataFrame, predictions: DataFrame, policy: Policy) -> DataFrame:
    """(tenant_id, trace_id, input_id, model_selected, safety_selected, scored, model_version) of every example.

    A missing prediction has runtime_status missing; a prediction made on another context_status than complete was not
    evaluated; null and NaN scores are no scores. Safety selects whatever the model could not judge in full.
    """
    p = predictions.select("input_id", "score", "runtime_status", "model_abstention", "model_version", F.col("context_status").alias("__c"))
    j = examples.select(*TRACE, "input_id", "context_status", "language").join(p, "input_id", "left")
    runtime = F.when(F.coalesce("__c", F.lit("complete")) != "complete", "not_evaluated").otherwise(F.coalesce("runtime_status", F.lit("missing")))
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    j = j.withColumns({"__r": runtime, "__s": score})
    ok = F.col("__r") == "ok"
    model = ok & F.coalesce(F.col("__s") >= policy.threshold, F.lit(False))
    safety = (F.col("context_status") != "complete") | ~ok | F.coalesce("model_abstention", F.lit(False)) | F.col("__s").isNull() | (F.coalesce("language", F.lit("unknown")) == "unknown")
    return j.select(*TRACE, "input_id", model.alias("model_selected"), safety.alias("safety_selected"), (F.coalesce(F.col("runtime_status") == "ok", F.lit(False)) & F.col("__s").isNotNull()).alias("scored"), "model_version")


def decide(m: DataFrame, policy: Policy) -> DataFrame:
    """One row for each trace of members(): counts, filter_selected, audit_selected, would_route, routed, inclusion probabilities."""
    d = m.groupBy(*TRACE).agg(
        F.count("*").alias("n_inputs"), F.count_if("model_selected").alias("n_model_selected"), F.count_if("safety_selected").alias("n_safety_selected"),
        F.max(F.col("model_selected") | F.col("safety_selected")).alias("filter_selected"),
    )
    audit = ~F.col("filter_selected") & (uniform(policy.seed, "audit-v1", json_array(*TRACE)) < policy.audit_rate)
    d = d.withColumn("audit_selected", audit)
    would = F.col("filter_selected") | F.col("audit_selected")
    candidate = F.when(F.col("filter_selected"), F.lit(1.0)).otherwise(F.lit(policy.audit_rate))
    shadow = policy.mode == "shadow"
    return d.withColumns(
        {
            "would_route": would, "routed": F.lit(True) if shadow else would, "inclusion_probability": F.lit(1.0) if shadow else candidate,
            "candidate_inclusion_probability": candidate, "policy_id": F.lit(policy.policy_id),
        }
    )


def route(examples: DataFrame, predictions: DataFrame, policy: Policy) -> DataFrame:
    return decide(members(examples, predictions, policy), policy)


def inconsistent(decisions: DataFrame, policy: Policy) -> DataFrame:
    """Decisions that don't follow from their counts, the audit draw and the policy."""
    sel = (F.col("n_model_selected") > 0) | (F.col("n_safety_selected") > 0)
    audit = ~sel & (uniform(policy.seed, "audit-v1", json_array(*TRACE)) < policy.audit_rate)
    pi = F.when(F.lit(policy.mode == "shadow") | sel, 1.0).otherwise(policy.audit_rate)
    good = (
        F.col("filter_selected").eqNullSafe(sel) & F.col("audit_selected").eqNullSafe(audit) & F.col("would_route").eqNullSafe(sel | audit)
        & F.col("routed").eqNullSafe(F.lit(policy.mode == "shadow") | sel | audit) & F.col("inclusion_probability").eqNullSafe(pi) & (F.col("policy_id") == policy.policy_id)
    )
    return decisions.filter(~F.coalesce(good, F.lit(False)))


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n, d)


def recall_lower_bound(hits: int, positives: int, alpha: float = 0.05) -> float | None:
    """One-sided exact binomial lower bound: the p at which `hits` or more of `positives` have probability alpha."""
    if not 0 <= hits <= positives or not 0 < alpha < 1:
        raise ValueError("0 <= hits <= positives and 0 < alpha < 1")
    if not positives:
        return None
    if not hits:
        return 0.0
    if hits == positives:
        return alpha ** (1 / positives)

    def tail(p: float) -> float:
        # probabilities by recurrence from the mode of the tail, in log space against underflow
        k = max(hits, min(positives, round((positives + 1) * p)))
        top = math.lgamma(positives + 1) - math.lgamma(k + 1) - math.lgamma(positives - k + 1) + k * math.log(p) + (positives - k) * math.log1p(-p)
        odds = p / (1 - p)
        up = down = total = 1.0
        for i in range(k, positives):
            up *= (positives - i) / (i + 1) * odds
            total += up
        for i in range(k, hits, -1):
            down *= i / ((positives - i + 1) * odds)
            total += down
        return math.exp(top) * total

    low, high = 0.0, 1.0
    while high - low > 1e-15 and (mid := (low + high) / 2) not in (low, high):
        low, high = (mid, high) if tail(mid) < alpha else (low, mid)
    return (low + high) / 2


def clustered(examples: DataFrame) -> DataFrame:
    """(clustered): whether any group of a tenant has several traces, so traces aren't independent."""
    g = examples.groupBy("tenant_id", "group_id").agg((F.min("trace_id") < F.max("trace_id")).alias("m"))
    return g.agg(F.coalesce(F.max("m"), F.lit(False)).alias("clustered"))


def evaluate(m: DataFrame, decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of trace and message quality; labels: (input_id, label in yes/no/unclear).

    A trace with a yes is positive; without a yes but with an unclear it is neither positive nor negative. Ratios with an
    empty denominator are null. Messages without a label count as messages only.
    """
    x = m.join(labels.select("input_id", "label"), "input_id", "left")
    t = x.groupBy(*TRACE).agg(
        F.count_if(F.col("label") == "yes").alias("n_yes"), F.count_if(F.col("label") == "unclear").alias("n_unclear"),
        F.count_if((F.col("label") == "yes") & F.col("model_selected")).alias("n_model_hits"), F.count_if(~F.col("scored")).alias("n_unscored"),
    )
    d = decisions.join(t, list(TRACE))
    pos, unclear = F.col("n_yes") > 0, (F.col("n_yes") == 0) & (F.col("n_unclear") > 0)
    neg = ~pos & ~unclear
    n = lambda c: F.count_if(c)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    r = d.agg(
        F.count("*").alias("traces"), s("n_inputs").alias("messages"), n(pos).alias("positive_traces"), n(neg).alias("negative_traces"), n(unclear).alias("unclear_traces"),
        s("n_unclear").alias("unclear_messages"), n(pos & F.col("filter_selected")).alias("__hits"), n(pos & F.col("would_route")).alias("__cand"), n(pos & F.col("routed")).alias("__act"),
        n(neg & F.col("filter_selected")).alias("filter_false_positive_traces"), s("n_model_hits").alias("__mhits"), s("n_yes").alias("__yes"),
        s(F.when(F.col("filter_selected"), F.col("n_yes")).otherwise(0)).alias("__cover"), n(F.col("filter_selected")).alias("filter_selected_traces"),
        n(F.col("n_safety_selected") > 0).alias("safety_selected_traces"), n(F.col("audit_selected")).alias("audit_selected_traces"), n(F.col("would_route")).alias("candidate_routed_traces"),
        n(F.col("routed")).alias("actual_routed_traces"), s(F.when(F.col("would_route"), F.col("n_inputs")).otherwise(0)).alias("candidate_routed_messages"),
        s(F.when(F.col("routed"), F.col("n_inputs")).otherwise(0)).alias("actual_routed_messages"), s("n_unscored").alias("unscored_or_failed_messages"),
    )
    ratios = {
        "filter_trace_recall": ("__hits", "positive_traces"), "candidate_routing_trace_recall_with_audit": ("__cand", "positive_traces"),
        "actual_routing_trace_recall": ("__act", "positive_traces"), "model_message_recall": ("__mhits", "__yes"), "filter_message_coverage": ("__cover", "__yes"),
    }
    r = r.withColumns({k: ratio(*v) for k, v in ratios.items()})
    return r.withColumn("filter_hits", F.col("__hits")).drop("__hits", "__cand", "__act", "__mhits", "__yes", "__cover")


def prevalence(m: DataFrame, decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Horvitz-Thompson totals by label over routed traces, and the ratio among clear labels; no interval is claimed."""
    w = decisions.filter("routed").select(*TRACE, (1 / F.col("inclusion_probability")).alias("w"))
    x = m.join(w, list(TRACE)).join(labels.select("input_id", "label"), "input_id")
    tot = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("w"))), F.lit(0.0)).alias(f"ht_{k}")
    r = x.agg(tot("yes"), tot("no"), tot("unclear"), F.count("*").alias("reviewed_messages"))
    return r.withColumns(
        {"yes_among_clear": ratio("ht_yes", F.col("ht_yes") + F.col("ht_no")), "unclear_fraction": ratio("ht_unclear", F.col("ht_yes") + F.col("ht_no") + F.col("ht_unclear"))}
    )


def end_to_end(m: DataFrame, decisions: DataFrame, labels: DataFrame, calls: DataFrame) -> DataFrame:
    """(positives, routed_positives, found_positives, routing_recall, end_to_end_recall) over messages labelled yes; calls: one for each input.

    A positive is found if its trace is routed and its call is ok and says yes; a missing or failed call finds nothing.
    """
    found = calls.select("input_id", ((F.col("runtime_status") == "ok") & (F.col("label") == "yes")).alias("__hit"))
    x = m.join(labels.filter("label = 'yes'").select("input_id"), "input_id").join(decisions.select(*TRACE, "routed"), list(TRACE)).join(found, "input_id", "left")
    r = x.agg(F.count("*").alias("positives"), F.count_if("routed").alias("routed_positives"), F.count_if(F.col("routed") & F.coalesce("__hit", F.lit(False))).alias("found_positives"))
    return r.withColumns({"routing_recall": ratio("routed_positives", "positives"), "end_to_end_recall": ratio("found_positives", "positives")})
