"""Problem 1: the forest of trace_events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.hierarchy import CYCLE, descendant_counts, descendants, hierarchy
from weftline.session import table

SCOPE = ("tenant_id", "trace_id")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "trace_events"), "event_id", "parent_id", SCOPE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).filter(F.col("state") == CYCLE).select(*SCOPE, "event_id")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its root, depth, path (joined by '/') and state."""
    return _tree(spark, sf_dir).select(*SCOPE, "event_id", F.col("root").alias("root_event_id"), "depth", F.array_join("path", "/").alias("event_path"), "state")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return descendants(_tree(spark, sf_dir), "event_id", SCOPE)


def p1_descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_counts(_tree(spark, sf_dir), "event_id", SCOPE)


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p1_descendant_counts)}

_WALK = """WITH RECURSIVE n AS (SELECT tenant_id, trace_id, event_id, min(parent_id) AS parent_id FROM trace_events GROUP BY ALL),
k AS (SELECT n.*, p.event_id AS hit FROM n LEFT JOIN n p ON p.tenant_id = n.tenant_id AND p.trace_id = n.trace_id AND p.event_id = n.parent_id),
t AS (SELECT tenant_id, trace_id, event_id, event_id AS root_event_id, 0::BIGINT AS depth, event_id AS event_path,
        CASE WHEN parent_id IS NULL THEN 'root' ELSE 'orphan_root' END AS state FROM k WHERE hit IS NULL
      UNION ALL
      SELECT k.tenant_id, k.trace_id, k.event_id, t.root_event_id, t.depth + 1, t.event_path || '/' || k.event_id, 'child'
      FROM t JOIN k ON k.tenant_id = t.tenant_id AND k.trace_id = t.trace_id AND k.hit = t.event_id)
"""
_PAIRS = """, a AS (SELECT tenant_id, trace_id, event_id AS descendant, depth AS d, unnest(string_split(event_path, '/')) AS ancestor,
        unnest(range(depth + 1)) AS i FROM t)
"""
ORACLE = {
    "p1_found": _WALK + "SELECT tenant_id, trace_id, event_id FROM k ANTI JOIN t USING (tenant_id, trace_id, event_id)",
    "p1_hierarchy": _WALK + """SELECT tenant_id, trace_id, event_id, root_event_id, depth, event_path, coalesce(t.state, 'cycle') AS state
        FROM k LEFT JOIN t USING (tenant_id, trace_id, event_id)""",
    "p1_descendants": _WALK + _PAIRS + "SELECT tenant_id, trace_id, ancestor, descendant, d - i AS distance FROM a WHERE i < d",
    "p1_descendant_counts": _WALK + _PAIRS + """, c AS (SELECT tenant_id, trace_id, ancestor AS event_id, count(*) - 1 AS n FROM a GROUP BY ALL)
        SELECT k.tenant_id, k.trace_id, k.event_id, c.n AS n_descendants FROM k LEFT JOIN c USING (tenant_id, trace_id, event_id)""",
}
