"""All queries of the core with their SQL."""

from __future__ import annotations

from weftline.plans import dataset_queries, feedback_queries, hierarchy_queries, selection_queries, study_queries, trace_queries

FLAGSHIP = "causal_split_counts"
_MODULES = (hierarchy_queries, trace_queries, feedback_queries, dataset_queries, study_queries, selection_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
