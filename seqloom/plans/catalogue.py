"""All queries of the engine's own operators and their SQL counterparts."""

from __future__ import annotations

from seqloom.plans import align_queries, curve_queries, job_queries, metric_queries, select_queries, trace_queries

MODULES = [trace_queries, align_queries, curve_queries, job_queries, metric_queries, select_queries, job_queries]


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
