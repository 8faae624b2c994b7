"""The registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from weftgraph.plans import change_queries, graph_queries, retrieval_queries

MODULES = (graph_queries, retrieval_queries, change_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
