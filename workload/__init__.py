"""Every operator and panel as a query over the given tables."""

from __future__ import annotations


def all_queries():
    """(queries, checking SQL), both by name."""
    from workload import operators, panels, streams, texts  # noqa: F401  (they register their queries)
    from workload.registry import CHECKS, QUERIES

    return dict(QUERIES), dict(CHECKS)
