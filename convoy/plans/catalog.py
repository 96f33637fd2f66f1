"""Every registered fleet query with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from convoy.plans import query_access, query_pipeline, query_scalars, query_sources, query_spatial, registered

MODULES = (query_access, query_pipeline, query_scalars, query_sources, query_spatial)


def queries() -> dict:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.ORACLES)
