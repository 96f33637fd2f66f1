"""Registration of queries beside their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convoy.plans.views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables under a name, with SQL for the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register


def up(x: str, digits: int = 0) -> str:
    """SQL that rounds halves up."""
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}" if digits else f"floor(({x}) + 0.5)"


def km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """SQL of the great-circle distance."""
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)))))"


RANK = "CASE {0} WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END"
LEVEL = "CASE {0} WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' ELSE 'ok' END"
