"""Fleet-shaped views over the supplied tables, written once and read by Spark and by DuckDB.

All formulas are closed-form integers and floors, so that both engines see the same rows.
``{name}`` marks a table or another view; what the two dialects write differently comes from
a ``Dialect``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
START = 1_788_877_800  #: 2026-09-08T14:30:00Z


class Spark:
    ints = staticmethod(lambda n: f"(SELECT explode(sequence(0, {n} - 1)) AS i)")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    time = staticmethod(lambda s: f"CAST(timestamp_seconds({s}) AS TIMESTAMP_NTZ)")


class Duck:
    ints = staticmethod(lambda n: f"(SELECT unnest(range(0, {n})) AS i)")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    time = staticmethod(lambda s: f"make_timestamp(CAST({s} AS BIGINT) * 1000000)")


def severity(kind: str, value: str) -> str:
    """SQL of a reading's severity."""
    limits = (("position", 200, 300), ("speeding", 10, 25), ("harsh-brake", 0.35, 0.55), ("idle", 15, 30), ("route-adherence", 400, 1000), ("geofence-state", 1, 1), ("panic", 1, 1))
    arms = " ".join(f"WHEN {kind} = '{k}' THEN CASE WHEN {value} >= CAST({c} AS DOUBLE) THEN 'critical' WHEN {value} >= CAST({w} AS DOUBLE) THEN 'warning' ELSE 'ok' END" for k, w, c in limits)
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'ok' WHEN {kind} = 'hos-remaining' THEN CASE WHEN {value} <= 40 THEN 'critical' WHEN {value} <= 60 THEN 'warning' ELSE 'ok' END {arms} ELSE 'ok' END"


def _telemetry(d) -> str:
    return f"""
SELECT r.*, {severity("kind", "value")} AS severity FROM (
    SELECT event_id AS seq, CAST(user_id % 3 AS STRING) AS tenant_id, lpad(CAST(event_id AS STRING), 12, '0') AS telemetry_id,
           CASE event_id % 3 WHEN 0 THEN 'samsara' WHEN 1 THEN 'motive' ELSE 'lytx' END AS provider,
           CASE event_type WHEN 'view' THEN 'position' WHEN 'click' THEN 'idle' WHEN 'error' THEN 'harsh-brake' WHEN 'purchase' THEN 'hos-remaining' ELSE 'route-adherence' END AS kind,
           CAST(user_id AS STRING) AS driver_id, concat('TRK-', CAST(user_id AS STRING)) AS source_ref,
           CASE event_type WHEN 'click' THEN value / 4 WHEN 'error' THEN value / 200 WHEN 'purchase' THEN value * 2 WHEN 'signup' THEN value * 8 ELSE value END AS value,
           {START} + (event_id * 7) % 3600 AS observed_s, {d.time(f"{START} + (event_id * 7) % 3600")} AS observed_at, CAST(floor((event_id * 7) % 3600 / 300) AS BIGINT) AS batch,
           CAST(c_nationkey AS STRING) AS district_id,
           CAST(-110 + (c_nationkey % 5) * 6 AS DOUBLE) + ((event_id * 13) % 201 - 100) * CAST(0.0005 AS DOUBLE) AS lon,
           CAST(28 + floor(c_nationkey / 5) * 4 AS DOUBLE) + ((event_id * 29) % 201 - 100) * CAST(0.0005 AS DOUBLE) AS lat
    FROM {{events}} JOIN {{customer}} ON user_id = c_custkey) r"""


VIEWS = {
    "territories": lambda d: "SELECT CAST(n_nationkey AS STRING) AS district_id, n_name AS name, r_name AS region, CAST(-110 + (n_nationkey % 5) * 6 AS DOUBLE) AS lon, CAST(28 + floor(n_nationkey / 5) * 4 AS DOUBLE) AS lat FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "corridor_points": lambda d: f"SELECT concat(district_id, '-', CAST(k.i AS STRING)) AS corridor_id, district_id, CAST(p.i AS BIGINT) AS pos, lon + (p.i - CAST(1.5 AS DOUBLE)) * CAST(0.4 AS DOUBLE) AS lon, lat + (k.i - 1) * CAST(0.2 AS DOUBLE) + p.i * (k.i + 1) * CAST(0.05 AS DOUBLE) AS lat FROM {{territories}} CROSS JOIN {d.ints(3)} k CROSS JOIN {d.ints(4)} p",
    "drivers": lambda d: "SELECT CAST(c_custkey % 3 AS STRING) AS tenant_id, CAST(c_custkey AS STRING) AS driver_id, c_name AS name, CAST(c_nationkey AS STRING) AS district_id, concat('TRK-', CAST(c_custkey AS STRING)) AS vehicle_id, CASE c_custkey % 4 WHEN 0 THEN 'driving' WHEN 1 THEN 'stopped' WHEN 2 THEN 'on-break' ELSE 'off-duty' END AS status, CAST(c_custkey * 37 % 661 AS INT) AS hos_remaining_minutes, CAST(-110 + (c_nationkey % 5) * 6 AS DOUBLE) + (c_custkey % 201 - 100) * CAST(0.005 AS DOUBLE) AS lon, CAST(28 + floor(c_nationkey / 5) * 4 AS DOUBLE) + (c_custkey * 31 % 201 - 100) * CAST(0.005 AS DOUBLE) AS lat FROM {customer}",
    "telemetry": _telemetry,
    "incidents": lambda d: f"SELECT CAST(o_custkey % 3 AS STRING) AS tenant_id, lpad(CAST(o_orderkey AS STRING), 12, '0') AS incident_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'acknowledged' END AS status, CAST(o_custkey % 25 AS STRING) AS district_id, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'critical' END AS severity, {d.array('CAST(o_custkey AS STRING)', 'CAST((o_custkey + 3) % 150 AS STRING)', 'CAST((o_custkey + 999999) AS STRING)', 'CAST((o_custkey * 7) % 150 AS STRING)')} AS driver_ids, o_orderdate AS opened_at FROM {{orders}}",
}
_NAMES = re.compile(r"\{([a-z_]\w*)\}")


class Tables:
    """Supplied tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._views = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._views:
            if name in BASE:
                self._views[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                sql = VIEWS[name](Spark)
                self._views[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(_NAMES.findall(sql))})
        return self._views[name]

    @cached_property
    def corridors(self) -> DataFrame:
        points = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
        return self.corridor_points.groupBy("corridor_id", "district_id").agg(points.alias("path")).withColumn("name", F.col("corridor_id"))

    @cached_property
    def readings(self) -> DataFrame:
        """Telemetry in the canonical shape; clocks have no place."""
        place = F.when(F.col("kind") != "hos-remaining", F.struct("lon", "lat", F.col("district_id").alias("district")))
        return self.telemetry.withColumn("location", place).drop("lon", "lat", "district_id")


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in dict.fromkeys(_NAMES.findall(text)):
            if n in VIEWS and n not in order:
                need(VIEWS[n](Duck))
                order.append(n)

    need(sql)
    plain = lambda s: _NAMES.sub(r"\1", s)
    parts = [f"{n} AS ({plain(VIEWS[n](Duck))})" for n in order]
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        head = "WITH RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else "WITH"
        return f"{head} {', '.join([*parts, body[len(head) :].strip()])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
