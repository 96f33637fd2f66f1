"""The pipeline from readings to incidents over the fleet views.

One ``batch`` of the view (five minutes of readings) is one evaluation, so exceptions have
different times and the windows of corroboration and merging matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions import rules
from convoy.operators import pipeline, sinks
from convoy.operators.access import Engine, Principal
from convoy.plans.registered import LEVEL, RANK, km, query, up

_KINDS = "CASE kind WHEN 'harsh-brake' THEN 'harsh-braking' WHEN 'idle' THEN 'prolonged-idle' WHEN 'hos-remaining' THEN 'hos-risk' WHEN 'route-adherence' THEN 'route-deviation' WHEN 'panic' THEN 'panic' END"
#: Exceptions as SQL: one row per tenant, driver, batch and kind.
EXCEPTIONS = f"""
p AS (SELECT tenant_id, driver_id, batch, arg_min(lon, seq) AS lon, arg_min(lat, seq) AS lat, arg_min(district_id, seq) AS place FROM {{telemetry}} WHERE kind <> 'hos-remaining' GROUP BY ALL),
h AS (SELECT tenant_id, driver_id, lon AS hlon, lat AS hlat, district_id AS home FROM {{drivers}}),
x AS (SELECT tenant_id, driver_id, batch, {_KINDS} AS kind, max({RANK.format('severity')}) AS rank, max(observed_s) AS raised_s, list(telemetry_id ORDER BY seq) AS ids, count(DISTINCT provider) AS providers
      FROM {{telemetry}} WHERE kind = 'panic' OR (severity <> 'ok' AND {_KINDS} IS NOT NULL) GROUP BY ALL),
e AS (SELECT x.*, substr(sha256(x.tenant_id || '|' || x.driver_id || '|' || kind || '|' || array_to_string(ids, ',')), 1, 24) AS exception_id, coalesce(lon, hlon, 0) AS lon, coalesce(lat, hlat, 0) AS lat, coalesce(place, home, '') AS district_id
      FROM x LEFT JOIN p USING (tenant_id, driver_id, batch) LEFT JOIN h USING (tenant_id, driver_id))"""
CORROBORATED = """
c AS (SELECT * FROM e WHERE kind IN ('panic', 'hos-risk') OR providers >= 2 OR EXISTS (SELECT 1 FROM e o WHERE o.tenant_id = e.tenant_id AND o.driver_id = e.driver_id AND o.kind <> e.kind AND abs(o.raised_s - e.raised_s) <= 300))"""
_LEADER = "struct_pack(id := exception_id, at_s := raised_s, lon := lon, lat := lat)"
FOLD = f"""
s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, district_id ORDER BY raised_s, exception_id) AS n FROM c WHERE kind IN ('route-deviation', 'prolonged-idle', 'geofence-breach', 'harsh-braking')),
f AS (SELECT tenant_id, district_id, n, [{_LEADER}] AS leaders, exception_id, exception_id AS leader_id FROM s WHERE n = 1
      UNION ALL
      SELECT tenant_id, district_id, n, CASE WHEN len(hit) = 0 THEN list_append(leaders, {_LEADER}) ELSE leaders END, exception_id, CASE WHEN len(hit) = 0 THEN exception_id ELSE hit[1].id END
      FROM (SELECT s.tenant_id, s.district_id, s.n, f.leaders, s.exception_id, s.raised_s, s.lon, s.lat, list_filter(f.leaders, lambda l: abs(l.at_s - s.raised_s) <= 900 AND {km('l.lon', 'l.lat', 's.lon', 's.lat')} <= 3) AS hit
            FROM f JOIN s ON f.tenant_id = s.tenant_id AND f.district_id = s.district_id AND s.n = f.n + 1)),
m AS (SELECT exception_id, leader_id FROM f UNION ALL SELECT exception_id, exception_id FROM c WHERE kind IN ('panic', 'hos-risk')),
g AS (SELECT c.*, leader_id FROM c JOIN m USING (exception_id)),
i AS (SELECT tenant_id, leader_id, max(rank) AS rank, count(*) AS members, list(driver_id ORDER BY raised_s, exception_id) AS all_drivers, min(CASE kind WHEN 'panic' THEN 1 WHEN 'harsh-braking' THEN 2 WHEN 'route-deviation' THEN 3 WHEN 'geofence-breach' THEN 4 WHEN 'hos-risk' THEN 5 ELSE 6 END) AS first_kind,
             arg_min(district_id, CASE WHEN exception_id = leader_id THEN 0 ELSE 1 END) AS district_id, list(exception_id ORDER BY raised_s, exception_id) AS exception_ids FROM g GROUP BY ALL)"""
RECURSIVE = "WITH RECURSIVE " + EXCEPTIONS.strip() + "," + CORROBORATED + "," + FOLD


def exceptions_of(t) -> DataFrame:
    return pipeline.evaluate(t.readings, t.drivers, by=("batch",))


@query("evaluate_rules", "WITH " + EXCEPTIONS.strip() + f" SELECT tenant_id, exception_id, driver_id, district_id, kind, {LEVEL.format('rank')} AS severity, len(ids) AS readings, providers, raised_s FROM e")
def evaluate_rules(t):
    e = exceptions_of(t)
    return e.select("tenant_id", "exception_id", "driver_id", "district_id", "kind", "severity", F.size("telemetry_ids").cast("long").alias("readings"), F.size("providers").cast("long").alias("providers"), F.unix_timestamp("raised_at").alias("raised_s"))


@query("corroborated_exists", "WITH " + EXCEPTIONS.strip() + "," + CORROBORATED + " SELECT exception_id, kind FROM c")
def corroborated_exists(t):
    return pipeline.corroborated(exceptions_of(t)).select("exception_id", "kind")


@query("incident_merge", RECURSIVE + " SELECT exception_id, leader_id FROM g")
def incident_merge(t):
    return pipeline.merge(pipeline.corroborated(exceptions_of(t)), ["exception_id"]).select("exception_id", "leader_id")


_TITLES = "CASE first_kind WHEN 1 THEN 'PANIC ALERT' WHEN 2 THEN 'Harsh braking' WHEN 3 THEN 'Route deviation' WHEN 4 THEN 'Geofence breach' WHEN 5 THEN 'Hours-of-service risk' ELSE 'Prolonged idle' END"


@query("incident_assembly", RECURSIVE + f" SELECT substr(sha256(tenant_id || '|' || leader_id), 1, 24) AS incident_id, {LEVEL.format('rank')} AS severity, district_id, members, len(list_distinct(all_drivers)) AS drivers, CASE WHEN len(list_distinct(all_drivers)) > 1 THEN {_TITLES} || ' affecting ' || len(list_distinct(all_drivers)) || ' drivers in ' || district_id ELSE {_TITLES} || ' - driver ' || all_drivers[1] END AS title FROM i")
def incident_assembly(t):
    found = pipeline.detect(exceptions_of(t))
    return found.select("incident_id", "severity", "district_id", F.size("exception_ids").cast("long").alias("members"), F.size("driver_ids").cast("long").alias("drivers"), "title")


@query("dominant_kind", "WITH " + EXCEPTIONS.strip() + " SELECT tenant_id, district_id, arg_min(kind, CASE kind WHEN 'panic' THEN 1 WHEN 'harsh-braking' THEN 2 WHEN 'route-deviation' THEN 3 WHEN 'hos-risk' THEN 5 ELSE 6 END) AS kind FROM e GROUP BY ALL")
def dominant_kind(t):
    return exceptions_of(t).groupBy("tenant_id", "district_id").agg(F.min_by("kind", rules.kind_order(F.col("kind"))).alias("kind"))


@query("held_back_anti", RECURSIVE + " SELECT exception_id, kind FROM e WHERE exception_id NOT IN (SELECT exception_id FROM g)")
def held_back_anti(t):
    e = exceptions_of(t)
    paged = pipeline.detect(e).select(F.explode("exception_ids").alias("exception_id"))
    return e.join(paged, "exception_id", "left_anti").select("exception_id", "kind")


@query("incident_spread", RECURSIVE + f", d AS (SELECT i.tenant_id, leader_id, lon, lat FROM (SELECT tenant_id, leader_id, unnest(list_distinct(all_drivers)) AS driver_id FROM i) i JOIN {{drivers}} d ON i.driver_id = d.driver_id AND i.tenant_id = d.tenant_id) SELECT substr(sha256(a.tenant_id || '|' || a.leader_id), 1, 24) AS incident_id, {up('max(' + km('a.lon', 'a.lat', 'b.lon', 'b.lat') + ')', 1)} AS spread_km FROM d a JOIN d b ON a.tenant_id = b.tenant_id AND a.leader_id = b.leader_id GROUP BY a.tenant_id, a.leader_id")
def incident_spread(t):
    return pipeline.spread_km(pipeline.detect(exceptions_of(t)), t.drivers).select("incident_id", "spread_km")


@query("pipeline_counts", RECURSIVE + " SELECT 'telemetry' AS record, count(*) AS n FROM {telemetry} UNION ALL SELECT 'exceptions', count(*) FROM e UNION ALL SELECT 'incidents', count(*) FROM i UNION ALL SELECT 'drivers', count(*) FROM {drivers}")
def pipeline_counts(t):
    e = exceptions_of(t)
    parts = {"telemetry": t.telemetry, "exceptions": e, "incidents": pipeline.detect(e), "drivers": t.drivers}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("record"), "n") for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("published_events", RECURSIVE + " SELECT 'ExceptionRaised' AS detail_type, count(*) AS n FROM e UNION ALL SELECT 'IncidentOpened', count(*) FROM i")
def published_events(t):
    e = exceptions_of(t)
    return pipeline.events_of(e, pipeline.detect(e)).groupBy("detail_type").agg(F.count("*").alias("n"))


@query("fold_driver_state", """
WITH p AS (SELECT tenant_id, driver_id, arg_max(lon, concat(observed_s, telemetry_id)) AS plon FROM {telemetry} WHERE kind NOT IN ('hos-remaining') AND kind = 'position' GROUP BY ALL),
h AS (SELECT tenant_id, driver_id, arg_max(value, concat(observed_s, telemetry_id)) AS hos FROM {telemetry} WHERE kind = 'hos-remaining' GROUP BY ALL)
SELECT driver_id, coalesce(plon, lon) AS lon, coalesce(CAST(trunc(hos) AS INT), hos_remaining_minutes) AS hos FROM {drivers} LEFT JOIN p USING (tenant_id, driver_id) LEFT JOIN h USING (tenant_id, driver_id)""")
def fold_driver_state(t):
    drivers = t.drivers.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return pipeline.fold_drivers(drivers, t.readings).select("driver_id", "lon", F.col("hos_remaining_minutes").alias("hos"))


@query("route_adherence", """
WITH e AS (SELECT corridor_id, district_id, pos, lon AS bx, lat AS b_y, lag(lon) OVER w AS ax, lag(lat) OVER w AS ay FROM {corridor_points} WINDOW w AS (PARTITION BY corridor_id ORDER BY pos)),
m AS (SELECT seq, corridor_id, min(((ax - lon) * kx + s * dx) * ((ax - lon) * kx + s * dx) + ((ay - lat) * 111320 + s * dy) * ((ay - lat) * 111320 + s * dy)) AS sq FROM (
    SELECT *, greatest(0.0, least(1.0, -((ax - lon) * kx * dx + (ay - lat) * 111320 * dy) / (dx * dx + dy * dy))) AS s FROM (
        SELECT r.seq, r.lon, r.lat, e.*, 111320 * cos(radians(r.lat)) AS kx, (bx - ax) * 111320 * cos(radians(r.lat)) AS dx, (b_y - ay) * 111320 AS dy
        FROM {telemetry} r JOIN e ON r.district_id = e.district_id WHERE r.kind = 'position' AND ax IS NOT NULL)) GROUP BY ALL)
SELECT severity, count(*) AS n FROM (SELECT seq, CASE WHEN min(floor(sqrt(sq) + 0.5)) >= 1000 THEN 'critical' WHEN min(floor(sqrt(sq) + 0.5)) >= 400 THEN 'warning' ELSE 'ok' END AS severity FROM m GROUP BY seq) GROUP BY severity""")
def route_adherence(t):
    rows = t.readings.where("kind = 'position'").withColumns({"unit": F.lit("kph"), "attributes": F.create_map(F.lit("a"), F.lit("b"))})
    derived = pipeline.route_adherence(rows, t.corridors).where("kind = 'route-adherence'")
    return derived.groupBy("severity").agg(F.count("*").alias("n"))


@query("recent_exceptions", "WITH " + EXCEPTIONS.strip() + " SELECT exception_id, kind, raised_s FROM (SELECT * FROM e WHERE tenant_id = '1' ORDER BY raised_s DESC, exception_id DESC LIMIT 40)")
def recent_exceptions(t):
    view = Engine({"exceptions": exceptions_of(t)}).seen_by(Principal("1"))
    return view.exceptions(limit=40).select("exception_id", "kind", F.unix_timestamp("raised_at").alias("raised_s"))


@query("retained_rows", "SELECT telemetry_id, observed_s FROM {telemetry} WHERE observed_s >= 1788877800 + 1800")
def retained_rows(t):
    as_of = F.to_timestamp_ntz(F.lit("2026-09-10 15:00:00"))  # 48 hours after the view's thirtieth minute
    return sinks.retained(t.telemetry, "observed_at", as_of).select("telemetry_id", "observed_s")
