"""Access patterns, scopes, latest rows and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import rules
from convoy.operators import access, changes, places, sinks
from convoy.operators.access import Engine, Principal
from convoy.plans.registered import LEVEL, RANK, query

SLIM = ("seq", "tenant_id", "driver_id", "kind", "severity", "observed_s")
SLIM_SQL = ", ".join(SLIM)


@query("kv_query_range", f"SELECT {SLIM_SQL} FROM {{telemetry}} WHERE tenant_id = '1' AND telemetry_id BETWEEN '000000000100' AND '000000000900' ORDER BY telemetry_id DESC LIMIT 40")
def kv_query_range(t):
    return access.key_query(t.telemetry, F.col("tenant_id") == "1", "telemetry_id", between=("000000000100", "000000000900"), forward=False, limit=40).select(*SLIM)


@query("kv_query_prefix", f"SELECT {SLIM_SQL} FROM {{telemetry}} WHERE tenant_id = '2' AND starts_with(telemetry_id, '00000000012')")
def kv_query_prefix(t):
    return access.key_query(t.telemetry, F.col("tenant_id") == "2", "telemetry_id", prefix="00000000012").select(*SLIM)


@query("gsi_by_district", "SELECT driver_id, status FROM {drivers} WHERE district_id = '7' AND tenant_id = '0' AND status <> 'off-duty'")
def gsi_by_district(t):
    rows = access.key_query(t.drivers.where("status <> 'off-duty'"), (F.col("district_id") == "7") & (F.col("tenant_id") == "0"), "driver_id")
    return rows.select("driver_id", "status")


@query("full_scan", "SELECT severity, count(*) AS n FROM {telemetry} GROUP BY severity")
def full_scan(t):
    return t.telemetry.groupBy("severity").agg(F.count("*").alias("n"))


@query("point_get", "SELECT driver_id, name, district_id, status FROM {drivers} WHERE tenant_id = '0' AND driver_id = '42'")
def point_get(t):
    return Engine({"drivers": t.drivers, "territories": t.territories}).seen_by(Principal("0")).driver("42").select("driver_id", "name", "district_id", "status")


@query("drivers_in_district", "SELECT driver_id, name FROM {drivers} WHERE tenant_id = '1' AND district_id = '4'")
def drivers_in_district(t):
    return Engine({"drivers": t.drivers}).seen_by(Principal("1")).drivers(district="4").select("driver_id", "name")


@query("recent_topk", f"SELECT {SLIM_SQL} FROM {{telemetry}} WHERE tenant_id = '0' ORDER BY observed_at DESC, telemetry_id DESC LIMIT 25")
def recent_topk(t):
    return Engine({"telemetry": t.telemetry}).seen_by(Principal("0")).telemetry(25).select(*SLIM)


@query("driver_history", f"SELECT {SLIM_SQL} FROM {{telemetry}} WHERE tenant_id = '1' AND driver_id = '4' AND observed_s >= 1788878800")
def driver_history(t):
    import datetime

    since = datetime.datetime(2026, 9, 8, 14, 46, 40)
    return Engine({"telemetry": t.telemetry}).seen_by(Principal("1")).driver_history("4", since).select(*SLIM)


@query("limit_then_filter", f"SELECT {SLIM_SQL} FROM (SELECT * FROM {{telemetry}} WHERE tenant_id = '2' ORDER BY observed_at DESC, telemetry_id DESC LIMIT 500) WHERE severity = 'critical'")
def limit_then_filter(t):
    return Engine({"telemetry": t.telemetry}).seen_by(Principal("2")).telemetry(severity="critical").select(*SLIM)


@query("open_incidents", "SELECT incident_id, status FROM (SELECT * FROM {incidents} WHERE tenant_id = '1' ORDER BY opened_at DESC, incident_id DESC LIMIT 25) WHERE status <> 'resolved'")
def open_incidents(t):
    return Engine({"incidents": t.incidents}).seen_by(Principal("1")).incidents().select("incident_id", "status")


@query("incident_by_id", "SELECT incident_id, severity, status FROM {incidents} WHERE tenant_id = CAST((SELECT o_custkey % 3 FROM {orders} WHERE o_orderkey = 77) AS STRING) AND incident_id = '000000000077'")
def incident_by_id(t):
    one = t.incidents.where("incident_id = '000000000077'")
    tenant = t.orders.where("o_orderkey = 77").select((F.col("o_custkey") % 3).cast("string").alias("tenant_id"))
    return access.key_query(one.join(F.broadcast(tenant), "tenant_id", "left_semi"), F.lit(True), "incident_id", limit=1).select("incident_id", "severity", "status")


@query("rls_tenant", "SELECT tenant_id, count(*) AS n FROM {incidents} WHERE tenant_id = '2' GROUP BY tenant_id")
def rls_tenant(t):
    seen = t.incidents.where(access.tenant_rows(Principal("2"))).unionByName(t.incidents.where(access.tenant_rows(Principal(None))))
    return seen.groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("scope_district", "SELECT driver_id FROM {drivers} WHERE tenant_id = '1' AND district_id = '3'")
def scope_district(t):
    return access.in_scope(t.drivers, Principal("1", "district", "3")).select("driver_id")


@query("scope_driver", "SELECT driver_id, district_id FROM {drivers} WHERE tenant_id = '2' AND driver_id = '5'")
def scope_driver(t):
    p = Principal("2", "driver", driver_id="5")
    return access.in_scope(t.drivers, p).select("driver_id", "district_id").unionByName(access.in_scope(t.incidents, p).select(F.col("incident_id").alias("driver_id"), "district_id"))


@query("scope_region", "SELECT driver_id FROM {drivers} WHERE tenant_id = '0' AND district_id IN (SELECT district_id FROM {territories} WHERE region = 'ASIA')")
def scope_region(t):
    return access.in_scope(t.drivers, Principal("0", "region", region="ASIA"), t.territories).select("driver_id")


@query("rls_two_level", "SELECT 'all' AS policy, driver_id FROM {drivers} WHERE tenant_id = '0' UNION ALL SELECT 'one', driver_id FROM {drivers} WHERE tenant_id = '0' AND district_id = '9'")
def rls_two_level(t):
    pick = lambda name, district: t.drivers.where(access.two_level("0", district)).select(F.lit(name).alias("policy"), "driver_id")
    return pick("all", "").unionByName(pick("one", "9"))


@query("optional_filters", "SELECT driver_id, status FROM {drivers} WHERE tenant_id = '0' AND district_id = '6' AND status = 'stopped' UNION ALL SELECT driver_id, status FROM {drivers} WHERE tenant_id = '1' AND status = 'driving'")
def optional_filters(t):
    engine = Engine({"drivers": t.drivers})
    return engine.seen_by(Principal("0")).drivers("6", "stopped").unionByName(engine.seen_by(Principal("1")).drivers(status="driving")).select("driver_id", "status")


@query("quarantine_split", "SELECT CASE WHEN d IS NULL THEN 'no driver' WHEN bad THEN 'value is not a finite number' ELSE 'good' END AS reason, count(*) AS n FROM (SELECT CASE WHEN seq % 89 = 0 THEN NULL ELSE driver_id END AS d, seq % 97 = 0 OR seq % 101 = 0 OR value IS NULL AS bad FROM {telemetry}) GROUP BY ALL")
def quarantine_split(t):
    value = F.when(F.col("seq") % 97 == 0, float("nan")).when(F.col("seq") % 101 == 0, float("inf")).otherwise(F.col("value"))
    good, bad = sinks.quarantine(t.telemetry.withColumns({"value": value, "driver_id": F.when(F.col("seq") % 89 == 0, F.lit(None)).otherwise(F.col("driver_id"))}))
    return good.withColumn("reason", F.lit("good")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


@query("keyset_page", "SELECT seq, observed_s FROM {telemetry} WHERE tenant_id = '1' AND (observed_s < 1788880000 OR (observed_s = 1788880000 AND telemetry_id < '000000001000')) ORDER BY observed_s DESC, telemetry_id DESC LIMIT 30")
def keyset_page(t):
    rows = t.telemetry.where("tenant_id = '1'")
    return access.keyset_page(rows, "observed_s", "telemetry_id", 30, (1788880000, "000000001000")).select("seq", "observed_s")


@query("latest_per_key", "SELECT tenant_id, driver_id, kind, value, observed_s FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, driver_id, kind ORDER BY observed_at DESC, telemetry_id DESC) AS n FROM {telemetry}) WHERE n = 1")
def latest_per_key(t):
    return sinks.latest(t.telemetry, ["tenant_id", "driver_id", "kind"], F.col("observed_at"), F.col("telemetry_id")).select("tenant_id", "driver_id", "kind", "value", "observed_s")


@query("lateral_topn", f"SELECT {SLIM_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, driver_id ORDER BY observed_at DESC, telemetry_id DESC) AS n FROM {{telemetry}} WHERE severity <> 'ok') WHERE n <= 5")
def lateral_topn(t):
    return places.latest_by(t.telemetry.where("severity <> 'ok'"), ["tenant_id", "driver_id"], [F.desc("observed_at"), F.desc("telemetry_id")], 5).select(*SLIM)


@query("upsert_last_wins", "SELECT driver_id, CASE WHEN CAST(driver_id AS BIGINT) % 10 = 0 THEN 'off-duty' ELSE status END AS status FROM {drivers} UNION ALL SELECT 'new', 'driving'")
def upsert_last_wins(t):
    current = t.drivers.select("driver_id", "status")
    changes = current.where(F.col("driver_id").cast("bigint") % 10 == 0).withColumn("status", F.lit("off-duty"))
    return sinks.upsert(current, changes.unionByName(t.spark.createDataFrame([("new", "driving")], "driver_id string, status string")), ["driver_id"])


@query("feed_upsert", "SELECT incident_id, status, severity FROM (SELECT incident_id, CASE WHEN CAST(incident_id AS BIGINT) % 3 = 0 THEN 'acknowledged' ELSE status END AS status, severity, opened_at FROM {incidents}) ORDER BY opened_at DESC, incident_id DESC LIMIT 100")
def feed_upsert(t):
    snapshot = t.incidents.withColumn("_from", F.lit(0))
    live = snapshot.where(F.col("incident_id").cast("bigint") % 3 == 0).withColumns({"status": F.lit("acknowledged"), "_from": F.lit(1)})
    rows = sinks.latest(snapshot.unionByName(live), ["incident_id"], F.col("_from"))
    return rows.orderBy(F.desc("opened_at"), F.desc("incident_id")).limit(100).select("incident_id", "status", "severity")


@query("any_array_join", "SELECT incident_id, d.driver_id, d.status FROM (SELECT tenant_id, incident_id, unnest(driver_ids) AS driver_id FROM {incidents} WHERE status <> 'resolved') i JOIN {drivers} d ON i.driver_id = d.driver_id AND i.tenant_id = d.tenant_id")
def any_array_join(t):
    open_ = t.incidents.where("status <> 'resolved'").select("tenant_id", "incident_id", F.explode("driver_ids").alias("driver_id"))
    return open_.join(t.drivers.select("tenant_id", "driver_id", F.col("status").alias("s")), ["tenant_id", "driver_id"]).select("incident_id", "driver_id", F.col("s").alias("status"))


@query("ordered_lookup", "SELECT incident_id, pos, d.driver_id, d.name FROM (SELECT tenant_id, incident_id, unnest(driver_ids) AS driver_id, unnest(range(0, len(driver_ids))) AS pos FROM {incidents}) i JOIN {drivers} d ON i.driver_id = d.driver_id AND i.tenant_id = d.tenant_id")
def ordered_lookup(t):
    ids = t.incidents.select("tenant_id", "incident_id", F.posexplode("driver_ids").alias("pos", "driver_id"))
    return ids.join(t.drivers, ["tenant_id", "driver_id"]).select("incident_id", "pos", "driver_id", "name")


@query("semi_limited", f"SELECT {SLIM_SQL} FROM (SELECT * FROM {{telemetry}} ORDER BY observed_at DESC, telemetry_id DESC LIMIT 500) WHERE driver_id IN (SELECT unnest(driver_ids) FROM {{incidents}} WHERE severity = 'critical')")
def semi_limited(t):
    newest = t.telemetry.orderBy(F.desc("observed_at"), F.desc("telemetry_id")).limit(500)
    wanted = t.incidents.where("severity = 'critical'").select(F.explode("driver_ids").alias("driver_id")).distinct()
    return newest.join(wanted, "driver_id", "left_semi").select(*SLIM)


@query("tick_overlay", "SELECT d.driver_id, coalesce(x.value, d.lon) AS place FROM {drivers} d LEFT JOIN (SELECT tenant_id, driver_id, arg_max(value, seq) AS value FROM {telemetry} WHERE kind = 'position' GROUP BY ALL) x ON d.tenant_id = x.tenant_id AND d.driver_id = x.driver_id WHERE d.status <> 'off-duty'")
def tick_overlay(t):
    tick = t.telemetry.where("kind = 'position'").groupBy("tenant_id", "driver_id").agg(F.max_by("value", "seq").alias("v"))
    return t.drivers.where("status <> 'off-duty'").join(tick, ["tenant_id", "driver_id"], "left").select("driver_id", F.coalesce("v", "lon").alias("place"))


@query("driver_summary", "SELECT tenant_id, driver_id, count(*) AS n, count_if(severity <> 'ok') AS flagged, array_to_string(list(telemetry_id ORDER BY observed_at DESC, telemetry_id DESC)[1:12], ',') AS newest FROM {telemetry} GROUP BY tenant_id, driver_id")
def driver_summary(t):
    last = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("observed_at", "telemetry_id")), asc=False), 1, 12), lambda x: x["telemetry_id"]), ",")
    kept = t.telemetry.withColumn("_n", F.row_number().over(Window.partitionBy("tenant_id", "driver_id").orderBy(F.desc("observed_at"), F.desc("telemetry_id"))))
    newest = kept.where("_n <= 12").groupBy("tenant_id", "driver_id").agg(last.alias("newest"))
    counts = t.telemetry.groupBy("tenant_id", "driver_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") != "ok").alias("flagged"))
    return counts.join(newest, ["tenant_id", "driver_id"])


@query("provider_count", "SELECT tenant_id, driver_id, count(DISTINCT provider) AS n FROM {telemetry} GROUP BY ALL")
def provider_count(t):
    return t.telemetry.groupBy("tenant_id", "driver_id").agg(F.countDistinct("provider").alias("n"))


@query("board_tallies", "SELECT tenant_id, count_if(kind = 'position' AND value > 0) AS moving, count_if(severity = 'critical') AS critical, count(*) AS readings FROM {telemetry} GROUP BY tenant_id")
def board_tallies(t):
    return t.telemetry.groupBy("tenant_id").agg(F.count_if((F.col("kind") == "position") & (F.col("value") > 0)).alias("moving"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count("*").alias("readings"))


@query("flagged_drivers", "SELECT DISTINCT unnest(driver_ids) AS driver_id FROM {incidents} WHERE severity IN ('warning', 'critical')")
def flagged_drivers(t):
    return t.incidents.where("severity IN ('warning', 'critical')").select(F.explode("driver_ids").alias("driver_id")).distinct()


@query("batch_counts", "SELECT shard, count(*) AS records, CAST(ceil(count(*) / 500) AS BIGINT) AS batches FROM (SELECT CAST(('0x' || substr(sha256(driver_id), 1, 8))::BIGINT % 4 AS INT) AS shard FROM {telemetry}) GROUP BY shard")
def batch_counts(t):
    return t.telemetry.groupBy(rules.shard_of(F.col("driver_id"), 4).alias("shard")).agg(F.count("*").alias("records")).withColumn("batches", F.ceil(F.col("records") / 500))


@query("acknowledge", f"SELECT incident_id, CASE WHEN CAST(incident_id AS BIGINT) = 12 THEN 'acknowledged' ELSE status END AS status, {LEVEL.format(RANK.format('severity'))} AS severity FROM {{incidents}} WHERE tenant_id = CAST((SELECT o_custkey % 3 FROM {{orders}} WHERE o_orderkey = 12) AS STRING)")
def acknowledge(t):
    mine = t.incidents.join(F.broadcast(t.orders.where("o_orderkey = 12").select((F.col("o_custkey") % 3).cast("string").alias("tenant_id"))), "tenant_id", "left_semi")
    change = mine.where("incident_id = '000000000012'").withColumn("status", F.lit("acknowledged"))
    return sinks.upsert(mine, change, ["incident_id"]).select("incident_id", "status", "severity")


@query("as_of_clock", "SELECT p.seq, h.value AS hos FROM {telemetry} p ASOF LEFT JOIN (SELECT tenant_id, driver_id, observed_s, max(value) AS value FROM {telemetry} WHERE kind = 'hos-remaining' GROUP BY ALL) h ON p.tenant_id = h.tenant_id AND p.driver_id = h.driver_id AND p.observed_s >= h.observed_s WHERE p.kind = 'position'")
def as_of_clock(t):
    """Positions with the driver's clock at that moment: both kinds along one window, the last clock carried on."""
    clocks = t.telemetry.where("kind = 'hos-remaining'").groupBy("tenant_id", "driver_id", "observed_s").agg(F.max("value").alias("clock"))
    both = t.telemetry.where("kind = 'position'").select("tenant_id", "driver_id", "observed_s", "seq").unionByName(clocks, allowMissingColumns=True)
    along = Window.partitionBy("tenant_id", "driver_id").orderBy("observed_s").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("hos", F.last("clock", ignorenulls=True).over(along)).where("seq IS NOT NULL").select("seq", "hos")


_N = "CAST(driver_id AS BIGINT)"
#: Three versions of the drivers' table: rows come, change and go.
_V0 = f"SELECT driver_id, status, hos_remaining_minutes AS hos FROM {{drivers}} WHERE {_N} % 10 <> 0"
_V1 = f"SELECT driver_id, CASE WHEN {_N} % 5 = 0 THEN 'off-duty' ELSE status END AS status, hos_remaining_minutes AS hos FROM {{drivers}} WHERE {_N} % 7 <> 0"
_V2 = f"SELECT driver_id, CASE WHEN {_N} % 5 = 0 THEN 'off-duty' ELSE status END AS status, CASE WHEN {_N} % 3 = 0 THEN CAST(NULL AS INT) ELSE hos_remaining_minutes END AS hos FROM {{drivers}} WHERE {_N} % 11 <> 0"


def _versions(t):
    return [t.spark.sql(v, drivers=t.drivers) for v in (_V0, _V1, _V2)]


@query("change_log", f"""
SELECT driver_id, op, shard, row_number() OVER (PARTITION BY shard ORDER BY driver_id) AS number, was, now FROM (
    SELECT coalesce(b.driver_id, a.driver_id) AS driver_id, CASE WHEN a.driver_id IS NULL THEN 'insert' WHEN b.driver_id IS NULL THEN 'delete' ELSE 'update' END AS op,
        CAST(('0x' || substr(sha256('{{"0":"' || coalesce(b.driver_id, a.driver_id) || '"}}'), 1, 8))::BIGINT % 64 AS INT) AS shard, a.status AS was, b.status AS now
    FROM ({_V0}) a FULL JOIN ({_V1}) b ON a.driver_id = b.driver_id WHERE a.driver_id IS NULL OR b.driver_id IS NULL OR a.status IS DISTINCT FROM b.status OR a.hos IS DISTINCT FROM b.hos)""")
def change_log(t):
    before, after, _ = _versions(t)
    return changes.changes(before, after, ["driver_id"], 1).select("driver_id", "op", "shard", "number", F.col("before.status").alias("was"), F.col("after.status").alias("now"))


@query("replayed_table", _V2)
def replayed_table(t):
    """The third version, from the first and the changes to the second and third."""
    first, second, third = _versions(t)
    log = changes.changes(first, second, ["driver_id"], 1).unionByName(changes.changes(second, third, ["driver_id"], 2))
    return changes.replay(first, log, ["driver_id"], 2)
