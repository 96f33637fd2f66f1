"""Vendor adapters over payloads built from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.plans.registered import query, up
from convoy.plans.views import severity
from convoy.sources import adapters, registry

_AT = "2026-09-08T14:30:00Z"


def _raw(t, provider: str, payload: Column) -> DataFrame:
    return t.events.select(F.lit("acme").alias("tenant_id"), F.lit(provider).alias("provider"), F.lit(_AT).cast("timestamp").alias("fetched_at"), F.to_json(payload).alias("payload"))


def _named(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def _key(prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col("event_id").cast("string"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("telemetry_id", "kind", "driver_id", "value", "severity")


def _sql(provider: str, key: str, kind: str, value: str, where: str = "true", level: str | None = None) -> str:
    return f"SELECT substr(sha256('{provider}|' || {key} || '|{_AT}'), 1, 24) AS telemetry_id, '{kind}' AS kind, CAST(user_id AS STRING) AS driver_id, CAST({value} AS DOUBLE) AS value, {level or severity(repr(kind), f'CAST({value} AS DOUBLE)')} AS severity FROM {{events}} WHERE {where}"


_MPH = up("value * 1.609344::DOUBLE", 1)


def samsara_raw(t):
    """Raw records of vehicles, one for each event."""
    engine = F.when(F.col("event_type") == "click", "Idle").otherwise("On")
    gps = _named(time=F.lit(_AT), latitude=F.lit(30.5), longitude=F.lit(-97.5), speedMilesPerHour="value", headingDegrees=F.lit(10), reverseGeo=_named(formattedLocation=F.lit("x")))
    harsh = F.when(F.col("event_type") == "error", _named(time=F.lit(_AT), behaviourLabel=F.lit("Harsh"), gForce=F.col("value") / 300))
    vehicle = _named(id=_key(), name=_key("v"), externalIds=_named(driverId=F.col("user_id").cast("string")), gps=gps, engineStates=_named(time=F.lit(_AT), value=engine), idleMinutes=F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 40), harshEvent=harsh)
    return _raw(t, "samsara", _named(data=F.array(vehicle)))


@query("norm_fanout", " UNION ALL ".join([
    _sql("samsara", "event_id || ':gps'", "position", _MPH),
    _sql("samsara", "event_id || ':idle'", "idle", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 40 END", "event_type = 'click'"),
    _sql("samsara", "event_id || ':harsh'", "harsh-brake", "value / 300", "event_type = 'error'"),
]))
def norm_fanout(t):
    return _out(adapters.normalise(samsara_raw(t), ("samsara",)))


@query("norm_passthrough", _sql("geotab", "event_id || ':gps'", "position", "value"))
def norm_passthrough(t):
    row = _named(device=_named(id=_key(), serialNumber=_key("s")), driver=_named(id=F.col("user_id").cast("string"), name=F.lit("n")), dateTime=F.lit(_AT), latitude=F.lit(1.0), longitude=F.lit(2.0), speed="value", isDeviceCommunicating=F.lit(True), currentStateDuration=F.lit("1"))
    return _out(adapters.normalise(_raw(t, "geotab", _named(result=F.array(row))), ("geotab",)))


@query("norm_speeding", _sql("verizon-connect", "event_id || ':gps'", "position", "value") + " UNION ALL " + _sql("verizon-connect", "event_id || ':speeding'", "speeding", "value - event_id % 60", "value - event_id % 60 > 0"))
def norm_speeding(t):
    row = _named(VehicleNumber=_key(), DriverNumber=F.col("user_id").cast("string"), UpdateUTC=F.lit(_AT), Latitude=F.lit(1.0), Longitude=F.lit(2.0), Speed="value", SpeedLimit=(F.col("event_id") % 60).cast("double"), Address=_named(City=F.lit("c"), State=F.lit("s")))
    return _out(adapters.normalise(_raw(t, "verizon-connect", _named(Items=F.array(row))), ("verizon-connect",)))


@query("norm_units", _sql("motive", "user_id || ':hos'", "hos-remaining", "floor(event_id * 7 % 9000 / 60 + 0.5)"))
def norm_units(t):
    log = _named(driver=_named(id=F.col("user_id").cast("string"), username=_key("u")), date=F.lit("d"), driving_time_remaining=F.col("event_id") * 7 % 9000, shift_time_remaining=F.col("event_id") * 11 % 9000, current_status=F.lit("driving"), updated_at=F.lit(_AT))
    return _out(adapters.normalise(_raw(t, "motive", _named(logs=F.array(_named(log=log)))), ("motive",)))


@query("map_lookup", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'driving' WHEN 1 THEN 'on-duty' WHEN 2 THEN 'off-duty' WHEN 3 THEN 'sleeper-berth' ELSE 'YM' END AS duty, CAST(event_id % 50 AS DOUBLE) AS value FROM {events}")
def map_lookup(t):
    code = F.get(F.array(*map(F.lit, ("D", "ON", "OFF", "SB", "YM"))), (F.col("event_id") % 5).cast("int"))
    row = _named(driverId=_key(), dutyStatus=code, minutesUntilBreakRequired=F.lit(5), minutesDrivingRemaining=(F.col("event_id") % 50).cast("double"), timestampUtc=F.lit(_AT))
    found = adapters.normalise(_raw(t, "omnitracs", _named(hosData=F.array(row))), ("omnitracs",))
    return found.select(F.col("driver_id").cast("bigint").alias("event_id"), F.col("attributes")["dutyStatus"].alias("duty"), "value")


@query("norm_duty", _sql("platform-science", "user_id || ':hos'", "hos-remaining", "event_id % 90"))
def norm_duty(t):
    row = _named(driver_ref=F.col("user_id").cast("string"), status=F.lit("driving"), remaining_drive_minutes=(F.col("event_id") % 90).cast("double"), remaining_duty_minutes=F.lit(9), recorded_at=F.lit(_AT))
    return _out(adapters.normalise(_raw(t, "platform-science", _named(duty_status=F.array(row))), ("platform-science",)))


@query("array_first_match", _sql("lytx", "'E' || event_id", "panic", "1", "event_id % 7 = 0", "'critical'") + " UNION ALL " + _sql("lytx", "'E' || event_id", "harsh-brake", "value / 300", "event_id % 7 <> 0 AND event_id % 2 = 0"))
def array_first_match(t):
    behaviour = lambda n: _named(id=F.lit(1), name=F.lit(n), severity=F.lit("High"))
    names = F.array_compact(F.array(behaviour("Following"), F.when(F.col("event_id") % 2 == 0, behaviour("Braking - Hard")), F.when(F.col("event_id") % 7 == 0, behaviour("Panic Button"))))
    row = _named(eventId=_key("E"), driverId=F.col("user_id").cast("string"), vehicleId=_key("v"), recordDateTime=F.lit(_AT), latitude=F.lit(1.0), longitude=F.lit(2.0), behaviors=names, triggerGForce=F.col("value") / 300, status=F.lit("New"))
    return _out(adapters.normalise(_raw(t, "lytx", _named(events=F.array(row))), ("lytx",)))


@query("epoch_ms", f"SELECT substr(sha256('netradyne|' || 'A' || event_id || '|' || strftime(make_timestamp(CAST((1788877800000 + event_id * 1001) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'), 1, 24) AS telemetry_id, CAST(floor(event_id * 13 % 4000 / 60 + 0.5) AS DOUBLE) AS value, {severity(repr('idle'), 'floor(event_id * 13 % 4000 / 60 + 0.5)')} AS severity FROM {{events}} WHERE event_type <> 'view'")
def epoch_ms(t):
    row = _named(alertId=_key("A"), driverIdentifier=F.lit("d"), alertType=F.when(F.col("event_type") == "view", "SPEED").otherwise("PROLONGED_IDLE"), alertTimeMs=F.col("event_id") * 1001 + 1788877800000, gps=_named(lat=F.lit(1.0), lon=F.lit(2.0)), durationSeconds=F.col("event_id") * 13 % 4000, severity=F.lit("x"))
    return adapters.normalise(_raw(t, "netradyne", _named(alerts=F.array(row))), ("netradyne",)).select("telemetry_id", "value", "severity")


_TENANTS = ("acme-freight", "northstar-logistics", "pinnacle-transport", "someone-else")


@query("tenant_provider_semi", f"SELECT event_id FROM (SELECT event_id, {list(_TENANTS)!r}[event_id % 4 + 1] AS tenant, {list(adapters.ADAPTERS)!r}[event_id * 3 % 8 + 1] AS provider FROM {{events}}) WHERE " + " OR ".join(f"(tenant = '{k}' AND provider IN {v!r})" for k, v in registry.TENANT_PROVIDERS.items()) + " OR (tenant = 'someone-else' AND provider = 'samsara')")
def tenant_provider_semi(t):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    rows = t.events.select("event_id", pick(_TENANTS, F.col("event_id") % 4).alias("tenant_id"), pick(list(adapters.ADAPTERS), F.col("event_id") * 3 % 8).alias("provider"))
    return registry.allowed(rows).select("event_id")


@query("unreadable_payloads", "SELECT CASE WHEN event_id % 10 = 0 THEN 'unreadable payload' ELSE 'unknown provider' END AS reason, count(*) AS n FROM {events} WHERE event_id % 10 = 0 OR event_id % 11 = 0 GROUP BY ALL")
def unreadable_payloads(t):
    rows = t.events.select("event_id", F.lit("acme").alias("tenant_id"), F.when((F.col("event_id") % 11 == 0) & (F.col("event_id") % 10 != 0), "nobody").otherwise("geotab").alias("provider"), F.lit(_AT).cast("timestamp").alias("fetched_at"), F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.to_json(_named(result=F.array(_named(speed="value"))))).alias("payload"))
    return adapters.unparsed(rows).groupBy("reason").agg(F.count("*").alias("n"))
