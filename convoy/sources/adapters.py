"""Vendor payloads to canonical readings.

Each adapter is a payload schema and one expression that turns a parsed payload
into an array of readings; ``normalise`` parses all raw records of a provider,
explodes once, and keeps everything else in projections.  A payload that does not
parse gives no readings and is reported by ``unparsed``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy import schema
from convoy.functions import rules, text

# Conversion factor, duty codes.
KPH_PER_MPH = 1.609344
DUTY_CODES = {"D": "driving", "ON": "on-duty", "OFF": "off-duty", "SB": "sleeper-berth"}


@dataclass(frozen=True)
class Adapter:
    provider: str
    domain: str
    payload: str  #: DDL of the payload
    readings: Callable[[Column], Column]  #: payload -> array of readings


def _attributes(**fields: Column | None) -> Column:
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _reading(kind: str, unit: str, key: Column, driver: Column, ref: Column, value: Column, observed: Column, lon: Column | None = None, lat: Column | None = None, severity: str | None = None, attributes: Column | None = None) -> Column:
    place = F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), F.lit("").alias("district")) if lon is not None else F.lit(None).cast(schema.PLACE)
    number = value.cast("double")
    return F.struct(
        key.alias("key"), F.lit(kind).alias("kind"), driver.alias("driver_id"), ref.alias("source_ref"), number.alias("value"), F.lit(unit).alias("unit"),
        (F.lit(severity) if severity else rules.severity(F.lit(kind), number)).alias("severity"), observed.alias("observed"), place.alias("location"), attributes.alias("attributes"),
    )


def _samsara(p: Column) -> Column:
    def of(v: Column) -> Column:
        gps, engine, harsh = v["gps"], v["engineStates"], v["harshEvent"]
        driver, lon, lat = v["externalIds"]["driverId"], gps["longitude"], gps["latitude"]
        kph = rules.half_up(gps["speedMilesPerHour"] * KPH_PER_MPH, 1)
        position = _reading("position", "kph", F.concat(v["id"], F.lit(":gps")), driver, v["id"], kph, gps["time"], lon, lat, attributes=_attributes(vehicleName=v["name"], heading=gps["headingDegrees"], engineState=engine["value"], nearestAddress=gps["reverseGeo"]["formattedLocation"]))
        idle = _reading("idle", "minutes", F.concat(v["id"], F.lit(":idle")), driver, v["id"], F.coalesce(v["idleMinutes"], F.lit(0)), engine["time"], lon, lat, attributes=_attributes(vehicleName=v["name"], engineState=engine["value"]))
        brake = _reading("harsh-brake", "g", F.concat(v["id"], F.lit(":harsh")), driver, v["id"], harsh["gForce"], harsh["time"], lon, lat, attributes=_attributes(vehicleName=v["name"], label=harsh["behaviourLabel"]))
        return F.array_compact(F.array(position, F.when(engine["value"] == "Idle", idle), F.when(harsh.isNotNull(), brake)))

    return F.flatten(F.transform(p["data"], of))


def _geotab(p: Column) -> Column:
    return F.transform(p["result"], lambda d: _reading(
        "position", "kph", F.concat(d["device"]["id"], F.lit(":gps")), d["driver"]["id"], d["device"]["serialNumber"], d["speed"], d["dateTime"], d["longitude"], d["latitude"],
        attributes=_attributes(driverName=d["driver"]["name"], communicating=d["isDeviceCommunicating"], stateDuration=d["currentStateDuration"]),
    ))


def _verizon(p: Column) -> Column:
    def of(v: Column) -> Column:
        over = v["Speed"] - v["SpeedLimit"]
        at = (v["DriverNumber"], v["VehicleNumber"])
        position = _reading("position", "kph", F.concat(at[1], F.lit(":gps")), *at, v["Speed"], v["UpdateUTC"], v["Longitude"], v["Latitude"], attributes=_attributes(city=v["Address"]["City"], state=v["Address"]["State"]))
        speeding = _reading("speeding", "kph", F.concat(at[1], F.lit(":speeding")), *at, over, v["UpdateUTC"], v["Longitude"], v["Latitude"], attributes=_attributes(observedKph=v["Speed"], postedLimitKph=v["SpeedLimit"]))
        return F.array_compact(F.array(position, F.when(over > 0, speeding)))

    return F.flatten(F.transform(p["Items"], of))


def _motive(p: Column) -> Column:
    def of(row: Column) -> Column:
        log = row["log"]
        return _reading("hos-remaining", "minutes", F.concat(log["driver"]["id"], F.lit(":hos")), log["driver"]["id"], log["driver"]["username"], rules.half_up(log["driving_time_remaining"] / 60), log["updated_at"], attributes=_attributes(dutyStatus=log["current_status"], shiftMinutesRemaining=rules.half_up(log["shift_time_remaining"] / 60).cast("int")))

    return F.transform(p["logs"], of)


def _omnitracs(p: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in DUTY_CODES.items() for x in pair])
    return F.transform(p["hosData"], lambda d: _reading(
        "hos-remaining", "minutes", F.concat(d["driverId"], F.lit(":hos")), d["driverId"], d["driverId"], d["minutesDrivingRemaining"], d["timestampUtc"],
        attributes=_attributes(dutyStatus=F.coalesce(F.try_element_at(codes, d["dutyStatus"]), d["dutyStatus"]), minutesUntilBreak=d["minutesUntilBreakRequired"]),
    ))


def _platform_science(p: Column) -> Column:
    return F.transform(p["duty_status"], lambda d: _reading(
        "hos-remaining", "minutes", F.concat(d["driver_ref"], F.lit(":hos")), d["driver_ref"], d["driver_ref"], d["remaining_drive_minutes"], d["recorded_at"],
        attributes=_attributes(dutyStatus=d["status"], dutyMinutesRemaining=d["remaining_duty_minutes"]),
    ))


def _lytx(p: Column) -> Column:
    def of(e: Column) -> Column:
        first = lambda test: F.get(F.filter(e["behaviors"], test), F.lit(0))
        pressed, braking = first(lambda b: b["name"] == "Panic Button"), first(lambda b: b["name"].startswith("Braking"))
        common = (e["eventId"], e["driverId"], e["vehicleId"])
        panic = _reading("panic", "boolean", *common, F.lit(1.0), e["recordDateTime"], e["longitude"], e["latitude"], "critical", _attributes(behaviour=pressed["name"], reviewStatus=e["status"]))
        others = F.array_join(F.transform(e["behaviors"], lambda b: b["name"]), ", ")
        brake = _reading("harsh-brake", "g", *common, e["triggerGForce"], e["recordDateTime"], e["longitude"], e["latitude"], attributes=_attributes(behaviour=braking["name"], lytxSeverity=braking["severity"], otherBehaviours=others, reviewStatus=e["status"]))
        return F.when(pressed.isNotNull(), panic).when(braking.isNotNull(), brake)

    return F.array_compact(F.transform(p["events"], of))


def _netradyne(p: Column) -> Column:
    def of(a: Column) -> Column:
        at = F.date_format(F.timestamp_millis(a["alertTimeMs"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return _reading("idle", "minutes", a["alertId"], a["driverIdentifier"], a["alertId"], rules.half_up(a["durationSeconds"] / 60), at, a["gps"]["lon"], a["gps"]["lat"], attributes=_attributes(alertType=a["alertType"], netradyneSeverity=a["severity"]))

    return F.transform(F.filter(p["alerts"], lambda a: a["alertType"] == "PROLONGED_IDLE"), of)


ADAPTERS = {
    a.provider: a
    for a in (
        Adapter("samsara", "telematics", "data ARRAY<STRUCT<id STRING, name STRING, externalIds STRUCT<driverId STRING>, gps STRUCT<time STRING, latitude DOUBLE, longitude DOUBLE, speedMilesPerHour DOUBLE, headingDegrees INT, reverseGeo STRUCT<formattedLocation STRING>>, engineStates STRUCT<time STRING, value STRING>, idleMinutes INT, harshEvent STRUCT<time STRING, behaviourLabel STRING, downloadForwardVideoUrl STRING, gForce DOUBLE>>>, pagination STRUCT<endCursor STRING, hasNextPage BOOLEAN>", _samsara),
        Adapter("geotab", "telematics", "result ARRAY<STRUCT<device STRUCT<id STRING, serialNumber STRING>, driver STRUCT<id STRING, name STRING>, dateTime STRING, latitude DOUBLE, longitude DOUBLE, speed DOUBLE, isDeviceCommunicating BOOLEAN, currentStateDuration STRING>>, jsonrpc STRING", _geotab),
        Adapter("verizon-connect", "telematics", "Items ARRAY<STRUCT<VehicleNumber STRING, DriverNumber STRING, UpdateUTC STRING, Latitude DOUBLE, Longitude DOUBLE, Speed DOUBLE, SpeedLimit DOUBLE, Address STRUCT<City STRING, State STRING>>>, TotalCount INT", _verizon),
        Adapter("motive", "eld-hos", "logs ARRAY<STRUCT<log STRUCT<driver STRUCT<id STRING, username STRING>, date STRING, driving_time_remaining INT, shift_time_remaining INT, current_status STRING, updated_at STRING>>>, pagination STRUCT<per_page INT, page_no INT, total INT>", _motive),
        Adapter("omnitracs", "eld-hos", "hosData ARRAY<STRUCT<driverId STRING, dutyStatus STRING, minutesUntilBreakRequired INT, minutesDrivingRemaining DOUBLE, timestampUtc STRING>>", _omnitracs),
        Adapter("platform-science", "eld-hos", "duty_status ARRAY<STRUCT<driver_ref STRING, status STRING, remaining_drive_minutes DOUBLE, remaining_duty_minutes INT, recorded_at STRING>>", _platform_science),
        Adapter("lytx", "video-safety", "events ARRAY<STRUCT<eventId STRING, driverId STRING, vehicleId STRING, recordDateTime STRING, latitude DOUBLE, longitude DOUBLE, behaviors ARRAY<STRUCT<id INT, name STRING, severity STRING>>, triggerGForce DOUBLE, status STRING>>, meta STRUCT<count INT>", _lytx),
        Adapter("netradyne", "video-safety", "alerts ARRAY<STRUCT<alertId STRING, driverIdentifier STRING, alertType STRING, alertTimeMs BIGINT, gps STRUCT<lat DOUBLE, lon DOUBLE>, durationSeconds INT, severity STRING>>", _netradyne),
    )
}


def _parsed(raw: DataFrame, adapter: Adapter) -> DataFrame:
    options = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}
    return raw.where(F.col("provider") == adapter.provider).withColumn("_body", F.from_json("payload", adapter.payload, options))


def normalise(raw: DataFrame, providers: tuple[str, ...] | None = None) -> DataFrame:
    """Readings of all raw records, in the canonical columns; ``seq`` keeps a payload's order."""
    parts = []
    for name in providers or tuple(ADAPTERS):
        a = ADAPTERS[name]
        rows = _parsed(raw, a).select("tenant_id", "provider", "fetched_at", F.posexplode(a.readings(F.col("_body"))).alias("seq", "r"))
        parts.append(rows.select(
            "tenant_id", text.content_id(F.col("provider"), F.col("r.key"), F.col("r.observed")).alias("telemetry_id"), "provider", F.lit(a.domain).alias("domain"), "r.kind", "r.driver_id", "r.source_ref",
            "r.value", "r.unit", "r.severity", F.to_timestamp("r.observed").alias("observed_at"), "r.location", "r.attributes", "fetched_at", "seq",
        ))
    return reduce(DataFrame.unionByName, parts)


def unparsed(raw: DataFrame) -> DataFrame:
    """Raw records whose payload gives nothing to read, with the reason; also those of unknown providers."""
    known = [_parsed(raw, a).where(F.col("_body").isNull() | F.forall(F.array(*[F.col("_body")[f.name].isNull() for f in _fields(a)]), lambda x: x)).select(*raw.columns, F.lit("unreadable payload").alias("reason")) for a in ADAPTERS.values()]
    other = raw.where(~F.coalesce(F.col("provider").isin(*ADAPTERS), F.lit(False))).select(*raw.columns, F.lit("unknown provider").alias("reason"))
    return reduce(DataFrame.unionByName, [*known, other])


def _fields(a: Adapter):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(a.payload).fields
