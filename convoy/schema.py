"""Record types, value lists and thresholds of the fleet model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


POINT = _struct(lon=_D, lat=_D)
PLACE = _struct(lon=_D, lat=_D, district=_S)
TEXTS = T.ArrayType(_S)

RAW = _struct(tenant_id=_S, provider=_S, fetched_at=_TS, payload=_S)
TELEMETRY = _struct(
    tenant_id=_S, telemetry_id=_S, provider=_S, domain=_S, kind=_S, driver_id=_S, source_ref=_S, value=_D, unit=_S,
    severity=_S, observed_at=_TS, location=PLACE, attributes=T.MapType(_S, _S),
)
EXCEPTION = _struct(
    tenant_id=_S, exception_id=_S, driver_id=_S, district_id=_S, kind=_S, severity=_S, telemetry_ids=TEXTS, providers=TEXTS,
    location=POINT, corridor_id=_S, raised_at=_TS,
)
INCIDENT = _struct(
    tenant_id=_S, incident_id=_S, title=_S, severity=_S, status=_S, district_id=_S, driver_ids=TEXTS, exception_ids=TEXTS,
    opened_at=_TS, ai_summary=_S, ai_citations=T.ArrayType(_struct(source=_S, snippet=_S)),
)
DRIVER = _struct(
    tenant_id=_S, driver_id=_S, name=_S, district_id=_S, vehicle_id=_S, status=_S, lon=_D, lat=_D,
    hos_remaining_minutes=T.IntegerType(), updated_at=_TS,
)
TERRITORY = _struct(tenant_id=_S, district_id=_S, name=_S, region=_S, lon=_D, lat=_D)
CORRIDOR = _struct(corridor_id=_S, district_id=_S, name=_S, path=T.ArrayType(POINT))
GEOFENCE = _struct(tenant_id=_S, geofence_id=_S, name=_S, district_id=_S, kind=_S, boundary=T.ArrayType(POINT))

# The model's value lists, severity thresholds and rule constants.
SEVERITIES = ("ok", "info", "warning", "critical")
PROVIDERS = ("samsara", "geotab", "verizon-connect", "motive", "omnitracs", "platform-science", "lytx", "netradyne")
DRIVER_STATUSES = ("driving", "on-break", "off-duty", "stopped")
INCIDENT_STATUSES = ("open", "acknowledged", "resolved")
#: Warning and critical thresholds; a value at the threshold counts.
THRESHOLDS = {
    "position": (200.0, 300.0),
    "speeding": (10.0, 25.0),
    "harsh-brake": (0.35, 0.55),
    "idle": (15.0, 30.0),
    "route-adherence": (400.0, 1000.0),
    "geofence-state": (1.0, 1.0),
    "panic": (1.0, 1.0),
}
#: Minutes of driving left at or below which a clock is a warning, or critical.
HOS_WARNING, HOS_CRITICAL = 60.0, 40.0
#: Reading kind that raises each exception kind.
RULES = {"harsh-brake": "harsh-braking", "idle": "prolonged-idle", "hos-remaining": "hos-risk", "route-adherence": "route-deviation", "panic": "panic"}
#: Readings that raise only with the flag for rules that the defaults leave out.
EXTRA_RULES = {"speeding": "speeding", "geofence-state": "geofence-breach"}
KIND_PRIORITY = ("panic", "harsh-braking", "route-deviation", "geofence-breach", "hos-risk", "prolonged-idle")
TITLES = {
    "geofence-breach": "Geofence breach",
    "harsh-braking": "Harsh braking",
    "route-deviation": "Route deviation",
    "prolonged-idle": "Prolonged idle",
    "hos-risk": "Hours-of-service risk",
    "panic": "PANIC ALERT",
}
LOCATION_CAUSED = ("route-deviation", "prolonged-idle", "geofence-breach", "harsh-braking")
NEEDS_NO_SECOND = ("panic", "hos-risk")
MERGE_KM, MERGE_SECONDS, CORROBORATE_SECONDS = 3.0, 900, 300
#: The southern region's ring of lon and lat.
US_SOUTH = ((-106.0, 25.5), (-93.0, 25.5), (-93.0, 36.5), (-106.0, 36.5), (-106.0, 25.5))
