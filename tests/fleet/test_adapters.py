"""Payloads of every vendor, with lists, missing fields and failures, to the readings they stand for."""

import json
from datetime import UTC, datetime

import pytest

from convoy import schema
from convoy.sources import adapters

AT = "2026-10-01T06:00:00.000Z"
MILLIS = int(datetime(2026, 10, 1, 6, tzinfo=UTC).timestamp() * 1000)

#: Per vendor: payload, and of each reading kind, driver, source, value, severity and place.
CASES = {
    "geotab": (
        {"result": [
            {"device": {"id": "b1", "serialNumber": "G1"}, "driver": {"id": "d1", "name": "A"}, "dateTime": AT, "latitude": 1.5, "longitude": 2.5, "speed": 61, "isDeviceCommunicating": True, "currentStateDuration": "00:01"},
            {"device": {"id": "b2", "serialNumber": "G2"}, "driver": {"id": "d2"}, "dateTime": AT, "latitude": 3, "longitude": 4, "speed": None},
        ]},
        [("position", "d1", "G1", 61.0, "ok", (2.5, 1.5)), ("position", "d2", "G2", None, "ok", (4.0, 3.0))],
    ),
    "verizon-connect": (
        {"Items": [
            {"VehicleNumber": "V1", "DriverNumber": "d1", "UpdateUTC": AT, "Latitude": 1, "Longitude": 2, "Speed": 70, "SpeedLimit": 40, "Address": {"City": "X"}},
            {"VehicleNumber": "V2", "DriverNumber": "d2", "UpdateUTC": AT, "Latitude": 1, "Longitude": 2, "Speed": 40, "SpeedLimit": 40},
            {"VehicleNumber": "V3", "DriverNumber": "d3", "UpdateUTC": AT, "Latitude": 1, "Longitude": 2, "Speed": 50},
        ]},
        [("position", "d1", "V1", 70.0, "ok", (2.0, 1.0)), ("speeding", "d1", "V1", 30.0, "critical", (2.0, 1.0)), ("position", "d2", "V2", 40.0, "ok", (2.0, 1.0)), ("position", "d3", "V3", 50.0, "ok", (2.0, 1.0))],
    ),
    "omnitracs": (
        {"hosData": [{"driverId": "d1", "dutyStatus": "SB", "minutesUntilBreakRequired": 5, "minutesDrivingRemaining": 40, "timestampUtc": AT}, {"driverId": "d2", "dutyStatus": "??", "minutesDrivingRemaining": 61, "timestampUtc": AT}]},
        [("hos-remaining", "d1", "d1", 40.0, "critical", None), ("hos-remaining", "d2", "d2", 61.0, "ok", None)],
    ),
    "platform-science": (
        {"duty_status": [{"driver_ref": "d1", "status": "ON", "remaining_drive_minutes": 60, "remaining_duty_minutes": 90, "recorded_at": AT}, {"driver_ref": "d2", "recorded_at": AT}]},
        [("hos-remaining", "d1", "d1", 60.0, "warning", None), ("hos-remaining", "d2", "d2", None, "ok", None)],
    ),
    "netradyne": (
        {"alerts": [
            {"alertId": "N1", "driverIdentifier": "d1", "alertType": "PROLONGED_IDLE", "alertTimeMs": MILLIS, "gps": {"lat": 1, "lon": 2}, "durationSeconds": 1830, "severity": "LOW"},
            {"alertId": "N2", "driverIdentifier": "d2", "alertType": "SEATBELT", "alertTimeMs": MILLIS, "gps": {"lat": 1, "lon": 2}, "durationSeconds": 10},
            {"alertId": "N3", "driverIdentifier": "d3", "alertType": "PROLONGED_IDLE", "alertTimeMs": MILLIS, "durationSeconds": 600},
        ]},
        [("idle", "d1", "N1", 31.0, "critical", (2.0, 1.0)), ("idle", "d3", "N3", 10.0, "ok", (None, None))],
    ),
    "samsara": (
        {"data": [
            {"id": "T1", "name": "one", "externalIds": {"driverId": "d1"}, "gps": {"time": AT, "latitude": 1, "longitude": 2, "speedMilesPerHour": 50}, "engineStates": {"time": AT, "value": "Idle"}, "idleMinutes": 16, "harshEvent": {"time": AT, "gForce": 0.4}},
            {"id": "T2", "name": "two", "gps": {"time": AT, "latitude": 1, "longitude": 2, "speedMilesPerHour": 0}, "engineStates": {"time": AT, "value": "Off"}},
        ]},
        [("position", "d1", "T1", 80.5, "ok", (2.0, 1.0)), ("idle", "d1", "T1", 16.0, "warning", (2.0, 1.0)), ("harsh-brake", "d1", "T1", 0.4, "warning", (2.0, 1.0)), ("position", None, "T2", 0.0, "ok", (2.0, 1.0))],
    ),
    "motive": (
        {"logs": [{"log": {"driver": {"id": "d1", "username": "u1"}, "driving_time_remaining": 3570, "shift_time_remaining": 10, "current_status": "driving", "updated_at": AT}}, {"log": {"driver": {"id": "d2", "username": "u2"}, "driving_time_remaining": 7200, "updated_at": AT}}]},
        [("hos-remaining", "d1", "u1", 60.0, "warning", None), ("hos-remaining", "d2", "u2", 120.0, "ok", None)],
    ),
    "lytx": (
        {"events": [
            {"eventId": "L1", "driverId": "d1", "vehicleId": "T1", "recordDateTime": AT, "latitude": 1, "longitude": 2, "behaviors": [{"id": 1, "name": "Following"}, {"id": 2, "name": "Braking - Soft"}, {"id": 3, "name": "Panic Button"}], "triggerGForce": 0.2},
            {"eventId": "L2", "driverId": "d2", "vehicleId": "T2", "recordDateTime": AT, "latitude": 1, "longitude": 2, "behaviors": [{"id": 1, "name": "Following"}, {"id": 2, "name": "Braking - Soft"}], "triggerGForce": 0.6},
            {"eventId": "L3", "driverId": "d3", "vehicleId": "T3", "recordDateTime": AT, "behaviors": []},
        ]},
        [("panic", "d1", "T1", 1.0, "critical", (2.0, 1.0)), ("harsh-brake", "d2", "T2", 0.6, "critical", (2.0, 1.0))],
    ),
}


def _raw(spark, provider, *payloads):
    return spark.createDataFrame([("t", provider, datetime(2026, 10, 1, 7), p) for p in payloads], schema.RAW)


@pytest.mark.parametrize("provider", sorted(adapters.ADAPTERS))
def test_payloads(spark, provider):
    payload, want = CASES[provider]
    raw = _raw(spark, provider, json.dumps(payload))
    rows = adapters.normalise(raw, (provider,)).orderBy("seq").collect()
    assert [(r.kind, r.driver_id, r.source_ref, r.value, r.severity, None if r.location is None else (r.location.lon, r.location.lat)) for r in rows] == want
    assert all(r.observed_at.isoformat().startswith("2026-10-01T06:00") and len(r.telemetry_id) == 24 for r in rows)
    assert adapters.unparsed(raw).count() == 0


@pytest.mark.parametrize("provider", sorted(adapters.ADAPTERS))
def test_empty_lists_and_failures(spark, provider):
    field = next(iter(CASES[provider][0]))
    raw = _raw(spark, provider, json.dumps({field: []}), "{", None, "[]", json.dumps({"other": 1}))
    assert adapters.normalise(raw, (provider,)).count() == 0
    assert adapters.unparsed(raw).count() == 4
