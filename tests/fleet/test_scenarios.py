"""The six demonstration scenarios from raw payloads to incidents."""

import math

import pytest
from pyspark.sql import functions as F

from convoy.operators import pipeline, sinks
from convoy.sources import adapters
from tests.fleet import demo as fleet

TENANT = "acme-freight"
DEPOTS = [(d, lon, lat) for d, _, _, lon, lat in fleet.DISTRICTS]


@pytest.fixture(scope="module")
def run(spark):
    drivers, corridors = fleet.drivers(spark, TENANT).cache(), fleet.corridors(spark).cache()

    def of(*names):
        raw = fleet.scenario_raw(spark, TENANT, *names)
        return pipeline.ingest(raw, drivers, DEPOTS, corridors, F.lit(fleet.EPOCH))

    return of


def counts(out):
    return tuple(out[n].count() for n in ("telemetry", "exceptions", "incidents"))


def test_road_closure_is_one_incident(run):
    out = run("road-closure")
    assert counts(out) == (42, 28, 1)
    row = out["incidents"].first()
    assert row.title == "Route deviation affecting 14 drivers in dal" and len(row.driver_ids) == 14 and row.district_id == "dal"


def test_gps_drift_raises_no_incident(run):
    out = run("gps-drift")
    assert counts(out) == (2, 1, 0)
    assert out["exceptions"].first().kind == "route-deviation"


def test_two_devices_corroborate(run):
    out = run("harsh-braking")
    rows = [r for r in out["exceptions"].collect() if r.kind == "harsh-braking"]
    assert len(rows) == 1 and sorted(rows[0].providers) == ["lytx", "samsara"] and len(rows[0].telemetry_ids) == 2
    assert out["incidents"].count() == 1


def test_hours_of_service_stands_alone(run):
    out = run("hos-risk")
    assert counts(out)[1:] == (1, 1) and out["exceptions"].first().severity == "critical"


def test_panic_is_critical(run):
    row = run("panic")["incidents"].first()
    assert row.severity == "critical" and row.title.startswith("PANIC ALERT")


def test_poison_reading_is_quarantined_and_the_rest_goes_on(run):
    out = run("poison-record")
    assert out["quarantined"].count() == 1 and math.isnan(out["quarantined"].first().value)
    assert out["telemetry"].where("kind = 'position'").count() == 7


def test_closure_and_clock_are_two_incidents(run):
    assert run("road-closure", "hos-risk")["incidents"].count() == 2


def test_ids_do_not_change_between_runs(run):
    pick = lambda: {r.incident_id for r in run("road-closure")["incidents"].collect()}
    assert pick() == pick()


def test_unknown_tenant_reads_the_default_provider_only(spark):
    from convoy.sources.registry import allowed

    raw = fleet.scenario_raw(spark, "someone", "harsh-braking")
    assert [r.provider for r in allowed(raw).collect()] == ["samsara"]


def test_bad_payloads_are_named_not_lost(spark):
    raw = spark.createDataFrame([("t", "samsara", fleet.EPOCH, "{"), ("t", "samsara", fleet.EPOCH, None), ("t", "zzz", fleet.EPOCH, "{}"), ("t", None, fleet.EPOCH, "{}")], "tenant_id string, provider string, fetched_at timestamp, payload string")
    assert adapters.normalise(raw).count() == 0
    assert sorted(r.reason for r in adapters.unparsed(raw).collect()) == ["unknown provider", "unknown provider", "unreadable payload", "unreadable payload"]


def test_spread_of_an_incident(run, spark):
    out = run("road-closure")
    row = pipeline.spread_km(out["incidents"], out["drivers"]).first()
    assert 0 < row.spread_km < 10


def test_publish_parses_once_and_counts_what_it_writes(spark, run, tmp_path):
    for name in ("panic", "poison-record"):
        raw, want = fleet.scenario_raw(spark, TENANT, name), run(name)
        counted = {r.record: r.n for r in pipeline.publish(raw, fleet.drivers(spark, TENANT), DEPOTS, fleet.corridors(spark), f"{tmp_path}/{name}", F.lit(fleet.EPOCH)).collect()}
        assert {k: v for k, v in counted.items() if k != "parsed"} == {k: df.count() for k, df in want.items()}
        derived = want["telemetry"].where("kind = 'route-adherence'").count()
        assert counted["parsed"] == counted["telemetry"] - derived + counted["quarantined"]
        for k in ("telemetry", "exceptions", "incidents", "drivers"):
            key = "telemetry_id" if k == "telemetry" else f"{k[:-1]}_id"
            assert sorted(r[key] for r in spark.read.parquet(f"{tmp_path}/{name}/{k}").collect()) == sorted(r[key] for r in want[k].collect())
    assert spark.read.json(f"{tmp_path}/panic/events").count() == 2


def test_archive_and_history_use_each_rows_hour(spark, tmp_path, run):
    raw = fleet.scenario_raw(spark, TENANT, "panic", "hos-risk")
    sinks.archive_raw(raw, f"{tmp_path}/raw")
    from convoy.sources.readers import bronze

    back = bronze(spark, f"{tmp_path}/raw")
    assert back.count() == 2 and {(r.dt, r.hh) for r in back.collect()} == {("2026-09-08", "14")}
    good = run("road-closure")["telemetry"].drop("fetched_at", "seq")
    sinks.append_history(good, f"{tmp_path}/history")
    assert spark.read.parquet(f"{tmp_path}/history").count() == good.count()
