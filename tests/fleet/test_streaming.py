"""Streams give what batches give."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from convoy import schema
from convoy.operators import pipeline
from tests.fleet import demo as fleet
from convoy.streaming import jobs

TENANT = "acme-freight"
DEPOTS = [(d, lon, lat) for d, _, _, lon, lat in fleet.DISTRICTS]


def _land(spark, folder):
    rows = fleet.trace(spark, TENANT, 20).select(*schema.TELEMETRY.fieldNames())
    rows.unionByName(rows).repartition(4).write.parquet(folder)  # everything twice, as at-least-once delivery may
    return rows


def _drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_duplicates_collapse(spark, tmp_path):
    rows = _land(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema.TELEMETRY).parquet(f"{tmp_path}/in")
    assert _drain(jobs.deduplicated(stream), "deduped", "append").count() == rows.count()


def test_hot_state_is_the_latest_by_event_time(spark, tmp_path):
    rows = _land(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema.TELEMETRY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last = {(r.driver_id): (r.lon, r.lat) for r in _drain(jobs.hot_state(stream), "hot", "update").groupBy("driver_id").agg(F.max_by("lon", "updated_at").alias("lon"), F.max_by("lat", "updated_at").alias("lat")).collect()}
    want = {r.driver_id: (r.p.lon, r.p.lat) for r in rows.groupBy("driver_id").agg(F.max_by("location", "observed_at").alias("p")).collect()}
    assert last == want


def test_windows_count_what_a_batch_counts(spark, tmp_path):
    rows = _land(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema.TELEMETRY).parquet(f"{tmp_path}/in")
    got = _drain(jobs.windowed_counts(stream), "windows", "complete").agg(F.sum("n")).first()[0]
    assert got == 2 * rows.count()


def test_ingest_of_a_stream_equals_the_batch(spark, tmp_path):
    raw = fleet.scenario_raw(spark, TENANT, "road-closure", "hos-risk", "poison-record")
    raw.coalesce(1).write.json(f"{tmp_path}/raw")
    stream = spark.readStream.schema(schema.RAW).json(f"{tmp_path}/raw")
    drivers, corridors = fleet.drivers(spark, TENANT), fleet.corridors(spark)
    q = jobs.ingest(stream, drivers, DEPOTS, corridors, f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    want = pipeline.ingest(raw, drivers, DEPOTS, corridors)
    for name in ("exceptions", "incidents", "quarantined"):
        assert spark.read.parquet(f"{tmp_path}/out/{name}").count() == want[name].count(), name
    assert {r.title for r in spark.read.parquet(f"{tmp_path}/out/incidents").collect()} == {r.title for r in want["incidents"].collect()}


def _in_batches(spark, folder, *parts):
    """Runs the ingest over one micro-batch per part; returns the folder of its tables."""
    drivers, corridors = fleet.drivers(spark, TENANT), fleet.corridors(spark)
    for part in parts:
        part.coalesce(1).write.mode("append").json(f"{folder}/raw")
        stream = spark.readStream.schema(schema.RAW).json(f"{folder}/raw")
        jobs.ingest(stream, drivers, DEPOTS, corridors, f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def test_a_second_vendor_may_come_in_a_later_batch(spark, tmp_path):
    raw = fleet.scenario_raw(spark, TENANT, "harsh-braking")
    out = _in_batches(spark, tmp_path, raw.where("provider = 'samsara'"), raw.where("provider = 'lytx'"))
    want = pipeline.ingest(raw, fleet.drivers(spark, TENANT), DEPOTS, fleet.corridors(spark))["incidents"].collect()
    got = jobs.current(spark.read.parquet(f"{out}/incidents")).collect()
    assert [(r.title, r.severity, r.driver_ids) for r in got] == [(r.title, r.severity, r.driver_ids) for r in want] and len(got) == 1


def test_an_event_that_spans_batches_is_one_incident(spark, tmp_path):
    def part(begin, end, minutes, names=("road-closure",)):
        rows = []
        for name in names:
            for provider, payload in fleet.scenario(name, fleet.cars(spark)):
                text = json.dumps(payload | {"data": payload["data"][begin:end]} if "data" in payload else payload)
                rows.append((TENANT, provider, fleet.EPOCH + timedelta(minutes=minutes), text.replace("T14:30:", f"T14:{30 + minutes}:")))
        return spark.createDataFrame(rows, schema.RAW)

    parts = [part(0, 5, 0, ("road-closure", "hos-risk")), part(5, 10, 4, ("road-closure", "hos-risk")), part(10, 13, 12), part(13, 14, 20)]
    out = _in_batches(spark, tmp_path, *parts)
    got = {len(r.driver_ids): r for r in jobs.current(spark.read.parquet(f"{out}/incidents")).where("district_id = 'dal'").collect()}
    # the last comes 20 minutes after the first leader, and 8 after one that followed it
    assert sorted(got) == [1, 13] and got[13].title == "Route deviation affecting 13 drivers in dal"
    hos = jobs.current(spark.read.parquet(f"{out}/incidents")).where("district_id = 'chi'").collect()
    assert len(hos) == 1 and len(hos[0].exception_ids) == 2
    events = spark.read.json(f"{out}/events").where("detail_type = 'IncidentOpened'")
    assert events.count() == 3 and spark.read.parquet(f"{out}/incidents").where("district_id = 'dal'").count() == 4


def test_leaders_of_one_batch_are_those_of_the_merge(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for k in range(300):
        kind, at = rnd.choice(schema.LOCATION_CAUSED), fleet.EPOCH + timedelta(seconds=rnd.randrange(9000))
        place = (-96.8 + rnd.random() / 10, 32.8 + rnd.random() / 10)
        rows.append((TENANT, f"e{k:03d}", f"drv{k}", rnd.choice(["dal", "aus"]), kind, "warning", ["t"], ["samsara", "lytx"], place, None, at))
    found = spark.createDataFrame(rows, schema.EXCEPTION)
    held = found.where("false").withColumns({"leader_id": F.lit(None).cast("string"), "lead_at": F.lit(None).cast("long")})
    want = {(r.exception_id, r.leader_id) for r in pipeline.merge(found, ["exception_id"]).collect()}
    assert {(r.exception_id, r.leader_id) for r in jobs.correlate(held, found).collect()} == want
    middle, kept = fleet.EPOCH + timedelta(seconds=4500), [c for c in held.columns]
    first = jobs.correlate(held, found.where(F.col("raised_at") < F.lit(middle)))
    left = jobs._kept(first, None).select(*kept)
    second = jobs.correlate(left, found.where(F.col("raised_at") >= F.lit(middle)))
    assert left.count() < first.count()
    assert {(r.exception_id, r.leader_id) for df in (first, second) for r in df.collect()} == want
