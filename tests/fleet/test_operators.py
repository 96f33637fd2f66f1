"""Properties of single operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convoy.functions import rules, spatial, text
from convoy.operators import access, density, exports, pipeline, places
from convoy.operators.access import Principal
from tests.fleet import demo as fleet


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_dallas_to_austin(spark):
    (km,) = one(spark, spatial.haversine_km(F.lit(-96.7970), F.lit(32.7767), F.lit(-97.7431), F.lit(30.2672)))
    assert 285 < km < 300


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-170, 170), st.floats(-70, 70), st.floats(0, 360), st.floats(0, 1)), min_size=1, max_size=40))
def test_box_holds_the_circle(spark, points):
    rows = []
    for lon, lat, bearing, share in points:
        r = 50 * share / 111.32
        rows.append((lon, lat, lon + r * math.sin(bearing) / max(math.cos(math.radians(lat)), 0.2), lat + r * math.cos(bearing)))
    df = spark.createDataFrame(rows, "lon double, lat double, x double, y double")
    box = spatial.bbox_around(F.col("lon"), F.col("lat"), F.lit(50.0))
    near = df.where(spatial.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= 49.9)
    assert near.where(~spatial.in_bbox(F.col("x"), F.col("y"), box)).count() == 0


def test_ring_rules(spark):
    at = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    square = F.array(at(0, 0), at(4, 0), at(4, 4), at(0, 4))
    inside = lambda x, y: spatial.in_ring(F.lit(float(x)), F.lit(float(y)), square)
    empty = spatial.in_ring(F.lit(1.0), F.lit(1.0), F.slice(square, 1, 0))
    assert tuple(one(spark, inside(2, 2), inside(5, 2), inside(-1, 2), empty, F.size(spatial.close_ring(square)))) == (True, False, False, False, 5)


def test_points_along_lie_on_the_road(spark):
    rows = fleet.corridors(spark).select("path", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).withColumn("p", spatial.point_along(F.col("path"), F.col("k") / 20))
    assert rows.where(spatial.metres_from_path(F.col("p.lon"), F.col("p.lat"), F.col("path")) > 5).count() == 0
    assert rows.where(spatial.metres_from_path(F.col("p.lon") + 0.5, F.col("p.lat") + 0.5, F.col("path")) < 3000).count() == 0


def test_trace_stays_near_corridors(spark):
    ticks = fleet.trace(spark, "acme-freight", 60)
    assert ticks.count() == 3600
    roads = F.broadcast(fleet.corridors(spark).select("corridor_id", "path"))
    far = ticks.join(roads, F.col("attributes")["corridorId"] == F.col("corridor_id")).where(spatial.metres_from_path(F.col("location.lon"), F.col("location.lat"), F.col("path")) > 200)
    assert far.count() == 0


def _greedy(rows):
    """Every unclaimed row, in order, claims all unclaimed rows that it matches."""
    lead = {}
    km = lambda a, b: 2 * 6371 * math.asin(math.sqrt(min(1, math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
    for s in rows:
        if s[0] in lead:
            continue
        for e in rows:
            if e[0] not in lead and (e[0] == s[0] or (abs(e[3] - s[3]) <= 900 and km(s, e) <= 3)):
                lead[e[0]] = s[0]
    return lead


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_the_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    rows = sorted(((f"e{k:03d}", -97 + rnd.random() * 0.15, 32 + rnd.random() * 0.15, rnd.randrange(0, 5400)) for k in range(120)), key=lambda r: (r[3], r[0]))
    df = spark.createDataFrame(rows, "exception_id string, x double, y double, s long").select("exception_id", F.lit("t").alias("tenant_id"), F.lit("d").alias("district_id"), F.lit("prolonged-idle").alias("kind"), F.timestamp_seconds("s").alias("raised_at"), F.struct(F.col("x").alias("lon"), F.col("y").alias("lat")).alias("location"))
    got = {r.exception_id: r.leader_id for r in pipeline.merge(df, ["exception_id"]).collect()}
    assert got == _greedy(rows)


def test_clusters_are_components(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.0, 0.009), ("c", 0.0, 0.018), ("z", 1.0, 1.0), ("y", 1.0, 1.005), ("n", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, lon double, lat double").withColumn("t", F.lit(1))
    got = {r.k: r.cluster for r in density.clusters(df, "k", 1100, ["t"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y", "n": None}


def test_topology_round_trip(spark):
    ring = spark.createDataFrame([("r", k, -97 + math.cos(k / 50), 32 + math.sin(k / 50)) for k in range(300)], "ring string, pos int, lon double, lat double")
    doc = exports.topology(ring, "ring", "pos").first().topojson
    plain = exports.feature_collection(ring.select("pos", "lon", "lat"), "pos").first().geojson
    assert len(doc) < 0.5 * len(plain)
    back = exports.decode(exports.quantise(ring.withColumns({"x": F.col("lon"), "y": F.col("lat")})))
    assert back.where((F.abs(F.col("lon") - F.col("x")) > 0.01) | (F.abs(F.col("lat") - F.col("y")) > 0.01)).count() == 0


def test_nan_and_null_values_are_ok(spark):
    sev = lambda v: rules.severity(F.lit("position"), v)
    assert tuple(one(spark, sev(F.lit(float("nan"))), sev(F.lit(None).cast("double")), sev(F.lit(300.0)), rules.severity(F.lit("hos-remaining"), F.lit(40.0)))) == ("ok", "ok", "critical", "critical")


def test_scopes_fail_closed_and_never_widen(spark):
    drivers = fleet.drivers(spark, "acme-freight")
    assert drivers.where(access.tenant_rows(Principal(None))).count() == 0
    assert drivers.where(access.tenant_rows(Principal("other"))).count() == 0
    view = access.Engine({"drivers": drivers}).seen_by(Principal("acme-freight", "district", "dal"))
    assert view.drivers().count() == 16 and view.drivers(district="aus").count() == 0
    assert access.Engine({"drivers": drivers}).seen_by(Principal("acme-freight", "driver", driver_id="drv-1000")).driver("drv-1001").count() == 0


def test_a_limit_of_zero_is_refused(spark):
    with pytest.raises(ValueError, match="limit"):
        access.key_query(fleet.drivers(spark, "t"), F.lit(True), "driver_id", limit=0)


@pytest.mark.parametrize("n", [0, 56, 57, 58, 59, 76, 200])
def test_b64url_of_long_text_is_one_line(spark, n):
    import base64

    value = ("https://a.example/?>~é" * 20)[:n]
    coded = text.b64url(F.lit(value))
    assert tuple(one(spark, coded, text.from_b64url(coded))) == (base64.urlsafe_b64encode(value.encode()).decode().rstrip("="), value)


def test_base64url_and_tokens(spark):
    coded = text.b64url(F.lit("a?>b~é"))
    assert tuple(one(spark, text.from_b64url(coded), F.size(text.tokens(F.lit("The map, and 12 ROADS!"))), F.size(text.tokens(F.lit(""))))) == ("a?>b~é", 2, 0)


def test_radius_is_found_by_box_filters_in_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    fleet.drivers(spark, "t").write.parquet(f"{tmp_path}/d")
    plan = places.within_radius(spark.read.parquet(f"{tmp_path}/d"), F.lit(-96.8), F.lit(32.8), 50, "driver_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon" in plan and "LessThanOrEqual(lat" in plan
