"""The largest distance in a group of any size against comparing all of its points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.operators import pipeline, spread


def _brute(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    return float((2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h)))).max())


def _shapes():
    rnd = np.random.default_rng(3)
    u, v = rnd.random(400), rnd.random(400)
    turn = np.minimum(u, v), 1 - np.maximum(u, v)
    ring = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    return {
        "box": (-97 + u, 32 + v),
        "triangle": (-97 + turn[0] + turn[1] / 2, 10 + turn[1] * 0.87),
        "ring": (-97 + np.cos(ring), 0.5 * np.sin(ring)),
        "seam": (np.where(u > 0.5, 179.9, -179.9) + v / 20, 60 + u),
        "pole": (360 * u - 180, 89 + v),
        "world": (360 * u - 180, np.degrees(np.arcsin(2 * v - 1))),
        "line": (-97 + u, np.full(400, 32.0)),
        "one": (np.full(50, -97.0), np.full(50, 32.0)),
        "close": (-97 + u * 1e-6, 32 + v * 1e-6),
        "pair": (np.array([-97.0, 83.0]), np.array([32.0, -32.0])),
    }


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, float(x), float(y)) for k, (lon, lat) in _shapes().items() for x, y in zip(lon, np.clip(lat, -90, 90), strict=True)]
    return spark.createDataFrame(rows, "g string, lon double, lat double").repartition(3)


@pytest.mark.parametrize(("whole", "rounds"), [(8, 5), (8, 1), (10_000, 5)])
def test_largest_equals_comparing_all(points, monkeypatch, whole, rounds):
    monkeypatch.setattr(spread, "WHOLE", whole)
    monkeypatch.setattr(spread, "ROUNDS", rounds)
    got = {r.g: r.km for r in spread.largest(points, ["g"]).collect()}
    for name, (lon, lat) in _shapes().items():
        assert got[name] == pytest.approx(_brute(lon, np.clip(lat, -90, 90)), abs=1e-6), name
    assert set(got) == set(_shapes())


def test_no_points(points):
    assert spread.largest(points.where("false"), ["g"]).count() == 0


def test_incidents_of_many_and_of_few_drivers(spark, monkeypatch):
    monkeypatch.setattr(spread, "WHOLE", 20)
    rnd = np.random.default_rng(5)
    lon, lat = -97 + rnd.random(200), 32 + rnd.random(200)
    drivers = [("t", f"d{k}", float(lon[k]), float(lat[k])) for k in range(200)] + [("t", "lost", None, None), ("u", "d0", 0.0, 0.0)]
    found = [("t", "many", [f"d{k}" for k in range(150)] + ["lost"]), ("t", "few", ["d1", "d2", "lost"]), ("t", "alone", ["d1"]), ("t", "lost", ["lost"]), ("u", "other", ["d0"]), ("t", "none", [])]
    drivers = spark.createDataFrame(drivers, "tenant_id string, driver_id string, lon double, lat double")
    got = {r.incident_id: r.spread_km for r in pipeline.spread_km(spark.createDataFrame(found, "tenant_id string, incident_id string, driver_ids array<string>"), drivers).collect()}
    assert got == {"many": np.floor(_brute(lon[:150], lat[:150]) * 10 + 0.5) / 10, "few": np.floor(_brute(lon[1:3], lat[1:3]) * 10 + 0.5) / 10, "alone": 0, "lost": 0, "other": 0, "none": 0}


def test_many_points(spark):
    disc = spark.range(200_000).select(F.lit("g").alias("g"), F.sqrt(F.rand(1)).alias("r"), (F.rand(2) * 2 * np.pi).alias("a")).select("g", (F.col("r") * F.cos("a") - 97).alias("lon"), (F.col("r") * F.sin("a") * 0.8 + 32).alias("lat"))
    x = disc.select("lon", "lat").toPandas().to_numpy()
    rim = np.hypot(x[:, 0] + 97, (x[:, 1] - 32) / 0.8) > 0.98
    assert spread.largest(disc, ["g"]).first().km == pytest.approx(_brute(*x[rim].T), abs=1e-6)
