"""Density clusters against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.operators import density


def _dbscan(rows, km, least):
    """Plain DBSCAN of (key, lon, lat): the label of a cluster is its smallest core key; a border point takes the smallest."""
    keys = [r[0] for r in rows]
    lon, lat = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h))) <= km
    core = near.sum(1) >= least
    label = {}
    for k in sorted(np.flatnonzero(core), key=lambda k: keys[k]):
        if k in label:
            continue
        todo, label[k] = [k], keys[k]
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core):
                if j not in label:
                    label[j] = keys[k]
                    todo.append(j)
    for k in np.flatnonzero(~core):
        found = [label[j] for j in np.flatnonzero(near[k] & core)]
        if found:
            label[k] = min(found)
    return {keys[k]: label.get(k) for k in range(len(rows))}


def _scatter(rnd, n, lon, lat, spread):
    """Clumps of several sizes, repeated places and strays around a place."""
    out = []
    while len(out) < n:
        x, y, size = lon + rnd.uniform(-spread, spread), lat + rnd.uniform(-spread, spread) / 3, rnd.choice([1, 1, 3, 30, 90])
        for _ in range(size):
            tight = rnd.choice([0, 0.001, 0.004, 0.02])
            px, py = x + rnd.gauss(0, tight) / max(0.02, math.cos(math.radians(y))), min(90.0, max(-90.0, y + rnd.gauss(0, tight)))
            out.append((f"k{len(out):05d}", (px + 180) % 360 - 180, py))
    return out[:n]


@pytest.mark.parametrize(("least", "lon", "lat", "spread"), [(2, -97, 32, 0.3), (10, 180, 61, 0.2), (4, 10, 89.6, 1.2)])
def test_clusters_equal_brute_force(spark, least, lon, lat, spread):
    rows = _scatter(random.Random(least * 7 + int(lat)), 600, lon, lat, spread)
    df = spark.createDataFrame(rows, "k string, lon double, lat double").withColumns({"t": F.lit("t"), "cluster_id": F.lit("mine")})
    got = {r.k: r.cluster for r in density.clusters(df, "k", 1100, ["t"], least).collect()}
    want = _dbscan(rows, 1.1, least)
    assert got == want and len(set(want.values())) > 3


def test_boxes_that_are_cut_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(density, "FEW", 1)
    rows = _scatter(random.Random(3), 250, -97, 32, 0.05)
    df = spark.createDataFrame(rows, "k string, lon double, lat double")
    assert {r.k: r.cluster for r in density.clusters(df, "k", 700, [], 5).collect()} == _dbscan(rows, 0.7, 5)


def test_groups_stand_apart_and_bad_places_are_noise(spark):
    rows = [("a", 1, 0.0, 0.0), ("b", 2, 0.0, 0.001), ("c", 1, 0.0, 0.001), ("d", 1, None, 0.0), ("e", 1, float("nan"), 0.0), ("f", 1, 200.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, t int, lon double, lat double")
    assert {r.k: r.cluster for r in density.clusters(df, "k", 1000, ["t"]).collect()} == {"a": "a", "b": None, "c": "a", "d": None, "e": None, "f": None}
    assert density.clusters(df.where("false"), "k", 1000, ["t"], 4).count() == 0


def test_a_full_cell_costs_no_more_than_spread_points(spark):
    import time

    def seconds(span):
        df = spark.range(100_000).select("id", (F.rand(1) * span).alias("lon"), (F.rand(2) * span).alias("lat"))
        began = time.perf_counter()
        found = density.clusters(df, "id", 1100, [], 4).groupBy("cluster").count().count()
        return time.perf_counter() - began, found

    spread, (full, found) = seconds(20)[0], seconds(0.006)
    assert found == 1 and full < spread


def test_a_district_without_gaps_is_merged_in_parts(spark, monkeypatch):
    from convoy.operators import pipeline
    from tests.fleet.test_operators import _greedy

    rnd = random.Random(11)
    spots = [(-97 + rnd.random(), 32 + rnd.random()) for _ in range(25)]
    rows = sorted(((f"e{k:04d}", x + rnd.gauss(0, 0.02), y + rnd.gauss(0, 0.02), rnd.randrange(0, 20_000)) for k in range(400) for x, y in [rnd.choice(spots)]), key=lambda r: (r[3], r[0]))
    df = spark.createDataFrame(rows, "exception_id string, x double, y double, s long").select("exception_id", F.lit("t").alias("tenant_id"), F.lit("d").alias("district_id"), F.lit("prolonged-idle").alias("kind"), F.timestamp_seconds("s").alias("raised_at"), F.struct(F.col("x").alias("lon"), F.col("y").alias("lat")).alias("location"))
    monkeypatch.setattr(pipeline, "LARGE_PIECE", 100)
    assert {r.exception_id: r.leader_id for r in pipeline.merge(df, ["exception_id"]).collect()} == _greedy(rows)
    slim = df.select("tenant_id", "district_id", "exception_id", F.unix_micros("raised_at").alias("at"), "location.*")
    parts = pipeline._apart(slim, ["tenant_id", "district_id"])
    assert parts.count() == 400 and parts.select("part").distinct().count() > 10
