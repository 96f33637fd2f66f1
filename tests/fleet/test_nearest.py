"""Nearest places and paths by the index against comparing everything."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.functions import spatial
from convoy.operators import nearest, pipeline, places


def _spots(rnd, n, lon, lat, spread):
    """Places in clumps of very different density, some in the same place."""
    out = []
    while len(out) < n:
        x, y, tight = lon + rnd.uniform(-spread, spread), lat + rnd.uniform(-spread, spread) / 2, rnd.choice([0, 1e-5, 1e-3, 0.05, 0.5])
        out += [((x + rnd.gauss(0, tight) + 180) % 360 - 180, min(90.0, max(-90.0, y + rnd.gauss(0, tight)))) for _ in range(rnd.choice([1, 5, 60]))]
    return out[:n]


@pytest.mark.parametrize(("top", "lon", "lat", "spread"), [(1, -97, 32, 8), (3, 179.5, 80, 20)])
def test_nearest_places_equal_comparing_all(spark, monkeypatch, top, lon, lat, spread):
    monkeypatch.setattr(nearest, "LIST", 12)
    rnd = random.Random(top)
    spots, asked = _spots(rnd, 700, lon, lat, spread), _spots(rnd, 400, lon, lat, spread * 1.2)
    df = spark.createDataFrame([(f"p{k:04d}", *s) for k, s in enumerate(spots)], "place string, lon double, lat double")
    points = spark.createDataFrame([(k, *s, "mine") for k, s in enumerate(asked)] + [(-1, None, 1.0, "x"), (-2, 500.0, 1.0, "x")], "k int, lon double, lat double, low string")
    got = {}
    for r in places.nearest_place(points, df, "k", "place", top).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.place, r.km))
    x, y = np.radians(np.array(spots)).T
    for k, (a, b) in enumerate(np.radians(np.array(asked)).tolist()):
        h = np.sin((y - b) / 2) ** 2 + math.cos(b) * np.cos(y) * np.sin((x - a) / 2) ** 2
        km = 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h)))
        want = np.sort(km)[:top]
        assert len(got[k]) == top and np.allclose([v for _, v in got[k]], want, atol=1e-9) and all(abs(km[int(p[1:])] - v) < 1e-9 for p, v in got[k])
    assert set(got) == set(range(len(asked)))


def test_nearest_paths_equal_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 6)
    rnd, rows = random.Random(5), []
    for k in range(400):
        x, y, step = rnd.uniform(-100, -95), rnd.uniform(30, 34), rnd.choice([0.002, 0.05, 0.3])
        path = [(x := x + rnd.uniform(-step, step), y := y + rnd.uniform(-step, step)) for _ in range(rnd.randrange(1, 6))]
        rows.append((f"c{k:03d}", f"n{k}", rnd.choice(["a", "b", "", None]), path))
    roads = spark.createDataFrame(rows, "corridor_id string, name string, district_id string, path array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(k, rnd.uniform(-101, -94), rnd.uniform(29, 35), rnd.choice(["a", "b", "none", "", None])) for k in range(300)], "k int, lon double, lat double, at string")
    metres = spatial.metres_from_path(F.col("lon"), F.col("lat"), F.col("path"))
    fits = (F.coalesce("at", F.lit("")) == "") | (F.col("at") == F.col("district_id"))
    every = points.crossJoin(roads).where(fits).withColumn("m", metres).where("m IS NOT NULL")
    want = {r.k: (r.best.m, r.best.corridor_id) for r in every.groupBy("k").agg(F.min(F.struct("m", "corridor_id")).alias("best")).collect()}
    got = {r.k: (r.nearest.metres, r.nearest.corridor_id) for r in pipeline.nearest_corridor(points, roads, F.col("lon"), F.col("lat"), F.col("at")).collect()}
    assert got == want and len(want) > 150
    far = lambda c: spatial.metres_from_path(F.col("lon"), F.col("lat"), c["path"])
    three = {}
    for r in every.where("coalesce(at, '') = ''").collect():
        three.setdefault(r.k, []).append((r.m, r.corridor_id))
    found = {}
    for r in places.nearest_place(points.where("coalesce(at, '') = ''"), roads, "k", "corridor_id", 3, far, "path").orderBy("k", "rank").collect():
        found.setdefault(r.k, []).append((r.km, r.corridor_id))
    assert found == {k: sorted(v)[:3] for k, v in three.items()}


def test_few_paths_are_cut_by_cells_and_folded_once(spark):
    """Groups of many and of one, points without a place; few candidates a point, one fold of each, and points of one file on all cores."""
    rnd = random.Random(8)
    rows = [(f"c{k:03d}", f"n{k}", "one" if k == 7 else "many", [(x := rnd.uniform(-110, -80), y := rnd.uniform(25, 45)), (x + 0.2, y + 0.1)]) for k in range(80)]
    roads = spark.createDataFrame(rows, "corridor_id string, name string, district_id string, path array<struct<lon:double,lat:double>>")
    spots = [(k, rnd.uniform(-111, -79), rnd.uniform(24, 46), rnd.choice(["one", "many", "", None, "none"])) for k in range(200)]
    points = spark.createDataFrame([*spots, (900, None, 30.0, "one"), (901, 500.0, 30.0, "many")], "k int, lon double, lat double, at string").coalesce(1)
    metres = spatial.metres_from_path(F.col("lon"), F.col("lat"), F.col("path"))
    fits = (F.coalesce("at", F.lit("")) == "") | (F.col("at") == F.col("district_id"))
    want = {r.k: (r.best.m, r.best.corridor_id) for r in points.crossJoin(roads).where(fits).withColumn("m", metres).groupBy("k").agg(F.min(F.struct("m", "corridor_id")).alias("best")).collect()}
    near = pipeline.nearest_corridor(points, roads, F.col("lon"), F.col("lat"), F.col("at"))
    assert {r.k: (r.nearest.metres, r.nearest.corridor_id) for r in near.collect()} == want and len(want) > 150
    known = roads.select("corridor_id", "path")
    lists = nearest.candidates(points.where("k < 900"), F.col("lon"), F.col("lat"), F.lit(""), known, nearest.path_box(F.col("path")), F.lit(""), 3, nearest.flat_bounds)
    sizes = [r[0] for r in lists.select(F.size("_near")).collect()]
    assert len(sizes) == 200 and min(sizes) >= 3 and sum(sizes) / 200 < 20
    assert near.rdd.getNumPartitions() > 1
    plan = near.select("nearest.metres", "nearest.corridor_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(transform(_near") == 1
