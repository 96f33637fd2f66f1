"""Spatial joins and searches: radius, nearest, containment."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import rules, spatial
from convoy.operators import density, nearest


def within_radius(points: DataFrame, lon: Column, lat: Column, km: float, key: str, limit: int | None = 50) -> DataFrame:
    """Points within a radius by distance, nearest first; the box filter reaches the scan, the exact one follows."""
    box = spatial.bbox_around(lon, lat, F.lit(float(km)))
    distance = spatial.haversine_km(lon, lat, F.col("lon"), F.col("lat"))
    near = points.where(spatial.in_bbox(F.col("lon"), F.col("lat"), box)).withColumn("_km", distance).where(F.col("_km") <= km)
    near = near.withColumn("distance_km", rules.half_up(F.col("_km"), 2)).drop("_km").orderBy("distance_km", key)
    return near.limit(limit) if limit else near


def available_near(drivers: DataFrame, lon: Column, lat: Column, km: float, min_hos: int = 60, limit: int = 20, filter_last: bool = False) -> DataFrame:
    """Drivers near a point that can take a load; ``filter_last`` judges the nearest 50 only."""
    free = F.col("status").isin("stopped", "on-break") & (F.col("hos_remaining_minutes") > min_hos)
    if filter_last:
        return within_radius(drivers, lon, lat, km, "driver_id").where(free)
    return within_radius(drivers.where(free), lon, lat, km, "driver_id", limit)


def _cells(km: float, widest_lat: float) -> tuple[float, float]:
    """Cell sides in degrees that are no smaller than the distance, up to a latitude."""
    return km / spatial.KM_PER_DEGREE / math.cos(math.radians(widest_lat)), km / spatial.KM_PER_DEGREE


def radius_join(left: DataFrame, right: DataFrame, km: float, widest_lat: float = 75.0) -> DataFrame:
    """Pairs of rows (columns ``l`` and ``r``) within a distance: an equi-join on grid cells, the smaller side spread over nine.

    Both have ``lon`` and ``lat``; rows beyond ``widest_lat`` degrees of latitude are compared in cells as wide as the globe.
    """
    wide, high = _cells(km * 1.001, widest_lat)
    polar = lambda d: F.abs(d["lat"]) >= widest_lat - high
    y = lambda d: F.floor(d["lat"] / high)
    x = lambda d: F.floor(d["lon"] / wide)
    a = left.select(F.struct(*left.columns).alias("l")).withColumns({"_x": F.when(polar(F.col("l")), F.lit(None).cast("long")).otherwise(x(F.col("l"))), "_y": y(F.col("l"))})
    steps = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.select(F.struct(*right.columns).alias("r")).withColumn("_s", F.explode(steps))
    b = b.select("r", (x(F.col("r")) + F.col("_s.x")).alias("_x"), (y(F.col("r")) + F.col("_s.y")).alias("_y"))
    band = right.where(F.abs(F.col("lat")) >= widest_lat - 3 * high).select(F.struct(*right.columns).alias("r"))
    band = band.withColumn("_s", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).select("r", F.lit(None).cast("long").alias("_x"), (y(F.col("r")) + F.col("_s")).alias("_y"))
    both = a.withColumnsRenamed({"_x": "_lx", "_y": "_ly"}).join(b.unionByName(band), F.col("_lx").eqNullSafe(F.col("_x")) & (F.col("_ly") == F.col("_y")))
    return both.select("l", "r").where(spatial.haversine_km(F.col("l.lon"), F.col("l.lat"), F.col("r.lon"), F.col("r.lat")) <= km)


def containing(points: DataFrame, areas: DataFrame, ring: str = "boundary", cell: float = 1.0) -> DataFrame:
    """Points with the areas that hold them: areas are spread over the grid cells of their boxes, points meet those of their own cell.

    Cells of one degree keep the join an equi-join at any size of either side.
    """
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))
    spread = areas.where(F.size(ring) > 2).withColumn("_x", F.explode(span(lons))).withColumn("_y", F.explode(span(lats)))
    placed = points.where(spatial.valid_point(F.col("lon"), F.col("lat"))).withColumns({"_px": F.floor(F.col("lon") / cell), "_py": F.floor(F.col("lat") / cell)})
    met = placed.join(spread, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")))
    return met.where(spatial.in_ring(F.col("lon"), F.col("lat"), F.col(ring))).drop("_px", "_py", "_x", "_y")


def nearest_place(points: DataFrame, places: DataFrame, key: str, place: str, top: int = 1, km: Callable[[Column], Column] | None = None, path: str | None = None) -> DataFrame:
    """Points with their nearest places, ties by place id; by great-circle distance, or by what ``km`` makes of a place with a ``path``.

    points: ``key``, ``lon``, ``lat``; places: ``place`` and what ``km`` takes, ``lon`` and ``lat`` as a rule.  Points meet a list of places
    that may be among their nearest (see ``nearest``), and fold it.
    """
    distance = km or (lambda p: spatial.haversine_km(F.col("lon"), F.col("lat"), p["lon"], p["lat"]))
    at, bounds = (nearest.path_box(F.col(path)), nearest.flat_bounds) if path else (nearest.box(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat")), density.bounds)
    places = places.where(F.size(path) > 1) if path else places  # what has no distance would count as near
    rows = points.select(F.struct(*points.columns).alias("_point"), *points.columns)
    rows = nearest.candidates(rows, F.col("lon"), F.col("lat"), F.lit(""), places, at, F.lit(""), top, bounds)
    scored = F.transform("_near", lambda p: F.struct(distance(p).alias("km"), p[place].alias("place")))
    best = F.slice(F.sort_array(F.filter(scored, lambda p: p["km"].isNotNull())), 1, top)
    hits = rows.select("_point", F.posexplode(best).alias("_pos", "_hit")).select("_point.*", "_pos", "_hit")
    return hits.select(*points.columns, (F.col("_pos") + 1).alias("rank"), F.col("_hit.place").alias(place), F.col("_hit.km").alias("km"))


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where(F.col("_n") <= n).drop("_n")


def moved(cars: DataFrame, ticks: int) -> DataFrame:
    """Cars at every tick, with ``tick_index`` and ``place``: each is a range of ticks times its row, moved by expressions.

    cars: ``path``, ``progress`` (the share of it at tick 0) and ``speed`` (its share in a tick, 0 for one that stands).
    """
    rows = cars.select("*", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick_index"))
    return rows.withColumn("place", spatial.point_along(F.col("path"), F.pmod(F.col("progress") + F.col("speed") * F.col("tick_index"), F.lit(1.0))))
