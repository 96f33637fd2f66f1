"""Spatial expressions over lon/lat columns in degrees; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoy.functions.rules import half_up

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bbox_around(lon: Column, lat: Column, km: Column) -> dict[str, Column]:
    """West, south, east and north of a box that holds the circle; it does not wrap at 180 degrees."""
    dlat = km / KM_PER_DEGREE
    wide = KM_PER_DEGREE * F.cos(F.radians(lat))
    dlon = km / F.when(wide == 0, F.lit(1.0)).otherwise(wide)
    return {"west": lon - dlon, "south": lat - dlat, "east": lon + dlon, "north": lat + dlat}


def in_bbox(lon: Column, lat: Column, box: dict[str, Column]) -> Column:
    return lon.between(box["west"], box["east"]) & lat.between(box["south"], box["north"])


def valid_point(lon: Column, lat: Column) -> Column:
    ok = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.coalesce(ok, F.lit(False))


def edges(ring: Column) -> Column:
    """Consecutive pairs of a path's points, as structs a and b."""
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())


def close_ring(ring: Column) -> Column:
    """The ring with its first point again at the end, unless it is there or the ring is empty."""
    first = F.get(ring, F.lit(0))
    return F.when(F.size(ring) == 0, ring).when(first == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(first)))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over the closed ring's edges, half-open in latitude."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return spans & F.coalesce(lon < at, F.lit(False))

    return F.coalesce(F.size(F.filter(edges(close_ring(ring)), crosses)) % 2 == 1, F.lit(False))


def _let(value: Column, body) -> Column:
    """Evaluates a value once for an expression that uses it several times; inside lambdas nothing else shares it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def metres_from_path(lon: Column, lat: Column, path: Column) -> Column:
    """Whole metres from a point to a path, on a plane scaled at the point's latitude; null for fewer than two points."""
    up = F.lit(KM_PER_DEGREE * 1000)

    def flat(e: Column, across: Column) -> Column:
        ax, ay, bx, by = (e["a"]["lon"] - lon) * across, (e["a"]["lat"] - lat) * up, (e["b"]["lon"] - e["a"]["lon"]) * across, (e["b"]["lat"] - e["a"]["lat"]) * up
        return F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("dx"), by.alias("dy"), (bx * bx + by * by).alias("n"))

    def nearest(s: Column) -> Column:
        t = F.when(s["n"] == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(s["ax"] * s["dx"] + s["ay"] * s["dy"]) / F.nullif(s["n"], F.lit(0.0)))))
        return _let(t, lambda t: (s["ax"] + t * s["dx"]) * (s["ax"] + t * s["dx"]) + (s["ay"] + t * s["dy"]) * (s["ay"] + t * s["dy"]))

    squares = _let(up * F.cos(F.radians(lat)), lambda across: F.transform(edges(path), lambda e: _let(flat(e, across), nearest)))
    # rounding names its argument several times, and a fold inside a lambda would run for each
    return _let(F.sqrt(F.array_min(squares)), lambda metres: half_up(metres)).cast("long")  # noqa: PLW0108


def point_along(path: Column, t: Column) -> Column:
    """The point at a share of the path's length in degrees; the share is clamped to 0..1."""

    def length(e: Column) -> Column:
        dx, dy = e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]
        return F.sqrt(dx * dx + dy * dy)

    def part(e: Column) -> Column:
        return F.struct(e.alias("e"), length(e).alias("n"))

    parts = F.transform(edges(path), part)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["n"])
    target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * total
    start = F.struct(target.alias("left"), F.lit(False).alias("done"), F.element_at(path, -1)["lon"].alias("lon"), F.element_at(path, -1)["lat"].alias("lat"))

    def step(s: Column, p: Column) -> Column:
        share = F.when(p["n"] == 0, F.lit(0.0)).otherwise(s["left"] / F.nullif(p["n"], F.lit(0.0)))
        here = ~s["done"] & (s["left"] <= p["n"])
        a, b = p["e"]["a"], p["e"]["b"]
        return F.struct(
            F.when(s["done"], s["left"]).otherwise(s["left"] - p["n"]).alias("left"),
            (s["done"] | here).alias("done"),
            F.when(here, a["lon"] + (b["lon"] - a["lon"]) * share).otherwise(s["lon"]).alias("lon"),
            F.when(here, a["lat"] + (b["lat"] - a["lat"]) * share).otherwise(s["lat"]).alias("lat"),
        )

    found = F.aggregate(parts, start, step)
    return F.when(F.size(path) == 0, F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))).otherwise(F.struct(found["lon"].alias("lon"), found["lat"].alias("lat")))


def nearest_of(lon: Column, lat: Column, places: list[tuple[str, float, float]]) -> Column:
    """Id of the nearest of a short list of (id, lon, lat), the first of equals; folded over a literal, no join."""
    if not places:
        return F.lit(None).cast("string")
    table = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(i).alias("id"), F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for k, (i, x, y) in enumerate(places)])
    best = F.array_min(F.transform(table, lambda p: F.struct(haversine_km(lon, lat, p["lon"], p["lat"]).alias("km"), p["ord"].alias("ord"), p["id"].alias("id"))))
    return F.when(valid_point(lon, lat), best["id"])


def point_json(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def grid_cell(lon: Column, lat: Column, degrees: float) -> Column:
    """Cell of a square grid over degrees, as a struct to join on."""
    return F.struct(F.floor(lon / degrees).alias("x"), F.floor(lat / degrees).alias("y"))
