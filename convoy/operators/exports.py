"""GeoJSON and TopoJSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import rules

# Colours of severities on the map, the default one, and service addresses.
COLOURS = {"critical": "#d7263d", "warning": "#f4a259", "info": "#4c86c8"}
OTHER_COLOUR = "#3fa66b"
GEOCODE = "https://api.mapbox.com/geocoding/v5/mapbox.places"
ISOCHRONE = "https://api.mapbox.com/isochrone/v1/mapbox"


def severity_colour(level: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for name, colour in COLOURS.items():
        out = F.when(level == name, colour).otherwise(out)
    return out


def driver_features(drivers: DataFrame, readings: DataFrame) -> DataFrame:
    """A row per driver with its worst severity, number of readings and urgency."""
    facts = readings.groupBy("tenant_id", "driver_id").agg(F.max(rules.rank(F.col("severity"))).alias("_rank"), F.count("*").alias("_n"))
    rank = F.coalesce("_rank", F.lit(0))
    rows = drivers.join(facts, ["tenant_id", "driver_id"], "left")
    return rows.select(
        "tenant_id", "driver_id", "name", "district_id", "vehicle_id", "status", "hos_remaining_minutes", rules.level(rank).alias("severity"),
        F.coalesce("_n", F.lit(0)).alias("reading_count"), rules.urgency(rank, F.col("hos_remaining_minutes")).alias("urgency"), "lon", "lat",
    )


def bbox(points: DataFrame, *by: str) -> DataFrame:
    """West, south, east and north of each group; inverted bounds for no points."""
    edge = lambda f, c, none, name: F.coalesce(f(c), F.lit(none)).alias(name)
    return points.groupBy(*by).agg(edge(F.min, "lon", 180.0, "west"), edge(F.min, "lat", 90.0, "south"), edge(F.max, "lon", -180.0, "east"), edge(F.max, "lat", -90.0, "north"))


def feature_collection(features: DataFrame, key: str, *by: str) -> DataFrame:
    """One GeoJSON document per group, features in key order; an empty list where there are none."""
    props = [c for c in features.columns if c not in ("lon", "lat")]
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties"))
    rows = features.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), feature.alias("f")))).alias("_f"))
    return rows.select(*by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("_f", lambda x: x["f"]).alias("features"))).alias("geojson"))


def quantise(points: DataFrame, steps: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Points with whole-number coordinates ``qx``, ``qy`` on a grid over the group's box, and the transform to undo it."""
    box = bbox(points, *by)
    scale = lambda a, b: F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise((F.col(b) - F.col(a)) / float(steps - 1))
    sized = box.select(*by, F.col("west").alias("tx"), F.col("south").alias("ty"), scale("west", "east").alias("kx"), scale("south", "north").alias("ky"))
    rows = points.join(F.broadcast(sized), list(by)) if by else points.crossJoin(F.broadcast(sized))
    whole = lambda c, t, k: rules.half_up((F.col(c) - F.col(t)) / F.col(k)).cast("long")
    return rows.withColumns({"qx": whole("lon", "tx", "kx"), "qy": whole("lat", "ty", "ky")})


def decode(points: DataFrame) -> DataFrame:
    return points.withColumns({"lon": F.col("qx") * F.col("kx") + F.col("tx"), "lat": F.col("qy") * F.col("ky") + F.col("ty")})


def delta_encode(points: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Differences ``dx``, ``dy`` of whole-number coordinates along each ring; the first is absolute."""
    along = Window.partitionBy(*by).orderBy(pos)
    return points.withColumns({"dx": F.col("qx") - F.lag("qx", 1, 0).over(along), "dy": F.col("qy") - F.lag("qy", 1, 0).over(along)})


def topology(rings: DataFrame, by: str, pos: str, steps: int = 10_000) -> DataFrame:
    """One TopoJSON document: each ring an arc of differences, polygons by arc number."""
    coded = delta_encode(quantise(rings, steps), [by], pos)
    arcs = coded.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(pos, "dx", "dy"))).alias("a"), F.first("kx").alias("kx"), F.first("ky").alias("ky"), F.first("tx").alias("tx"), F.first("ty").alias("ty"))
    arcs = arcs.withColumn("n", F.row_number().over(Window.orderBy(by)) - 1)
    one = arcs.agg(F.sort_array(F.collect_list(F.struct("n", F.col(by).alias("id"), F.transform("a", lambda x: F.array(x["dx"], x["dy"])).alias("arc")))).alias("r"), F.first("kx").alias("kx"), F.first("ky").alias("ky"), F.first("tx").alias("tx"), F.first("ty").alias("ty"))
    shapes = F.transform("r", lambda x: F.struct(F.lit("Polygon").alias("type"), x["id"].alias("id"), F.array(F.array(x["n"])).alias("arcs")))
    return one.select(F.to_json(F.struct(
        F.lit("Topology").alias("type"), F.struct(F.array("kx", "ky").alias("scale"), F.array("tx", "ty").alias("translate")).alias("transform"), F.transform("r", lambda x: x["arc"]).alias("arcs"),
        F.struct(F.struct(F.lit("GeometryCollection").alias("type"), shapes.alias("geometries")).alias("drivers")).alias("objects"),
    )).alias("topojson"))


def saved_share(geojson: Column, topojson: Column) -> Column:
    """Share of characters that the topology saves."""
    return rules.half_up(1 - F.length(topojson) / F.nullif(F.length(geojson), F.lit(0)), 3)


def geocode_url(address: Column, token: str) -> Column:
    return F.concat(F.lit(f"{GEOCODE}/"), F.replace(F.url_encode(address), F.lit("+"), F.lit("%20")), F.lit(f".json?access_token={token}&limit=1&country=us"))


def isochrone_url(lon: Column, lat: Column, minutes: list[int], token: str) -> Column:
    contours = "%2C".join(map(str, minutes))
    return F.concat(F.lit(f"{ISOCHRONE}/driving/"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit(f"?access_token={token}&contours_minutes={contours}&polygons=true"))


def layer_style(source: str) -> dict:
    """How a client draws the features: circles coloured by severity, wider when more urgent."""
    colour = ["match", ["get", "severity"], *[x for pair in COLOURS.items() for x in pair], OTHER_COLOUR]
    width = ["interpolate", ["linear"], ["get", "urgency"], 0, 4, 135, 14]
    return {"id": f"{source}-circles", "type": "circle", "source": source, "paint": {"circle-color": colour, "circle-radius": width}}
