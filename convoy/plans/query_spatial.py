"""Spatial functions, joins and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.functions import rules, spatial
from convoy.operators import density, exports, pipeline, places
from convoy.operators.access import Engine, Principal
from convoy.plans.registered import LEVEL, RANK, km, query, up
from convoy.schema import US_SOUTH

HOME = "{drivers} d JOIN {territories} h USING (district_id)"


def _home(t):
    return t.drivers.join(F.broadcast(t.territories.select("district_id", F.col("lon").alias("hlon"), F.col("lat").alias("hlat"))), "district_id")


@query("haversine", f"SELECT driver_id, {up(km('d.lon', 'd.lat', 'h.lon', 'h.lat'), 3)} AS km FROM {HOME}")
def haversine(t):
    return _home(t).select("driver_id", rules.half_up(spatial.haversine_km(F.col("lon"), F.col("lat"), F.col("hlon"), F.col("hlat")), 3).alias("km"))


@query("bbox_around", f"SELECT driver_id, {up('lon - 25 / (111.32 * cos(radians(lat)))', 5)} AS west, {up('lat - 25 / 111.32::DOUBLE', 5)} AS south, {up('lon + 25 / (111.32 * cos(radians(lat)))', 5)} AS east, {up('lat + 25 / 111.32::DOUBLE', 5)} AS north FROM {{drivers}}")
def bbox_around(t):
    box = spatial.bbox_around(F.col("lon"), F.col("lat"), F.lit(25.0))
    return t.drivers.select("driver_id", *[rules.half_up(c, 5).alias(n) for n, c in box.items()])


@query("in_bbox", "SELECT driver_id FROM {drivers} WHERE lon BETWEEN -104.3 AND -97.9 AND lat BETWEEN 27.9 AND 36.2")
def in_bbox(t):
    box = {"west": F.lit(-104.3), "south": F.lit(27.9), "east": F.lit(-97.9), "north": F.lit(36.2)}
    return t.drivers.where(spatial.in_bbox(F.col("lon"), F.col("lat"), box)).select("driver_id")


_EDGES = " UNION ALL ".join(f"SELECT CAST({a[0]} AS DOUBLE) AS ax, CAST({a[1]} AS DOUBLE) AS ay, CAST({b[0]} AS DOUBLE) AS bx, CAST({b[1]} AS DOUBLE) AS b_y" for a, b in zip(US_SOUTH, US_SOUTH[1:], strict=False))


@query("region_of", f"WITH e AS ({_EDGES}) SELECT driver_id, CASE WHEN count_if((ay > lat) <> (b_y > lat) AND lon < (bx - ax) * (lat - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 THEN 'us-south' END AS region FROM {{drivers}}, e GROUP BY driver_id")
def region_of(t):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in US_SOUTH])
    return t.drivers.select("driver_id", F.when(spatial.in_ring(F.col("lon"), F.col("lat"), ring), "us-south").alias("region"))


@query("close_ring", "SELECT district_id, CASE WHEN CAST(district_id AS INT) % 3 = 0 THEN 0 ELSE 4 END AS n, CASE WHEN CAST(district_id AS INT) % 3 <> 0 THEN lon END AS last FROM {territories}")
def close_ring(t):
    at = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    n = F.col("district_id").cast("int") % 3
    open_, closed = F.array(at(0, 0), at(1, 0), at(0, 1)), F.array(at(0, 0), at(1, 0), at(0, 1), at(0, 0))
    ring = spatial.close_ring(F.when(n == 0, F.slice(open_, 1, 0)).when(n == 1, open_).otherwise(closed))
    return t.territories.select("district_id", F.size(ring).alias("n"), F.get(ring, F.size(ring) - 1)["lon"].alias("last"))


_EDGE_VIEW = "e AS (SELECT corridor_id, district_id, pos, lon AS bx, lat AS b_y, lag(lon) OVER w AS ax, lag(lat) OVER w AS ay FROM {corridor_points} WINDOW w AS (PARTITION BY corridor_id ORDER BY pos))"
_METRES = """
m AS (SELECT driver_id, corridor_id, min(((ax - lon) * kx + s * dx) * ((ax - lon) * kx + s * dx) + ((ay - lat) * 111320 + s * dy) * ((ay - lat) * 111320 + s * dy)) AS sq FROM (
    SELECT *, greatest(0.0, least(1.0, -((ax - lon) * kx * dx + (ay - lat) * 111320 * dy) / (dx * dx + dy * dy))) AS s FROM (
        SELECT d.driver_id, d.lon, d.lat, e.*, 111320 * cos(radians(d.lat)) AS kx, (bx - ax) * 111320 * cos(radians(d.lat)) AS dx, (b_y - ay) * 111320 AS dy
        FROM {drivers} d JOIN e ON d.district_id = e.district_id WHERE ax IS NOT NULL)) GROUP BY ALL)"""


@query("metres_from_line", f"WITH {_EDGE_VIEW}, {_METRES} SELECT driver_id, corridor_id, CAST({up('sqrt(sq)')} AS BIGINT) AS metres FROM m")
def metres_from_line(t):
    both = t.drivers.join(F.broadcast(t.corridors.select("district_id", "corridor_id", "path")), "district_id")
    return both.select("driver_id", "corridor_id", spatial.metres_from_path(F.col("lon"), F.col("lat"), F.col("path")).alias("metres"))


@query("nearest_corridor", f"WITH {_EDGE_VIEW}, {_METRES}, r AS (SELECT driver_id, corridor_id, {up('sqrt(sq)')} AS metres, row_number() OVER (PARTITION BY driver_id ORDER BY {up('sqrt(sq)')}, corridor_id) AS n FROM m) SELECT driver_id, corridor_id, CAST(metres AS BIGINT) AS metres FROM r WHERE n = 1")
def nearest_corridor(t):
    near = pipeline.nearest_corridor(t.drivers.withColumnRenamed("district_id", "at"), t.corridors, F.col("lon"), F.col("lat"), F.col("at"))
    return near.select("driver_id", F.col("nearest.corridor_id").alias("corridor_id"), F.col("nearest.metres").alias("metres"))


_ALONG = """
l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS n FROM e WHERE ax IS NOT NULL),
c AS (SELECT *, sum(n) OVER (PARTITION BY corridor_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY corridor_id) AS total, max(pos) OVER (PARTITION BY corridor_id) AS last FROM l)"""


@query("point_along", f"WITH {_EDGE_VIEW}, {_ALONG}, s AS (SELECT c.*, i AS step, i / 10.0 * total AS target FROM c, (SELECT unnest(range(0, 11)) AS i)), h AS (SELECT *, row_number() OVER (PARTITION BY corridor_id, step ORDER BY pos) AS k FROM s WHERE target <= upto + 1e-12 OR pos = last) SELECT corridor_id, CAST(step AS INT) AS step, {up('ax + (bx - ax) * (target - upto + n) / n', 5)} AS lon, {up('ay + (b_y - ay) * (target - upto + n) / n', 5)} AS lat FROM h WHERE k = 1")
def point_along(t):
    rows = t.corridors.select("corridor_id", "path", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("step"))
    p = spatial.point_along(F.col("path"), F.col("step") / 10)
    return rows.select("corridor_id", "step", rules.half_up(p["lon"], 5).alias("lon"), rules.half_up(p["lat"], 5).alias("lat"))


@query("trace_cross", f"WITH {_EDGE_VIEW}, {_ALONG}, s AS (SELECT d.driver_id, c.*, i AS tick, fmod(CAST(d.driver_id AS BIGINT) % 97 / 97.0::DOUBLE + i * 0.03::DOUBLE, 1) * total AS target FROM {{drivers}} d JOIN c ON c.corridor_id = d.district_id || '-0', (SELECT unnest(range(0, 10)) AS i) WHERE d.status = 'driving'), h AS (SELECT *, row_number() OVER (PARTITION BY driver_id, tick ORDER BY pos) AS k FROM s WHERE target <= upto OR pos = last) SELECT driver_id, CAST(tick AS INT) AS tick, {up('ax + (bx - ax) * (target - upto + n) / n', 4)} AS lon, {up('ay + (b_y - ay) * (target - upto + n) / n', 4)} AS lat FROM h WHERE k = 1")
def trace_cross(t):
    road = t.corridors.where("corridor_id = concat(district_id, '-0')").select("district_id", "path")
    cars = t.drivers.where("status = 'driving'").join(F.broadcast(road), "district_id").withColumns({"progress": F.col("driver_id").cast("bigint") % 97 / 97.0, "speed": F.lit(0.03)})
    rows = places.moved(cars.select("driver_id", "path", "progress", "speed"), 10)
    return rows.select("driver_id", F.col("tick_index").alias("tick"), rules.half_up(F.col("place.lon"), 4).alias("lon"), rules.half_up(F.col("place.lat"), 4).alias("lat"))


@query("geojson_point", "SELECT district_id, '{\"type\":\"Point\",\"coordinates\":[' || lon || ',' || lat || ']}' AS shape FROM {territories}")
def geojson_point(t):
    return t.territories.select("district_id", spatial.point_json(F.col("lon"), F.col("lat")).alias("shape"))


@query("nearest_depot", f"SELECT seq, district_id FROM (SELECT r.seq, h.district_id, row_number() OVER (PARTITION BY r.seq ORDER BY {km('r.lon', 'r.lat', 'h.lon', 'h.lat')}, h.district_id) AS n FROM {{telemetry}} r, {{territories}} h WHERE r.kind = 'position') WHERE n = 1")
def nearest_depot(t):
    spots = t.telemetry.where("kind = 'position'").select("seq", "lon", "lat")
    return places.nearest_place(spots, t.territories, "seq", "district_id").select("seq", "district_id")


@query("knn_depot", f"SELECT driver_id, CAST(n AS INT) AS rank, district_id, {up('km', 3)} AS km FROM (SELECT d.driver_id, h.district_id, {km('d.lon', 'd.lat', 'h.lon', 'h.lat')} AS km, row_number() OVER (PARTITION BY d.driver_id ORDER BY {km('d.lon', 'd.lat', 'h.lon', 'h.lat')}, h.district_id) AS n FROM {{drivers}} d, {{territories}} h) WHERE n <= 3")
def knn_depot(t):
    near = places.nearest_place(t.drivers.select("driver_id", "lon", "lat"), t.territories, "driver_id", "district_id", 3)
    return near.select("driver_id", "rank", "district_id", rules.half_up(F.col("km"), 3).alias("km"))


@query("knn_corridor", f"WITH {_EDGE_VIEW}, {_METRES.replace('d.district_id = e.district_id', 'true')}, r AS (SELECT driver_id, corridor_id, {up('sqrt(sq)')} AS metres, row_number() OVER (PARTITION BY driver_id ORDER BY {up('sqrt(sq)')}, corridor_id) AS n FROM m) SELECT driver_id, CAST(n AS INT) AS rank, corridor_id, CAST(metres AS BIGINT) AS metres FROM r WHERE n <= 3")
def knn_corridor(t):
    metres = lambda c: spatial.metres_from_path(F.col("lon"), F.col("lat"), c["path"])
    near = places.nearest_place(t.drivers.select("driver_id", "lon", "lat"), t.corridors.select("corridor_id", "path"), "driver_id", "corridor_id", 3, metres, "path")
    return near.select("driver_id", "rank", "corridor_id", F.col("km").alias("metres"))


_FENCE = "SELECT district_id AS fence_id, lon AS cx, lat AS cy FROM {territories}"
_CORNERS = ((-0.35, -0.21), (0.41, -0.33), (0.27, 0.37), (-0.13, 0.11))


@query("point_in_polygon", "WITH f AS (" + _FENCE + "), e AS (" + " UNION ALL ".join(f"SELECT fence_id, cx + ({a[0]})::DOUBLE AS ax, cy + ({a[1]})::DOUBLE AS ay, cx + ({b[0]})::DOUBLE AS bx, cy + ({b[1]})::DOUBLE AS b_y FROM f" for a, b in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True)) + ") SELECT driver_id, fence_id FROM {drivers}, e GROUP BY driver_id, fence_id HAVING count_if((ay > lat) <> (b_y > lat) AND lon < (bx - ax) * (lat - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1")
def point_in_polygon(t):
    ring = F.array(*[F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in _CORNERS])
    fences = t.territories.select(F.col("district_id").alias("fence_id"), ring.alias("boundary"))
    return places.containing(t.drivers.select("driver_id", "lon", "lat"), fences).select("driver_id", "fence_id")


_NEAR = km("lon", "lat", "-98.0::DOUBLE", "32.0::DOUBLE")


@query("drivers_within_radius", f"SELECT driver_id, {up(_NEAR, 2)} AS distance_km FROM {{drivers}} WHERE tenant_id = '0' AND {_NEAR} <= 300 ORDER BY distance_km, driver_id LIMIT 50")
def drivers_within_radius(t):
    return Engine({"drivers": t.drivers}).seen_by(Principal("0")).drivers_near(-98.0, 32.0, 300).select("driver_id", "distance_km")


@query("available_near_sql", f"SELECT driver_id, {up(_NEAR, 2)} AS distance_km FROM {{drivers}} WHERE tenant_id = '1' AND status IN ('stopped', 'on-break') AND hos_remaining_minutes > 60 AND {_NEAR} <= 700 ORDER BY distance_km, driver_id LIMIT 20")
def available_near_sql(t):
    return Engine({"drivers": t.drivers}).seen_by(Principal("1")).available_near(-98.0, 32.0, 700).select("driver_id", "distance_km")


@query("available_near_ts", f"SELECT driver_id, distance_km FROM (SELECT driver_id, status, hos_remaining_minutes, {up(_NEAR, 2)} AS distance_km FROM {{drivers}} WHERE tenant_id = '1' AND {_NEAR} <= 700 ORDER BY distance_km, driver_id LIMIT 50) WHERE status IN ('stopped', 'on-break') AND hos_remaining_minutes > 60")
def available_near_ts(t):
    mine = t.drivers.where("tenant_id = '1'")
    return places.available_near(mine, F.lit(-98.0), F.lit(32.0), 700, filter_last=True).select("driver_id", "distance_km")


@query("reassign_candidates", f"WITH me AS (SELECT lon AS x, lat AS y FROM {{drivers}} WHERE tenant_id = '0' AND driver_id = '30') SELECT driver_id, {up(km('x', 'y', 'lon', 'lat'), 2)} AS distance_km FROM {{drivers}}, me WHERE tenant_id = '0' AND driver_id <> '30' AND status IN ('stopped', 'on-break') AND hos_remaining_minutes > 60 AND {km('x', 'y', 'lon', 'lat')} <= 500 ORDER BY distance_km, driver_id LIMIT 20")
def reassign_candidates(t):
    return Engine({"drivers": t.drivers}).seen_by(Principal("0")).reassign_candidates("30", 500).select("driver_id", "distance_km")


@query("radius_join", f"SELECT a.driver_id AS a, b.driver_id AS b FROM {{drivers}} a JOIN {{drivers}} b ON a.district_id = b.district_id AND a.driver_id < b.driver_id WHERE {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 5")
def radius_join(t):
    slim = t.drivers.select("driver_id", "district_id", "lon", "lat")
    near = places.radius_join(slim, slim, 5).where("l.driver_id < r.driver_id AND l.district_id = r.district_id")
    return near.select(F.col("l.driver_id").alias("a"), F.col("r.driver_id").alias("b"))


@query("dbscan_minpts2", f"WITH RECURSIVE e AS (SELECT a.tenant_id, a.driver_id AS a, b.driver_id AS b FROM {{drivers}} a JOIN {{drivers}} b ON a.tenant_id = b.tenant_id AND a.district_id = b.district_id AND a.driver_id <> b.driver_id AND {km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 4), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), c AS (SELECT node, min(reach) AS cluster FROM r GROUP BY node) SELECT driver_id, cluster FROM {{drivers}} LEFT JOIN c ON driver_id = node")
def dbscan_minpts2(t):
    return density.clusters(t.drivers, "driver_id", 4000, ["tenant_id", "district_id"]).select("driver_id", "cluster")


@query("centroid", f"SELECT district_id, {up('avg(lon)', 6)} AS lon, {up('avg(lat)', 6)} AS lat FROM {{drivers}} GROUP BY district_id")
def centroid(t):
    return t.drivers.groupBy("district_id").agg(rules.half_up(F.avg("lon"), 6).alias("lon"), rules.half_up(F.avg("lat"), 6).alias("lat"))


@query("bbox_agg", "SELECT tenant_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM {drivers} GROUP BY tenant_id")
def bbox_agg(t):
    return exports.bbox(t.drivers, "tenant_id")


_FACTS = f"f AS (SELECT tenant_id, driver_id, max({RANK.format('severity')}) AS rank, count(*) AS n FROM {{telemetry}} GROUP BY ALL)"


@query("map_layer", f"WITH {_FACTS} SELECT d.driver_id, d.district_id, {LEVEL.format('coalesce(rank, 0)')} AS severity, coalesce(n, 0) AS reading_count, d.lon, d.lat FROM {{drivers}} d LEFT JOIN f USING (tenant_id, driver_id) WHERE d.tenant_id = '1'")
def map_layer(t):
    return Engine({"drivers": t.drivers, "telemetry": t.telemetry}).seen_by(Principal("1")).map_layer().select("driver_id", "district_id", "severity", "reading_count", "lon", "lat")


@query("driver_urgency", f"WITH {_FACTS} SELECT driver_id, CAST({up('coalesce(rank, 0) * 25 + greatest(0, 120 - hos_remaining_minutes) / 2')} AS BIGINT) AS urgency FROM {{drivers}} LEFT JOIN f USING (tenant_id, driver_id)")
def driver_urgency(t):
    return exports.driver_features(t.drivers, t.telemetry).select("driver_id", "urgency")


_FEATURE = """'{"type":"Feature","id":"' || district_id || '","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"district_id":"' || district_id || '","name":"' || name || '","region":"' || region || '"}}'"""


@query("geojson_agg", """SELECT region, '{"type":"FeatureCollection","features":[' || string_agg(""" + _FEATURE + """, ',' ORDER BY district_id) || ']}' AS geojson FROM {territories} GROUP BY region""")
def geojson_agg(t):
    return exports.feature_collection(t.territories, "district_id", "region")


@query("topo_quantise", f"WITH b AS (SELECT min(lon) AS w, min(lat) AS s, (max(lon) - min(lon)) / 9999.0::DOUBLE AS kx, (max(lat) - min(lat)) / 9999.0::DOUBLE AS ky FROM {{drivers}}) SELECT driver_id, CAST({up('(lon - w) / kx')} AS BIGINT) AS qx, CAST({up('(lat - s) / ky')} AS BIGINT) AS qy FROM {{drivers}}, b")
def topo_quantise(t):
    return exports.quantise(t.drivers.select("driver_id", "lon", "lat")).select("driver_id", "qx", "qy")


@query("topo_roundtrip", "SELECT driver_id, true AS close FROM {drivers}")
def topo_roundtrip(t):
    coded = exports.quantise(t.drivers.select("driver_id", "lon", "lat", F.col("lon").alias("x"), F.col("lat").alias("y")))
    back = exports.decode(coded)
    return back.select("driver_id", ((F.abs(F.col("lon") - F.col("x")) <= F.col("kx") * 0.5000001) & (F.abs(F.col("lat") - F.col("y")) <= F.col("ky") * 0.5000001)).alias("close"))


@query("delta_encode", f"WITH b AS (SELECT min(lon) AS w, min(lat) AS s, (max(lon) - min(lon)) / 9999.0::DOUBLE AS kx, (max(lat) - min(lat)) / 9999.0::DOUBLE AS ky FROM {{corridor_points}}), q AS (SELECT corridor_id, pos, CAST({up('(lon - w) / kx')} AS BIGINT) AS qx, CAST({up('(lat - s) / ky')} AS BIGINT) AS qy FROM {{corridor_points}}, b) SELECT corridor_id, pos, qx - lag(qx, 1, 0) OVER (PARTITION BY corridor_id ORDER BY pos) AS dx, qy - lag(qy, 1, 0) OVER (PARTITION BY corridor_id ORDER BY pos) AS dy FROM q")
def delta_encode(t):
    return exports.delta_encode(exports.quantise(t.corridor_points), ["corridor_id"], "pos").select("corridor_id", "pos", "dx", "dy")
