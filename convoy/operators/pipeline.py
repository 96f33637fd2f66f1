"""Readings to exceptions to incidents.

Column conventions: canonical readings (see convoy.schema) with ``seq``, the order in
which they count within a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy import schema
from convoy.functions import rules, spatial, text
from convoy.operators import density, nearest, spread
from convoy.operators.stored import stored

WITH_ORDER = ["tenant_id", "driver_id"]
_farthest = spread.farthest


def resolve_territory(readings: DataFrame, places: list[tuple[str, float, float]]) -> DataFrame:
    """Located readings get the district of the nearest depot; a fold over the short list, no join."""
    lon, lat = F.col("location.lon"), F.col("location.lat")
    named = F.struct(lon.alias("lon"), lat.alias("lat"), F.coalesce(spatial.nearest_of(lon, lat, places), F.lit("")).alias("district"))
    return readings.withColumn("location", F.when(F.col("location").isNotNull(), named))


def nearest_corridor(points: DataFrame, corridors: DataFrame, lon: Column, lat: Column, district: Column) -> DataFrame:
    """Points with the nearest corridor of their district (all corridors where the district is empty), none without candidates.

    Points meet a list of corridors that may be their nearest (see ``nearest``) and fold it; no pairs are made.
    """
    # each corridor stands in its district's group and in that of all
    groups = F.explode(F.array_distinct(F.array(F.col("district_id"), F.lit(""))))
    known = corridors.where(F.size("path") > 1).select("corridor_id", "name", "path", groups.alias("_of"))
    rows = nearest.candidates(points, lon, lat, F.coalesce(district, F.lit("")), known, nearest.path_box(F.col("path")), F.col("_of"), 1, nearest.flat_bounds)
    best = F.array_min(F.transform("_near", lambda c: F.struct(spatial.metres_from_path(lon, lat, c["path"]).alias("metres"), c["corridor_id"].alias("corridor_id"), c["name"].alias("name"))))
    # the best of any candidates is not null; a test of the fold itself would run it twice
    return rows.where(F.size("_near") > 0).withColumn("nearest", best).drop("_near")


def route_adherence(readings: DataFrame, corridors: DataFrame) -> DataFrame:
    """Readings followed by a derived one for every located position: its distance from the nearest corridor."""
    positions = readings.where((F.col("kind") == "position") & F.col("location").isNotNull())
    near = nearest_corridor(positions, corridors, F.col("location.lon"), F.col("location.lat"), F.col("location.district"))
    value = F.col("nearest.metres").cast("double")
    observed = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    derived = near.withColumns({
        "telemetry_id": text.content_id(F.col("provider"), F.concat("source_ref", F.lit(":adherence")), observed), "kind": F.lit("route-adherence"), "value": value, "unit": F.lit("metres"),
        "severity": rules.severity(F.lit("route-adherence"), value), "attributes": F.create_map(F.lit("corridorId"), F.col("nearest.corridor_id"), F.lit("corridorName"), F.col("nearest.name")),
    }).select(*readings.columns)
    return readings.unionByName(derived)


def fold_drivers(drivers: DataFrame, readings: DataFrame) -> DataFrame:
    """Drivers with the place and clock of their latest readings; drivers without readings stay as they are."""
    order = F.struct("observed_at", "telemetry_id")
    placed = (F.col("kind") == "position") & F.col("location").isNotNull()
    clock = F.col("kind") == "hos-remaining"
    facts = readings.where(placed | clock).groupBy(*WITH_ORDER).agg(
        F.max_by(F.when(placed, F.col("location")), F.when(placed, order)).alias("_place"),
        F.max_by(F.when(clock, F.col("value")), F.when(clock, order)).alias("_hos"),
        F.max("observed_at").alias("_at"),
    )
    return drivers.join(facts, WITH_ORDER, "left").select(*[
        {"lon": F.coalesce("_place.lon", "lon"), "lat": F.coalesce("_place.lat", "lat"), "hos_remaining_minutes": F.coalesce(F.col("_hos").cast("int"), "hos_remaining_minutes"), "updated_at": F.coalesce("_at", "updated_at")}.get(c, F.col(c)).alias(c)
        for c in drivers.columns
    ])


def evaluate(readings: DataFrame, drivers: DataFrame | None = None, as_of: Column | None = None, extra_rules: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Exceptions of each tenant's drivers, one per kind, by a single shuffle.

    as_of: when they are raised, the latest of the readings behind them where not given; by: more grouping columns, such as a batch number.
    """
    kinds = schema.RULES | (schema.EXTRA_RULES if extra_rules else {})
    one = F.struct("seq", "telemetry_id", "provider", rules.rank(F.col("severity")).alias("rank"), "observed_at")
    lists = [F.sort_array(F.collect_list(F.when((F.col("kind") == k) & (F.lit(k == "panic") | (F.col("severity") != "ok")), one))).alias(f"_{i}") for i, k in enumerate(kinds)]
    located = F.col("location").isNotNull()
    per_driver = readings.groupBy(*WITH_ORDER, *by).agg(F.min_by(F.when(located, F.col("location")), F.when(located, F.col("seq"))).alias("_place"), *lists)
    raised = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.lit(i).alias("ord"), F.col(f"_{i}").alias("found")) for i, name in enumerate(kinds.values())])).alias("e")
    rows = per_driver.select(*WITH_ORDER, *by, "_place", raised).where(F.size("e.found") > 0)
    if drivers is not None:
        home = drivers.select(*WITH_ORDER, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("district_id").alias("_home"))
        rows = rows.join(home, WITH_ORDER, "left")
    else:
        rows = rows.withColumns({"_lon": F.lit(None).cast("double"), "_lat": F.lit(None).cast("double"), "_home": F.lit(None).cast("string")})
    ids = F.transform("e.found", lambda r: r["telemetry_id"])
    worst = F.when(F.col("e.kind") == "panic", "critical").otherwise(rules.level(F.array_max(F.transform("e.found", lambda r: r["rank"]))))
    at = as_of if as_of is not None else F.array_max(F.transform("e.found", lambda r: r["observed_at"]))
    return rows.select(
        "tenant_id", text.content_id(F.col("tenant_id"), F.col("driver_id"), F.col("e.kind"), F.array_join(ids, ",")).alias("exception_id"), "driver_id",
        F.coalesce(F.nullif(F.col("_place.district"), F.lit("")), "_home", F.lit("")).alias("district_id"), F.col("e.kind").alias("kind"), worst.alias("severity"), ids.alias("telemetry_ids"),
        F.array_distinct(F.transform("e.found", lambda r: r["provider"])).alias("providers"),
        F.struct(F.coalesce("_place.lon", "_lon", F.lit(0.0)).alias("lon"), F.coalesce("_place.lat", "_lat", F.lit(0.0)).alias("lat")).alias("location"),
        F.lit(None).cast("string").alias("corridor_id"), at.alias("raised_at"), F.col("e.ord").alias("rule_order"), *by,
    )


def corroborated(exceptions: DataFrame, seconds: int = schema.CORROBORATE_SECONDS) -> DataFrame:
    """Exceptions that a second provider or a second kind of the same driver backs up, and kinds that need neither."""
    at = F.unix_micros(F.col("raised_at").cast("timestamp"))
    near = Window.partitionBy(*WITH_ORDER).orderBy("_at").rangeBetween(-seconds * 1_000_000, seconds * 1_000_000)
    rows = exceptions.withColumn("_at", at).withColumn("_kinds", F.size(F.collect_set("kind").over(near)))
    return rows.where(F.col("kind").isin(*schema.NEEDS_NO_SECOND) | (F.size("providers") >= 2) | (F.col("_kinds") > 1)).drop("_at", "_kinds")


def _lead(rows: pd.DataFrame) -> pd.DataFrame:
    """Assigns every row, in order, to the first leader that it matches, or makes it one."""
    rows = rows.sort_values(["at", "seq"], kind="stable")
    at, lon, lat, seq = (rows[c].to_numpy() for c in ("at", "lon", "lat", "seq"))
    rlon, rlat = np.radians(lon), np.radians(lat)
    leaders: list[int] = []
    out = np.empty(len(rows), np.int64)
    begin = 0  # leaders before this one are too old for all that follow
    for k in range(len(rows)):
        while begin < len(leaders) and at[k] - at[leaders[begin]] > schema.MERGE_SECONDS * 1_000_000:
            begin += 1
        near = np.array(leaders[begin:], np.int64)
        h = np.sin((rlat[near] - rlat[k]) / 2) ** 2 + np.cos(rlat[k]) * np.cos(rlat[near]) * np.sin((rlon[near] - rlon[k]) / 2) ** 2
        hit = np.flatnonzero(2 * spatial.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= schema.MERGE_KM)
        out[k] = near[hit[0]] if len(hit) else k
        if not len(hit):
            leaders.append(k)
    return pd.DataFrame({"exception_id": rows["exception_id"], "leader_id": rows["exception_id"].to_numpy()[out], "seq": seq})


#: Rows of a piece from which it is cut in space as well; below, cutting takes longer than what it saves.
LARGE_PIECE = 20_000


def _apart(slim: DataFrame, keys: list[str]) -> DataFrame:
    """``exception_id`` and ``part``: the part of its piece that it belongs to; rows of different parts can't merge.

    Rows fall into cells of the merge radius across and the merge window long.  Cells are linked where their boxes come within
    radius and window of each other; what hangs together is a part.
    """
    grid, window = density.Grid(schema.MERGE_KM), schema.MERGE_SECONDS * 1_000_000
    row = grid.row(F.col("lat"))
    cell = F.struct(*keys, F.expr(f"at div {window}").alias("time"), row.alias("row"), grid.column(F.col("lon"), row).alias("col"))
    placed = slim.select("exception_id", "at", cell.alias("_cell"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    cells = stored(placed.groupBy("_cell").agg(*density.box_of(), F.min("at").alias("begins"), F.max("at").alias("ends")), "merge-cells")
    at = F.col("_cell.row")
    near = F.concat(*[F.transform(grid.around(at, F.col("box"), first), lambda c: F.struct(F.lit(step).alias("step"), c.alias("c"))) for step, first in ((0, 0), (1, -2))])  # noqa: B023
    asked = cells.select("_cell", "box", "ends", F.explode(near).alias("_to"))
    target = F.struct(*[F.col(f"_cell.{k}").alias(k) for k in keys], (F.col("_cell.time") + F.col("_to.step")).alias("time"), F.col("_to.c.row").alias("row"), F.col("_to.c.col").alias("col"))
    asked = asked.withColumn("_target", target).where("_target > _cell")
    met = asked.join(cells.select(F.col("_cell").alias("_target"), F.col("box").alias("_box"), "begins"), "_target")
    low, _ = density.bounds(F.col("box"), F.col("_box"))
    met = met.where((low <= schema.MERGE_KM * (1 + density.SLACK)) & (F.col("begins") - F.col("ends") <= window))
    ways = met.select(F.col("_cell").alias("a"), F.col("_target").alias("b")).unionByName(met.select(F.col("_target").alias("a"), F.col("_cell").alias("b")))
    parts = density.components(cells.select(F.col("_cell").alias("node")), stored(ways, "merge-edges"))
    return placed.join(parts.select(F.col("node").alias("_cell"), F.col("label").alias("part")), "_cell").select("exception_id", F.xxhash64("part").alias("part"))


def merge(exceptions: DataFrame, order: list[str]) -> DataFrame:
    """Exceptions with ``leader_id``, the exception whose incident they belong to.

    Location-caused kinds join the first leader of their district within the radius and the window of it; others stand alone.
    A gap longer than the window ends all leaders, so each tenant's district is cut at gaps; large pieces are cut further into
    parts that are apart in space and time, and pieces and parts run apart.  Exceptions are computed once, and stored.
    order: columns that settle the order of exceptions raised at one moment.
    """
    # a total order as a number within each moment keeps the pieces free of other columns
    rows = stored(exceptions.withColumn("_at", F.unix_micros(F.col("raised_at").cast("timestamp"))), "exceptions")
    moving = rows.where(F.col("kind").isin(*schema.LOCATION_CAUSED))
    along = Window.partitionBy("tenant_id", "district_id").orderBy("_at", *order)
    gap = (F.col("_at") - F.lag("_at").over(along) > schema.MERGE_SECONDS * 1_000_000).cast("int")
    cut = moving.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("_seq", F.row_number().over(along)).withColumn("_piece", F.sum("_gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    slim = stored(cut.select("tenant_id", "district_id", "_piece", "exception_id", F.col("_at").alias("at"), F.col("_seq").cast("long").alias("seq"), F.col("location.lon").alias("lon"), F.col("location.lat").alias("lat")), "pieces")
    keys = ["tenant_id", "district_id", "_piece"]
    large = slim.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_PIECE)
    slim = slim.withColumn("part", F.lit(None).cast("long"))
    if not large.isEmpty():
        big = slim.join(large.select(*keys), keys, "left_semi").drop("part")
        slim = slim.join(large.select(*keys), keys, "left_anti").unionByName(big.join(_apart(big, keys), "exception_id").select(*slim.columns))
    led = slim.groupBy(*keys, "part").applyInPandas(lambda pdf: _lead(pdf), "exception_id string, leader_id string, seq long")
    alone = rows.where(~F.col("kind").isin(*schema.LOCATION_CAUSED)).withColumn("leader_id", F.col("exception_id"))
    return moving.join(led.select("exception_id", "leader_id"), "exception_id").unionByName(alone).drop("_at")


def incidents(merged: DataFrame, order: list[str], opened_at: Column | None = None) -> DataFrame:
    """One row per leader with its members, severity and title."""
    one = F.struct("raised_at", *order, "exception_id", "driver_id", "kind", rules.rank(F.col("severity")).alias("rank"), "district_id")
    rows = merged.groupBy("tenant_id", "leader_id").agg(F.sort_array(F.collect_list(one)).alias("m"), F.max("raised_at").alias("_last"))
    drivers = F.array_distinct(F.transform("m", lambda x: x["driver_id"]))
    kind = F.array_min(F.transform("m", lambda x: F.struct(rules.kind_order(x["kind"]).alias("o"), x["kind"].alias("kind"))))["kind"]
    lead = F.filter("m", lambda x: x["exception_id"] == F.col("leader_id"))
    district = F.get(lead, F.lit(0))["district_id"]
    title = F.when(F.size(drivers) > 1, F.concat(rules.title_of(kind), F.lit(" affecting "), F.size(drivers).cast("string"), F.lit(" drivers in "), district)).otherwise(F.concat(rules.title_of(kind), F.lit(" - driver "), F.get(drivers, F.lit(0))))
    return rows.select(
        "tenant_id", text.content_id(F.col("tenant_id"), F.col("leader_id")).alias("incident_id"), title.alias("title"), rules.level(F.array_max(F.transform("m", lambda x: x["rank"]))).alias("severity"),
        F.lit("open").alias("status"), district.alias("district_id"), drivers.alias("driver_ids"), F.transform("m", lambda x: x["exception_id"]).alias("exception_ids"),
        (opened_at if opened_at is not None else F.col("_last")).alias("opened_at"), F.lit(None).cast("string").alias("ai_summary"),
        F.lit(None).cast("array<struct<source:string,snippet:string>>").alias("ai_citations"),
    )


def detect(exceptions: DataFrame, order: list[str] | None = None, opened_at: Column | None = None) -> DataFrame:
    keys = order or ["exception_id"]
    return incidents(merge(corroborated(exceptions), keys), [k for k in keys if k != "exception_id"], opened_at)


def spread_km(found: DataFrame, drivers: DataFrame) -> DataFrame:
    """Incidents with the largest distance between two of their drivers, to one decimal; 0 for fewer than two places.

    Incidents of many drivers go by extremes and cells; the others' places fit in a row.
    """
    found, keys = stored(found, "spread-incidents"), ["tenant_id", "incident_id"]
    places = drivers.select(*WITH_ORDER, "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL")
    many = F.size("driver_ids") > spread.WHOLE
    points = lambda rows: rows.select(*keys, F.explode("driver_ids").alias("driver_id")).join(places, WITH_ORDER)
    sizes = spread.compared(points(found.where(~many)), keys)
    if not found.where(many).isEmpty():
        sizes = sizes.unionByName(spread.largest(points(found.where(many)), keys))
    sizes = sizes.select(*keys, rules.half_up(F.col("km"), 1).alias("spread_km"))
    return found.join(sizes, keys, "left").withColumn("spread_km", F.coalesce("spread_km", F.lit(0.0)))


def events_of(exceptions: DataFrame, found: DataFrame) -> DataFrame:
    """The bus events that a publish emits: one per exception and per incident, none for readings."""
    raised = exceptions.select(F.lit("convoy.evaluate").alias("source"), F.lit("ExceptionRaised").alias("detail_type"), F.to_json(F.struct("tenant_id", "exception_id", "driver_id", "district_id", "kind", "severity")).alias("detail"), F.col("raised_at").alias("time"))
    opened = found.select(F.lit("convoy.detect").alias("source"), F.lit("IncidentOpened").alias("detail_type"), F.to_json(F.struct("tenant_id", "incident_id", "severity", "district_id", "driver_ids", "title")).alias("detail"), F.col("opened_at").alias("time"))
    return raised.unionByName(opened)


def ingest(raw: DataFrame, drivers: DataFrame, places: list[tuple[str, float, float]], corridors: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    """The whole way from raw records to incidents; tables by name, lazy ones, but that merging stores the exceptions."""
    from convoy.operators.sinks import quarantine
    from convoy.sources.adapters import normalise
    from convoy.sources.registry import allowed

    good, bad = quarantine(normalise(allowed(raw)))
    readings = route_adherence(resolve_territory(good, places), corridors)
    exceptions = evaluate(readings, drivers, as_of)
    return {"telemetry": readings, "quarantined": bad, "drivers": fold_drivers(drivers, readings), "exceptions": exceptions, "incidents": detect(exceptions, opened_at=as_of)}


class Landing:
    """Tables written once each and read back by what follows, so that nothing is parsed, judged or merged twice; counts come
    from the writes themselves."""

    def __init__(self, folder: str, spot: str = ""):
        self.folder, self.spot = folder, f"/{spot}" if spot else ""
        self.counts: dict[str, int] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}{self.spot}"

    def write(self, name: str, df: DataFrame, at: str | None = None) -> DataFrame:
        """The rows as written, in place of what an earlier try left there; ``at``: another path."""
        seen, path = Observation(), at or self.path(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        self.counts[name] = seen.get.get("n", 0)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def land(raw: DataFrame, drivers: DataFrame, places: list[tuple[str, float, float]], corridors: DataFrame, to: Landing, as_of: Column | None = None, drivers_at: str | None = None) -> dict[str, DataFrame]:
    """Raw records to stored readings, rejects, drivers and exceptions, by name; each record is parsed once."""
    from convoy.operators.sinks import quarantine
    from convoy.sources.adapters import normalise
    from convoy.sources.registry import allowed

    seen = Observation()
    good, bad = quarantine(stored(normalise(allowed(raw)).observe(seen, F.count(F.lit(1)).alias("n")), "parsed"))
    to.counts["parsed"] = seen.get.get("n", 0)
    readings = to.write("telemetry", route_adherence(resolve_territory(good, places), corridors))
    return {
        "telemetry": readings, "quarantined": to.write("quarantined", bad), "drivers": to.write("drivers", fold_drivers(drivers, readings), drivers_at),
        "exceptions": to.write("exceptions", evaluate(readings, drivers, as_of)),
    }


def publish(raw: DataFrame, drivers: DataFrame, places: list[tuple[str, float, float]], corridors: DataFrame, folder: str, as_of: Column | None = None) -> DataFrame:
    """The whole way from raw records to tables: readings, rejects, drivers, exceptions and incidents, then the events that they
    cause; returns the counts, with that of the readings parsed, which is all that any step has parsed."""
    to = Landing(folder)
    tables = land(raw, drivers, places, corridors, to, as_of)
    found = to.write("incidents", detect(tables["exceptions"], opened_at=as_of))
    events_of(tables["exceptions"], found).write.mode("overwrite").json(to.path("events"))
    return raw.sparkSession.createDataFrame(list(to.counts.items()), "record string, n long")
