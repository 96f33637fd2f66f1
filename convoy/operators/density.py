"""Density clusters (DBSCAN) of points on the sphere, exact, without listing a cell's pairs.

Points fall into grid cells whose diagonal is the distance, so the points of a cell are
all neighbours.  A cell of ``min_points`` or more is a site as a whole, all of it core; in other
cells each point is a site.  What matters between two sites is how many points of one a
single point of the other has around it, or whether any two are close.  Bounding boxes
settle that for most pairs of sites; where they do not, both sites are cut into sixteen
boxes each, and only pairs of boxes that are neither wholly near nor wholly far are cut again,
until few points are left, which are then compared.  Sites are joined into components
by their smallest labels.

All steps are aggregates and equi-joins; a cell with a million points costs what the
million points cost anywhere else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions import spatial
from convoy.operators.stored import stored

#: Pairs of points up to which two boxes are compared point by point.
FEW = 256
#: A box is cut into so many parts a side.
PARTS = 4
#: Room for rounding in what boxes decide.
SLACK = 1e-9


class Grid:
    """Rows of equal height, each cut into columns that are no wider than high at its edge nearer to the equator."""

    def __init__(self, km: float):
        self.reach = km / spatial.EARTH_KM  # as an angle
        if self.reach > 0.2:
            raise ValueError("clusters are for distances of up to 1,274 km")
        self.side = math.degrees(self.reach) / math.sqrt(2) * (1 - self.reach**2 / 6) * 0.9999

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.side)

    def columns(self, row: Column) -> Column:
        south, north = row * self.side - 90, (row + 1) * self.side - 90
        widest = F.when((south < 0) & (north > 0), F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(widest)) / self.side))

    def column(self, lon: Column, row: Column) -> Column:
        n = self.columns(row)
        return F.least(F.floor((lon + 180) / 360 * n), n - 1)

    def around(self, row: Column, box: Column, first: int = 0) -> Column:
        """Cells (row and column) in the rows from ``first`` to two on that may hold points within reach of a box."""
        high = F.greatest(F.abs(box["south"]), F.abs(box["north"]))
        wide = F.when(F.radians(high) + self.reach >= math.pi / 2 - SLACK, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(self.reach) / F.cos(F.radians(high))))))

        def cells(step: int) -> Column:
            n = self.columns(row + step)
            west, east = F.floor((box["west"] - wide + 180) / 360 * n), F.floor((box["east"] + wide + 180) / 360 * n)
            return F.transform(F.sequence(west, F.least(east, west + n - 1)), lambda c: F.struct((row + step).alias("row"), F.pmod(c, n).alias("col")))

        return F.concat(*[cells(k) for k in range(first, 3)])


def box_of() -> list[Column]:
    return [F.struct(F.min("_lon").alias("west"), F.min("_lat").alias("south"), F.max("_lon").alias("east"), F.max("_lat").alias("north")).alias("box"), F.count("*").alias("n")]


def bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Distances in km that no pair of points of two boxes is below, or above."""
    straight, round_ = F.greatest(a["east"], b["east"]) - F.least(a["west"], b["west"]), 360 - F.abs(a["west"] - b["west"])
    apart = F.greatest(F.lit(0.0), F.least(F.greatest(a["west"] - b["east"], b["west"] - a["east"]), 360 - straight))
    spread = F.least(straight, round_ + (a["east"] - a["west"]) + (b["east"] - b["west"]), F.lit(180.0))
    below = F.greatest(F.lit(0.0), a["south"] - b["north"], b["south"] - a["north"])
    across = F.greatest(a["north"], b["north"]) - F.least(a["south"], b["south"])
    least = lambda box: F.cos(F.radians(F.greatest(F.abs(box["south"]), F.abs(box["north"]))))
    most = lambda box: F.cos(F.radians(F.when((box["south"] < 0) & (box["north"] > 0), F.lit(0.0)).otherwise(F.least(F.abs(box["south"]), F.abs(box["north"])))))
    sine = lambda d: F.sin(F.radians(d) / 2) * F.sin(F.radians(d) / 2)
    far = lambda h: 2 * spatial.EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    return far(sine(below) + least(a) * least(b) * sine(apart)), far(sine(across) + most(a) * most(b) * sine(spread))


def _judged(pairs: DataFrame, km: float) -> DataFrame:
    """Pairs of boxes (structs a and b with box and n) that are not far apart, with ``near``: true if wholly within the distance, null if open."""
    low, high = bounds(F.col("a.box"), F.col("b.box"))
    point = lambda x: (F.col(f"{x}.box.west") == F.col(f"{x}.box.east")) & (F.col(f"{x}.box.south") == F.col(f"{x}.box.north"))
    exact = spatial.haversine_km(F.col("a.box.west"), F.col("a.box.south"), F.col("b.box.west"), F.col("b.box.south")) <= km
    near = F.when(point("a") & point("b"), exact).when(high <= km * (1 - SLACK), True).when(low > km * (1 + SLACK), False)
    return pairs.withColumn("near", near).where("near IS NULL OR near")


def _links(pairs: DataFrame, inside: DataFrame, km: float) -> DataFrame:
    """Site pairs (``l`` and ``r``, a point never on the right of a whole cell) that have points within the distance, with
    ``n``: how many points of r a point l has there; any number above 0 for two whole cells.

    pairs: l, r, ``both`` (two whole cells), structs a and b (x, y, box, n).  inside: ``site``, ``_lon``, ``_lat`` and ``_u``, ``_v``, the place in the cell as shares."""
    at = lambda level: {"_x": F.floor(F.col("_u") * PARTS**level).cast("long"), "_y": F.floor(F.col("_v") * PARTS**level).cast("long")}
    level, out = 0, []
    todo = stored(_judged(pairs, km), "pairs")
    while True:
        out.append(todo.where("near").select("l", "r", F.col("b.n").alias("n")))
        rest = todo.where("near IS NULL")
        if level and not rest.isEmpty():  # two cells that have met somewhere need no more looking
            rest = rest.join(todo.where("near AND both").select("l", "r").distinct(), ["l", "r"], "left_anti")
        if rest.isEmpty():
            break
        few = F.col("a.n") * F.col("b.n") <= FEW
        own = inside.withColumns(at(level))
        one = lambda side: own.select(*[F.col(c).alias(f"_{side}{c}") for c in ("site", "_x", "_y", "_lon", "_lat")])  # noqa: B023, E731
        meet = lambda side, site: (F.col(site) == F.col(f"_{side}site")) & (F.col(f"{side}.x") == F.col(f"_{side}_x")) & (F.col(f"{side}.y") == F.col(f"_{side}_y"))
        met = rest.where(few).join(one("a"), meet("a", "l")).join(one("b"), meet("b", "r"))
        met = met.where(spatial.haversine_km(F.col("_a_lon"), F.col("_a_lat"), F.col("_b_lon"), F.col("_b_lat")) <= km)
        out.append(met.groupBy("l", "r").agg(F.count("*").alias("n")))
        rest = rest.where(~few)
        if rest.isEmpty():
            break
        level += 1
        used = rest.select(F.col("l").alias("site")).unionByName(rest.select(F.col("r").alias("site"))).distinct()
        nodes = stored(inside.join(used, "site", "left_semi").withColumns(at(level)).groupBy("site", "_x", "_y").agg(*box_of()), "boxes")
        child = lambda side: nodes.select(F.col("site").alias(f"_{side}site"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), "box", "n").alias(f"_{side}"), F.expr(f"_x div {PARTS}").alias(f"_{side}_x"), F.expr(f"_y div {PARTS}").alias(f"_{side}_y"))  # noqa: B023, E731
        cut = rest.join(child("a"), meet("a", "l")).join(child("b"), meet("b", "r")).select("l", "r", "both", F.col("_a").alias("a"), F.col("_b").alias("b"))
        todo = stored(_judged(cut, km), "pairs")
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total.groupBy("l", "r").agg(F.sum("n").alias("n"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that edges lead to; nodes: ``node``; edges: ``a``, ``b``, both ways, stored.

    The smallest label spreads along the edges, and with it the label of the label, until nothing changes."""
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    moved = not labels.isEmpty()
    while moved:
        seen = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        new = labels.join(seen, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jump = stored(new.join(further, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        moved, labels = not jump.where("label <> old").isEmpty(), jump.select("node", "label")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def clusters(points: DataFrame, key: str, metres: float, by: list[str], min_points: int = 2) -> DataFrame:
    """The points with ``cluster``: the smallest key of the core points of their cluster, null for noise.

    A core point has ``min_points`` points of the same ``by`` within the distance, itself included.  Core points within
    the distance of each other share a cluster; others join that of the core points around them, of several the one with the
    smallest key.  Keys are unique within ``by``.  Points that are no places are noise.
    """
    km, grid = metres / 1000, Grid(metres / 1000)
    ok = spatial.valid_point(F.col("lon"), F.col("lat"))
    row = grid.row(F.col("lat"))
    cell = F.when(ok, F.struct(*by, row.alias("row"), grid.column(F.col("lon"), row).alias("col")))
    placed = points.withColumn("_cell", cell)
    slim = placed.where("_cell IS NOT NULL").select("_cell", F.struct(*by, F.col(key).alias("key")).alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    cells = slim.groupBy("_cell").agg(*box_of(), F.min("_id").alias("_first")).withColumn("whole", F.col("n") >= min_points)
    cells = stored(cells, "cells")

    # the sites of each cell: itself, or its few points
    lone = lambda p: F.struct(p["_id"].alias("site"), F.struct(p["_lon"].alias("west"), p["_lat"].alias("south"), p["_lon"].alias("east"), p["_lat"].alias("north")).alias("box"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("whole"))
    itself = F.struct(F.col("_first").alias("site"), "box", "n", "whole")
    if min_points <= 2:
        sites = cells.select("_cell", "box", F.array(itself).alias("sites"))
    else:
        thin = slim.join(cells.where("NOT whole").select("_cell"), "_cell").groupBy("_cell").agg(F.transform(F.collect_list(F.struct("_id", "_lon", "_lat")), lone).alias("sites"))
        sites = cells.join(thin, "_cell", "left").select("_cell", "box", F.coalesce("sites", F.array(itself)).alias("sites"))

    target = F.struct(*[F.col(f"_cell.{b}").alias(b) for b in by], F.col("_to.row").alias("row"), F.col("_to.col").alias("col"))
    asked = sites.select("_cell", F.col("box").alias("_box"), F.col("sites").alias("_a"), F.explode(grid.around(F.col("_cell.row"), F.col("box"))).alias("_to"))
    asked = asked.withColumn("_target", target).where("_target > _cell").drop("_to")
    met = asked.join(sites.select(F.col("_cell").alias("_target"), F.col("box").alias("_other"), F.col("sites").alias("_b")), "_target")
    met = met.where(bounds(F.col("_box"), F.col("_other"))[0] <= km * (1 + SLACK))
    two = met.select(F.explode("_a").alias("_a"), "_b").select("_a", F.explode("_b").alias("_b"))
    same = sites.where(F.size("sites") > 1).select(F.explode("sites").alias("_a"), "sites").select("_a", F.explode("sites").alias("_b")).where("_a.site < _b.site")
    two = two.unionByName(same)
    swap = F.col("_a.whole") & ~F.col("_b.whole")
    two = two.select(F.when(swap, F.col("_b")).otherwise(F.col("_a")).alias("_a"), F.when(swap, F.col("_a")).otherwise(F.col("_b")).alias("_b"))
    node = lambda s: F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col(f"{s}.box").alias("box"), F.col(f"{s}.n").alias("n"))
    pairs = two.select(F.col("_a.site").alias("l"), F.col("_b.site").alias("r"), (F.col("_a.whole") & F.col("_b.whole")).alias("both"), node("_a").alias("a"), node("_b").alias("b"))

    # where points lie within their site, for cutting it
    share = lambda v, low, high: F.when(F.col(f"box.{high}") > F.col(f"box.{low}"), (F.col(v) - F.col(f"box.{low}")) / (F.col(f"box.{high}") - F.col(f"box.{low}")) * (1 - 1e-12)).otherwise(0.0)
    cellwise = slim.join(cells.select("_cell", "box", "whole", "_first"), "_cell")
    part = lambda v: F.when(F.col("whole"), v).otherwise(0.0)
    inside = cellwise.select(F.when(F.col("whole"), F.col("_first")).otherwise(F.col("_id")).alias("site"), "_lon", "_lat", part(share("_lon", "west", "east")).alias("_u"), part(share("_lat", "south", "north")).alias("_v"))
    links = stored(_links(pairs, inside, km), "links")

    each = sites.select(F.explode("sites").alias("s")).select(F.col("s.site").alias("site"), F.col("s.whole").alias("whole"))
    degree = links.select(F.col("l").alias("site"), "n").unionByName(links.select(F.col("r").alias("site"), F.lit(1).cast("long").alias("n"))).groupBy("site").agg(F.sum("n").alias("n"))
    core = each.join(degree, "site", "left").where(F.col("whole") | (F.coalesce("n", F.lit(0)) + 1 >= min_points)).select("site")
    if min_points > 2:
        core = stored(core, "core")
    ways = links.select(F.col("l").alias("a"), F.col("r").alias("b")).unionByName(links.select(F.col("r").alias("a"), F.col("l").alias("b")))
    among = ways  # of two points, both are core where two make a cluster
    if min_points > 2:
        among = ways.join(core.select(F.col("site").alias("a")), "a", "left_semi").join(core.select(F.col("site").alias("b")), "b", "left_semi").select("a", "b")
        among = stored(among, "edges")
    labels = components(core.select(F.col("site").alias("node")), among)
    if min_points > 2:
        edge = ways.join(core.select(F.col("site").alias("a")), "a", "left_anti").join(labels.select(F.col("node").alias("b"), "label"), "b")
        labels = labels.unionByName(edge.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")))
    named = placed.join(cells.select("_cell", F.col("whole").alias("_whole"), "_first"), "_cell", "left")
    named = named.withColumn("_site", F.when(F.col("_whole"), F.col("_first")).when(F.col("_cell").isNotNull(), F.struct(*by, F.col(key).alias("key"))))
    named = named.join(labels.select(F.col("node").alias("_site"), F.col("label.key").alias("cluster")), "_site", "left")
    return named.select(*points.columns, "cluster")
