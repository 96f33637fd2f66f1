"""Nearest places and paths: lists of candidates, from a list of all where there are few, else from an index.

The index is a pyramid of grids over boxes.  From the coarsest grid down, cells of points meet
cells of items: an item cell lies between two distances from all points of a cell, the upper ones
bound the distance of the k nearest, and item cells beyond that bound are dropped.  A
cell of points whose remaining items are few keeps them as its list; others meet again a level below, four
by four times finer.  So no row holds more than some items, except where that many are as near.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import spatial
from convoy.operators import density
from convoy.operators.sizes import small
from convoy.operators.stored import stored

#: Items up to which there is no index, items that a list of the index may have, and those up to which a group of few is one list.
FEW, LIST, PLAIN = 256, 48, 8
#: Level of the cells whose lists leave out of few items those that are too far; cells are some 1.4 by 0.7 degrees.
CELLS = 4
#: Levels of the pyramid; cells of the lowest are some metres wide.
DEPTH = 12
#: Lists up to which they are broadcast.
BROADCAST_LISTS = 20_000

Bounds = Callable[[Column, Column], tuple[Column, Column]]


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def path_box(path: Column) -> Column:
    lons, lats = F.transform(path, lambda p: p["lon"]), F.transform(path, lambda p: p["lat"])
    return box(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def flat_bounds(points: Column, item: Column) -> tuple[Column, Column]:
    """Distances in metres, as ``spatial.metres_from_path`` has them, that no path in the item's box is below, or above."""
    up = spatial.KM_PER_DEGREE * 1000
    widest = F.when((points["south"] < 0) & (points["north"] > 0), F.lit(0.0)).otherwise(F.least(F.abs(points["south"]), F.abs(points["north"])))
    narrow, wide = F.cos(F.radians(F.greatest(F.abs(points["south"]), F.abs(points["north"])))), F.cos(F.radians(widest))
    gap = lambda low, high: F.greatest(F.lit(0.0), points[low] - item[high], item[low] - points[high])
    span = lambda low, high: F.greatest(points[high], item[high]) - F.least(points[low], item[low])
    length = lambda x, y: F.sqrt(x * x + y * y) * up
    # rounding to whole metres moves a distance by half a metre
    return length(gap("west", "east") * narrow, gap("south", "north")) - 1, length(span("west", "east") * wide, span("south", "north")) + 1


def _cells(box_: Column) -> dict[str, Column]:
    """Column and row of a box's middle in the lowest grid."""
    at = lambda low, high, least, span: F.least(F.greatest(F.floor(((box_[low] + box_[high]) / 2 - least) / span * 4**DEPTH), F.lit(0)), F.lit(4**DEPTH - 1))
    return {"_x": at("west", "east", -180, 360), "_y": at("south", "north", -90, 180)}


def _level(df: DataFrame, level: int, name: str, count: bool) -> DataFrame:
    """Cells of a level with the box of what they hold: ``_g``, name_x, name_y, name_box, and ``n`` where asked."""
    shift = 2 * (DEPTH - level)
    ends = F.struct(F.min("_box.west").alias("west"), F.min("_box.south").alias("south"), F.max("_box.east").alias("east"), F.max("_box.north").alias("north"))
    keys = [F.shiftright("_x", shift).alias(f"{name}_x"), F.shiftright("_y", shift).alias(f"{name}_y")]
    return df.groupBy("_g", *keys).agg(ends.alias(f"{name}_box"), *([F.count("*").alias("n")] if count else []))


def _lists(points: DataFrame, items: DataFrame, item: Column, top: int, bounds: Bounds) -> tuple[DataFrame, list[int]]:
    """Per level and cell of points the items that may be among the nearest; the levels that have such lists.

    points: ``_g``, ``_x``, ``_y``, ``_box``; items: the same and what ``item`` takes."""
    out, levels = None, []
    met = _level(points, 0, "q", False).join(_level(items, 0, "i", True), "_g")
    for level in range(DEPTH + 1):
        low, high = bounds(F.col("q_box"), F.col("i_box"))
        own = Window.partitionBy("_g", "q_x", "q_y")
        judged = met.withColumns({"low": low * (1 - density.SLACK), "high": high * (1 + density.SLACK)})
        judged = judged.withColumn("upto", F.sum("n").over(own.orderBy("high").rowsBetween(Window.unboundedPreceding, 0)))
        judged = judged.withColumn("bound", F.min(F.when(F.col("upto") >= top, F.col("high"))).over(own)).where("bound IS NULL OR low <= bound")
        kept = stored(judged.withColumn("total", F.sum("n").over(own)).select("_g", "q_x", "q_y", "i_x", "i_y", "total"), "near-cells")
        short = F.col("total") <= LIST if level < DEPTH else F.lit(True)
        done, rest = kept.where(short), kept.where(~short)
        if not done.isEmpty():
            shift = 2 * (DEPTH - level)
            here = items.select("_g", F.shiftright("_x", shift).alias("i_x"), F.shiftright("_y", shift).alias("i_y"), item.alias("_item"))
            part = done.join(here, ["_g", "i_x", "i_y"]).groupBy("_g", "q_x", "q_y").agg(F.collect_list("_item").alias("_near")).withColumn("_level", F.lit(level))
            out, levels = part if out is None else out.unionByName(part), [*levels, level]
        if rest.isEmpty():
            break
        up = lambda name: [F.shiftright(f"{name}_x", 2).alias(f"_{name}x"), F.shiftright(f"{name}_y", 2).alias(f"_{name}y")]
        q, i = _level(points, level + 1, "q", False), _level(items, level + 1, "i", True)
        q, i = q.select("*", *up("q")), i.select("*", *up("i"))
        old = rest.select("_g", F.col("q_x").alias("_qx"), F.col("q_y").alias("_qy"), F.col("i_x").alias("_ix"), F.col("i_y").alias("_iy"))
        met = old.join(q, ["_g", "_qx", "_qy"]).join(i, ["_g", "_ix", "_iy"]).drop("_qx", "_qy", "_ix", "_iy")
    return out, levels


def _few(rows: DataFrame, points: DataFrame, lon: Column, lat: Column, known: DataFrame, item: Column, top: int, bounds: Bounds) -> DataFrame:
    """``candidates`` of at most FEW items: a group's list where that is short, else one for each cell that has points.

    rows, points: the same points, to be joined and to be counted, with their group ``_g``.  Points without a valid place share a
    cell without a box, which keeps all."""
    groups = known.groupBy("_g").agg(F.collect_list(item).alias("_near"))
    long = [r["_g"] for r in groups.where(F.size("_near") > PLAIN).select("_g").collect()]
    if not long:
        return rows.join(F.broadcast(groups), "_g").drop("_g")
    shift = 2 * (DEPTH - CELLS)

    def placed(df: DataFrame) -> DataFrame:
        """With the box of the point, and the cell where the group's list is long."""
        at = df.withColumn("_box", F.when(F.col("_g").isin(long) & spatial.valid_point(lon, lat), box(lon, lat, lon, lat)))
        return at.withColumns({f"_q{n}": F.when(F.col("_box").isNotNull(), F.shiftright(c, shift)).otherwise(F.lit(-1)).cast("long") for n, c in zip("xy", _cells(F.col("_box")).values(), strict=True)})

    ends = F.struct(F.min("_box.west").alias("west"), F.min("_box.south").alias("south"), F.max("_box.east").alias("east"), F.max("_box.north").alias("north"))
    spots = placed(points.where(F.col("_g").isin(long))).groupBy("_g", "_qx", "_qy").agg(ends.alias("_ends"), F.max(F.col("_box").isNotNull()).alias("_valid"))
    low, high = bounds(F.col("_ends"), F.col("_item_box"))
    own = Window.partitionBy("_g", "_qx", "_qy")
    met = spots.join(F.broadcast(known.select("_g", item.alias("_item"), F.col("_box").alias("_item_box"))), "_g")
    judged = met.withColumns({"low": F.when(F.col("_valid"), low * (1 - density.SLACK)), "high": F.when(F.col("_valid"), high * (1 + density.SLACK))})
    judged = judged.withColumn("_upto", F.row_number().over(own.orderBy("high"))).withColumn("bound", F.min(F.when(F.col("_upto") >= top, F.col("high"))).over(own))
    cut = judged.where("bound IS NULL OR low <= bound").groupBy("_g", "_qx", "_qy").agg(F.collect_list("_item").alias("_near"))
    whole = groups.where(~F.col("_g").isin(long)).select("_g", F.lit(-1).cast("long").alias("_qx"), F.lit(-1).cast("long").alias("_qy"), "_near")
    lists = small(stored(cut.unionByName(whole), "few-near"), BROADCAST_LISTS)
    return placed(rows).join(lists, ["_g", "_qx", "_qy"]).drop("_g", "_qx", "_qy", "_box")


def candidates(points: DataFrame, lon: Column, lat: Column, group: Column, items: DataFrame, item_box: Column, item_group: Column, top: int = 1, bounds: Bounds = density.bounds) -> DataFrame:
    """Points with ``_near``: items of their group, as structs, the ``top`` nearest among them; points without any are dropped.

    bounds: what distances two boxes allow.  A null group has no items."""
    item = F.struct(*items.columns)
    known = items.withColumns({"_g": item_group, "_box": item_box}).where("_g IS NOT NULL AND _box.west IS NOT NULL")
    # what each point folds costs far more than its row: points of a few files go to all cores
    spark = points.sparkSession
    rows = points.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)).withColumn("_g", group)
    if known.limit(FEW + 1).count() <= FEW:
        return _few(rows, points.withColumn("_g", group), lon, lat, known, item, top, bounds)
    rows = rows.withColumn("_box", F.when(spatial.valid_point(lon, lat), box(lon, lat, lon, lat))).where("_box IS NOT NULL AND _g IS NOT NULL")
    rows, known = rows.withColumns(_cells(F.col("_box"))), stored(known.withColumns(_cells(F.col("_box"))), "items")
    spots = F.struct(F.min("_box.west").alias("west"), F.min("_box.south").alias("south"), F.max("_box.east").alias("east"), F.max("_box.north").alias("north"))
    spots = stored(rows.groupBy("_g", "_x", "_y").agg(spots.alias("_box")), "spots")
    lists, levels = _lists(spots, known, item, top, bounds)
    if lists is None:
        return rows.drop("_g", "_box", "_x", "_y").withColumn("_near", F.array(F.lit(None).cast(known.select(item.alias("i")).schema["i"].dataType))).where("false")
    lists = small(stored(lists, "near-lists"), BROADCAST_LISTS)
    at = lambda v: F.expr(f"shiftright({v}, cast(2 * ({DEPTH} - _level) as int))")
    rows = rows.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"q_x": at("_x"), "q_y": at("_y")})
    return rows.join(lists, ["_level", "_g", "q_x", "q_y"]).drop("_level", "_g", "q_x", "q_y", "_box", "_x", "_y")
