"""The largest distance between two members of a group, for groups of any size."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions import spatial
from convoy.operators.sizes import small
from convoy.operators.stored import stored

#: Groups of up to so many points are compared in one row. Larger ones go through cells: so many to the longest edge of a
#: group's box, finer by FINER each round, for at most ROUNDS rounds.
WHOLE, CELLS, FINER, ROUNDS = 2048, 16, 8, 5
#: Cells that are broadcast at once.
FEW = 200_000
#: Chords of the unit sphere that differ by less count as equal (some 6 micrometres on the ground).
SAME = 1e-12

_AXES = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]


def farthest(lons: list, lats: list) -> float:
    """The largest distance between two of some places, in km.

    Two sweeps give a distance that some pair has; a pair that is farther apart has both ends so far from the middle that
    most places drop out, and only the rest are compared.
    """
    lon, lat = np.unique(np.radians(np.array([lons, lats], float)), axis=1)
    far = lambda i, j: 2 * spatial.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, np.sin((lat[j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[j] - lon[i]) / 2) ** 2)))
    every = np.arange(len(lon))
    end = int(np.argmax(far(0, every)))
    other = int(np.argmax(far(end, every)))
    best = float(far(end, other))
    middle = int(np.argmin(np.maximum(far(end, every), far(other, every))))
    reach = far(middle, every)
    rim = every[reach >= best - reach.max() - 1e-9]
    return max([best, *[float(far(i, rim).max()) for i in rim]])


def _judge(keys: list[str]):
    """Of one group's cells, those that may hold an end of a pair farther apart than the best known, and that best (its cell is empty)."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        low, high, spot = (cells[[f"{a}_{k}" for k in "xyz"]].to_numpy() for a in ("low", "high", "spot"))
        best = max(float(cells["best"].max()), max(float(np.sqrt(((spot - p) ** 2).sum(1)).max()) for p in spot))
        reach = np.array([np.sqrt((np.maximum(high - lo, hi - low) ** 2).sum(1)).max() for lo, hi in zip(low, high, strict=True)])
        out = cells.loc[[*cells.index[reach > best + SAME], cells.index[0]], [*keys, "cell"]].reset_index(drop=True)
        out.loc[len(out) - 1, "cell"] = ""
        return out.assign(best=best)

    return run


def largest(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per group, the largest great-circle distance ``km`` between two of its points (``lon``, ``lat``, not null).

    Extremes along thirteen axes give a first distance. Points then meet as boxes of cells, a bounded number per group and
    aggregated before they are shuffled: a pair of boxes whose farthest corners are no farther apart than the best known
    drops out, and only points in boxes that are left go on to finer cells. What is left when a group is small is compared.
    Points of one distance from each other, as on a ring, can't be told apart by bounds and stay until the last round.
    """
    lon, lat = F.radians("lon"), F.radians("lat")
    rows = points.select(*keys, "lon", "lat", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")).distinct()
    left = rows = stored(rows, "spread-points")
    along = [a * F.col("x") + b * F.col("y") + c * F.col("z") for a, b, c in _AXES]
    ends = rows.groupBy(*keys).agg(
        *[F.min(k).alias(f"_{k}") for k in "xyz"], *[F.max(k).alias(f"_{k}1") for k in "xyz"],
        *[F.max_by(F.struct("x", "y", "z"), a).alias(f"_far{i}") for i, a in enumerate(along)], *[F.min_by(F.struct("x", "y", "z"), a).alias(f"_near{i}") for i, a in enumerate(along)],
    )
    chord = lambda p, q: F.sqrt(reduce(lambda s, k: s + (p[k] - q[k]) * (p[k] - q[k]), "xyz", F.lit(0.0)))
    first = F.greatest(*[chord(F.col(f"_far{i}"), F.col(f"_near{i}")) for i in range(len(_AXES))])
    edge = F.greatest(*[F.col(f"_{k}1") - F.col(f"_{k}") for k in "xyz"], F.lit(SAME))
    groups = stored(ends.select(*keys, "_x", "_y", "_z", edge.alias("_edge"), first.alias("best")), "spread-groups")
    for k in range(ROUNDS):
        side = F.col("_edge") / (CELLS * FINER**k)
        cell = F.concat_ws(",", *[F.floor((F.col(c) - F.col(f"_{c}")) / side).cast("string") for c in "xyz"])
        placed = left.join(small(groups, FEW), keys).withColumn("cell", cell)
        spot = F.min(F.struct("x", "y", "z"))
        boxes = placed.groupBy(*keys, "cell").agg(
            F.max("best").alias("best"), *[F.min(c).alias(f"low_{c}") for c in "xyz"], *[F.max(c).alias(f"high_{c}") for c in "xyz"], spot.alias("spot")
        ).select("*", *[F.col("spot")[c].alias(f"spot_{c}") for c in "xyz"]).drop("spot")
        schema = boxes.select(*keys, "cell", "best").schema
        judged = stored(boxes.groupBy(*keys).applyInPandas(_judge(keys), schema), "spread-cells")
        known = judged.where("cell = ''").select(*keys, F.col("best").alias("_better"))
        groups = stored(groups.join(known, keys, "left").withColumn("best", F.greatest("best", F.coalesce("_better", "best"))).drop("_better"), "spread-groups")
        left = stored(placed.join(small(judged.where("cell <> ''").select(*keys, "cell"), FEW), [*keys, "cell"], "left_semi").select(*keys, "lon", "lat", "x", "y", "z"), "spread-points")
        if left.groupBy(*keys).count().where(F.col("count") > WHOLE).isEmpty():
            break
    rest = compared(left, keys).withColumnRenamed("km", "_km")
    known = 2 * spatial.EARTH_KM * F.asin(F.least(F.col("best") / 2, F.lit(1.0)))
    return groups.join(rest, keys, "left").select(*keys, F.greatest(known, F.coalesce("_km", F.lit(0.0))).alias("km"))


def compared(points: DataFrame, keys: list[str]) -> DataFrame:
    """As ``largest``, with each group's points in one row: for groups of a known size."""
    gathered = points.groupBy(*keys).agg(F.collect_list("lon").alias("lons"), F.collect_list("lat").alias("lats"))

    @F.pandas_udf("double")
    def km(lons: pd.Series, lats: pd.Series) -> pd.Series:
        return pd.Series([farthest(x, y) for x, y in zip(lons, lats, strict=True)], dtype=float)

    return gathered.select(*keys, F.when(F.size("lons") < 2, F.lit(0.0)).otherwise(km("lons", "lats")).alias("km"))
