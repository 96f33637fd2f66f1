"""Connected components by alternating large and small stars over an edge table.

Every round hangs each node's neighbours on the smallest node it knows, first
the larger ones, then the smaller ones; a few rounds leave each node hanging on
its component's smallest, which is when the edges are stars.  Minima are pre-aggregated; those of hubs, the nodes of
more than a share of all edges, are so few that they are broadcast, so a hub's
edges stay where they are and fill no task.  Each half of a round and its minima are tables in the shared
folder, as one plan of a whole round would hold every half several times over (648 operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.shared import settled

#: A node of more than one in so many edges is a hub; there are at most twice as many hubs.
HUB_SHARE = 2048


def _mark(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars: each ``u`` has one ``v``, which is no ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    count, bad = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return count, not bad


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """Edges with their ``u``'s ``m``; least: ``u``, ``m`` and ``n``, its number of edges among ``count``."""
    hub = F.col("n") > max(1, count // HUB_SHARE)
    hubs, others = F.broadcast(least.where(hub).drop("n")), least.where(~hub).drop("n")
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(others, "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of some edge; nulls and loops count as no edge."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    pairs = settled(pairs, "edges")
    count, done = _mark(pairs)
    while not done:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        larger = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node's larger neighbours, as u > v in all pairs
        large = settled(_with_least(larger, settled(least, "least"), 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = settled(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = _with_least(large, least, 2 * count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        count, done = _mark(pairs)
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
