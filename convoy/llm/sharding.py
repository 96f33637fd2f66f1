"""Sharding by a hierarchical weighted hash tree.

Every row descends from the root over region and rack to its shard.  At each
node the children draw exponential clocks from the row's key, ``-ln(u) / weight``,
and the earliest wins; so a child gets its weight's share, and a changed weight
moves rows only into or out of the child it belongs to.  ``Tree.grown`` puts a new
shard in a region of its own, so rows move only into it, however often that is done.

All draws are built-in expressions over 64-bit hashes.  Slots are numbered within
hash buckets of a shard and offset by the buckets before, so that no task holds
a whole shard.

Nulls: a null key draws as a value of its own (all its rows share a shard); a
null text counts as empty.  Repeated rows get the same shard and different
slots.  Further columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash buckets of a shard within which slots are numbered.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Tree:
    """Levels of the tree: for each parent, in order, its children's (node id, weight).

    The last level's node ids are the shard numbers.
    """

    levels: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def regular(shards: int, per_rack: int = 4, racks_per_region: int = 3) -> Tree:
        """Shards 0.. in racks and regions of fixed width; the last ones may be part-filled."""
        return Tree.weighted([1.0] * shards, per_rack, racks_per_region)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one shard more, in a rack and a region of its own: no weight of before changes."""
        (regions,), racks, shards = self.levels
        region, rack, shard = len(racks), len(shards), sum(map(len, shards))
        return Tree(((regions + ((region, weight),),), (*racks, ((rack, weight),)), (*shards, ((shard, weight),))))

    @staticmethod
    def weighted(weights: list[float], per_rack: int = 4, racks_per_region: int = 3) -> Tree:
        racks = [list(range(i, min(i + per_rack, len(weights)))) for i in range(0, len(weights), per_rack)]
        regions = [list(range(i, min(i + racks_per_region, len(racks)))) for i in range(0, len(racks), racks_per_region)]
        rack_weight = [sum(weights[s] for s in r) for r in racks]
        region_weight = [sum(rack_weight[r] for r in g) for g in regions]
        return Tree((
            (tuple(enumerate(region_weight)),),
            tuple(tuple((r, rack_weight[r]) for r in g) for g in regions),
            tuple(tuple((s, weights[s]) for s in r) for r in racks),
        ))


def _draw(key: Column, children: Column, level: int, seed: int) -> Column:
    """The child whose clock rings first."""

    def clock(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["id"], F.lit(level), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["weight"]).alias("ring"), child["id"].alias("id"))

    return F.array_min(F.transform(F.filter(children, lambda c: c["weight"] > 0), clock))["id"]


def assign(key: Column, tree: Tree, seed: int = 17) -> Column:
    """Shard number of a key."""
    node: Column = F.lit(0)
    for level, parents in enumerate(tree.levels):
        table = F.array(*[F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in kids]) for kids in parents])
        node = _draw(key, F.get(table, node), level, seed)
    return node


def shard(df: DataFrame, key: str, tree: Tree, grown: Tree | None = None, keep: tuple[str, ...] = (), seed: int = 17) -> DataFrame:
    """Key, kept columns, shard, slot (gapless from 0) and, with ``grown``, the shard under that tree."""
    columns = [F.col(key), *[F.col(c) for c in keep if c != key], assign(F.col(key), tree, seed).cast("int").alias("shard")]
    if grown is not None:
        columns.append(assign(F.col(key), grown, seed).cast("int").alias("grown_shard"))
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("slot"), F.lit(seed)), F.lit(SLOT_BUCKETS)).cast("int")
    placed = df.select(*columns, bucket.alias("_bucket"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.select(assign(F.col(key), tree, seed).cast("int").alias("shard"), bucket.alias("_bucket"))
        .groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
        .select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy(*[F.col(c) for c in dict.fromkeys((key, *keep))])
    return (
        placed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_bucket"])
        .withColumn("slot", F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_offset", "_place")
    )


def place_documents(docs: DataFrame) -> DataFrame:
    """Documents in shards 0 to 23 by the law ``key``, and where they go with one shard more."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard(sized, "doc_id", Tree.regular(24), Tree.regular(24).grown(), keep=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_hash_tree(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, and where they go with one shard more."""
    from convoy.llm.shared import table

    return place_documents(table(spark, sf_dir, "documents"))
