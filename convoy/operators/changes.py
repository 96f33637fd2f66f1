"""A table's change log: what each version inserts, updates and deletes, with the rows before and after.

A change has a version, a shard (a hash of its key) and a number within both, without
gaps, so readers of a shard go on from where they stopped.  A deleted row leaves a
tombstone: a change without an image after it.  Versions are folders, so that a reader of
the newest ones opens nothing else, and a version that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import rules

#: Shards of a log: what numbers changes goes over one shard's changes in one task.
SHARDS = 64


def _same(columns: list[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def _key_text(keys: list[str]) -> Column:
    """The key as one text; keys that differ, null ones too, have different texts."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(str(n)) for n, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def changes(before: DataFrame, after: DataFrame, keys: list[str], version: int, shards: int = SHARDS) -> DataFrame:
    """The changes that lead from one snapshot to the next: keys, ``version``, ``shard``, ``number``, ``op`` (insert, update or
    delete) and the images ``before`` and ``after``, structs of all columns.

    Keys, null ones included, are unique in either; both have the same columns.  One join by key; rows that stay as they were are left out."""
    columns = after.columns
    sides = [df.select(F.struct(*columns).alias(name)) for df, name in ((before, "before"), (after, "after"))]
    rows = sides[0].join(sides[1], _same(keys, "before", "after"), "full_outer")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~_same(columns, "before", "after"), "update")
    rows = rows.withColumn("op", op).where("op IS NOT NULL")
    key = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
    rows = rows.select(*[key[k].alias(k) for k in keys], F.lit(version).cast("long").alias("version"), "op", "before", "after")
    rows = rows.withColumn("shard", rules.shard_of(_key_text(keys), shards))
    number = F.row_number().over(Window.partitionBy("shard").orderBy(*keys))
    return rows.select(*keys, "version", "shard", number.cast("long").alias("number"), "op", "before", "after")


def append(log: DataFrame, folder: str) -> None:
    """Writes the changes, each version to its own folder, in place of what an earlier try of it left."""
    rows = log.repartition("version", "shard").sortWithinPartitions("version", "shard", "number")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)


def read(spark: SparkSession, folder: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """Changes after a version and up to another; only their folders are opened."""
    log = spark.read.parquet(folder)
    log = log if after is None else log.where(F.col("version") > after)
    return log if upto is None else log.where(F.col("version") <= upto)


def newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key, by one partial aggregate."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def replay(base: DataFrame, log: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The table as of a version: the base with every key's last change up to then."""
    last = newest(log.where(F.col("version") <= version), keys)
    marks = last.select(F.struct(*keys).alias("_key"))
    kept = base.withColumn("_k", F.struct(*keys)).join(marks, _same(keys, "_k", "_key"), "left_anti").drop("_k")
    return kept.unionByName(last.where("after IS NOT NULL").select("after.*"))


def compacted(log: DataFrame, keys: list[str]) -> DataFrame:
    """One change for each key that leads to the same table as all of its changes: the first image before, the last after.

    Keys that are in the end as they were at first leave nothing."""
    rest = ("version", "shard", "number", "after")
    ends = log.groupBy(*keys).agg(F.min_by("before", "version").alias("before"), F.max_by(F.struct(*rest), "version").alias("_last"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("_last.after").isNull(), "delete").otherwise("update")
    rows = ends.where(~F.col("before").eqNullSafe(F.col("_last.after")))
    return rows.select(*keys, "_last.version", "_last.shard", "_last.number", op.alias("op"), "before", "_last.after")
