"""Sinks: raw archive, history, latest rows, dead letters, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions.rules import finite
from convoy.functions.text import date_hour


def archive_raw(raw: DataFrame, path: str) -> None:
    """Raw records as JSON, before anything else reads them, by tenant, provider and hour of fetching."""
    raw.withColumns(date_hour(F.col("fetched_at"))).write.mode("append").partitionBy("tenant_id", "provider", "dt", "hh").json(path)


def append_history(readings: DataFrame, path: str) -> None:
    """Readings as Parquet by tenant and hour of each row's own observation."""
    rows = readings.withColumns(date_hour(F.col("observed_at")))
    # rows of an hour go to few files; Spark splits an hour that is far larger than others
    rows.hint("rebalance", "tenant_id", "dt", "hh").write.mode("append").partitionBy("tenant_id", "dt", "hh").parquet(path)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the order given, as an upsert leaves it."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])))
    return rows.where("_n = 1").drop("_n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows with those of the same key replaced by the changes."""
    return current.join(changes, keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def good_reading() -> Column:
    return F.col("driver_id").isNotNull() & finite(F.col("value"))


def quarantine(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings that can be judged, and the others with the reason."""
    reason = F.when(F.col("driver_id").isNull(), "no driver").otherwise("value is not a finite number")
    return readings.where(good_reading()), readings.where(~good_reading()).withColumn("reason", reason)


def retained(df: DataFrame, at: str, as_of: Column, hours: int = 48) -> DataFrame:
    return df.where(F.col(at) >= as_of - F.make_interval(hours=F.lit(hours)))


#: Bytes of a row group of a clustered table, before compression: what a point read opens.
GROUP_BYTES = 4 << 20


def clustered(df: DataFrame, keys: list[str], path: str, bloom: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES) -> None:
    """Writes a table in the order of its keys, in small row groups, so that a read by key opens the few whose range holds it.

    Rows of a range of keys go to a file and are sorted there; where the first key may have very many rows, further keys part them.
    bloom: other columns that are asked for by value (a secondary index), which get a Bloom filter in each row group.
    """
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", group_bytes)
    writer = writer.option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
