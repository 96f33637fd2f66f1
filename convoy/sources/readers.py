"""Readers of landed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy import schema


def bronze(spark: SparkSession, path: str) -> DataFrame:
    """Raw vendor records as archived, with their partition columns pruned by filters on tenant, provider, dt and hh."""
    return spark.read.schema("fetched_at timestamp, payload string, tenant_id string, provider string, dt string, hh string").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """Whole markdown files: ``tenant_id``, ``source`` (the file's name), ``text``."""
    rows = spark.read.text(path, wholetext=True).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.select(F.lit(tenant).alias("tenant_id"), "source", F.col("value").alias("text"))


def stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Landed readings as a stream of files in the canonical columns."""
    return spark.readStream.schema(schema.TELEMETRY).option("maxFilesPerTrigger", files).parquet(path)
