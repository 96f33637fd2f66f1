"""Broadcasts of counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int) -> DataFrame:
    """The rows, marked for a broadcast if there are at most so many."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
