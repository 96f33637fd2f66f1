"""Scalar rules: rounding, severities, clocks, hashing to shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoy import schema


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward positive infinity; a double.  NaN and infinite values stay what they are."""
    number = x.cast("double")
    rounded = F.floor(number + 0.5).cast("double") if digits == 0 else F.floor(number * float(10**digits) + 0.5) / float(10**digits)
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), number).otherwise(rounded)


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def severity(kind: Column, value: Column) -> Column:
    """ok, warning or critical; NaN and null values are ok, as nothing compares with them."""
    good = finite(value)
    out = F.when(~good, "ok").when(kind == "hos-remaining", F.when(value <= schema.HOS_CRITICAL, "critical").when(value <= schema.HOS_WARNING, "warning").otherwise("ok"))
    for name, (warning, critical) in schema.THRESHOLDS.items():
        out = out.when(kind == name, F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok"))
    return out.otherwise("ok")


def rank(level: Column) -> Column:
    """0 (ok, unknown or null) to 3 (critical)."""
    return F.coalesce(F.greatest(F.array_position(F.array(*map(F.lit, schema.SEVERITIES)), level) - 1, F.lit(0)), F.lit(0)).cast("int")


def level(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, schema.SEVERITIES)), number + 1)


def hos_level(minutes: Column) -> Column:
    return F.when(minutes <= schema.HOS_CRITICAL, "critical").when(minutes <= schema.HOS_WARNING, "warning")


def format_hours(minutes: Column) -> Column:
    whole = F.floor(minutes / 60).cast("int")
    return F.concat(whole.cast("string"), F.lit("h"), F.lpad((minutes - whole * 60).cast("int").cast("string"), 2, "0"))


def urgency(rank_number: Column, hos_minutes: Column) -> Column:
    return half_up(rank_number * 25 + F.greatest(F.lit(0), 120 - hos_minutes) / 2).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """The first 32 bits of the key's SHA-256, modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def kind_order(kind: Column) -> Column:
    """Place in the list of dominant kinds; unknown kinds come last."""
    at = F.array_position(F.array(*map(F.lit, schema.KIND_PRIORITY)), kind)
    return F.when(at > 0, at).otherwise(len(schema.KIND_PRIORITY) + 1).cast("int")


def title_of(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in schema.TITLES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
