"""Event routing by pattern, and subscriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.sizes import small

#: Subscriptions without a first field up to which they are broadcast.
BROADCAST_SUBSCRIPTIONS = 100_000


def matches(pattern: dict, envelope: dict[str, Column] | None = None, detail: Column | None = None) -> Column:
    """A pattern as a column: all named fields have to fit, each by one of its listed values; nested dicts go into ``detail``.

    ``detail`` is a map, a struct or a JSON string's parsed form; an absent field does not fit.
    """
    row = envelope or {"source": F.col("source"), "detail-type": F.col("detail_type")}
    tests = [F.coalesce(row[name].isin(*values), F.lit(False)) for name, values in pattern.items() if name != "detail"]
    if "detail" in pattern:
        tests.append(_fits(pattern["detail"], detail if detail is not None else F.col("detail")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _fits(pattern: dict, value: Column) -> Column:
    tests = [_fits(want, value[name]) if isinstance(want, dict) else F.coalesce(value[name].isin(*want), F.lit(False)) for name, want in pattern.items()]
    return F.coalesce(value.isNotNull(), F.lit(False)) & reduce(lambda a, b: a & b, tests, F.lit(True))


def route(events: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Events with ``matched_rules``, all compiled into one projection."""
    hits = F.array(*[F.when(matches(p), F.lit(name)) for name, p in rules.items()])
    return events.withColumn("matched_rules", F.array_compact(hits))


def deliveries(events: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """A row per event and rule that takes it; events no rule takes are dead letters with a null rule."""
    return route(events, rules).withColumn("rule", F.explode_outer("matched_rules")).drop("matched_rules")


def wants(wanted: Column, value: Column, is_list: bool = False) -> Column:
    """Whether a subscription's argument takes a payload's field: null takes all, a list has to contain it."""
    fits = F.array_contains(value, wanted) if is_list else value == wanted
    return wanted.isNull() | F.coalesce(fits, F.lit(False))


def fan_out(payloads: DataFrame, subscriptions: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """Payloads with the subscriptions that take them.

    fields: names of the filter columns (``want_<name>`` in subscriptions), true for list fields.  Subscriptions with the first
    field given meet payloads by an equi-join on it; the others, which take all its values, each meet every payload, as they have to.
    """
    first, is_list = next(iter(fields.items()))
    named, open_ = subscriptions.where(F.col(f"want_{first}").isNotNull()), subscriptions.where(F.col(f"want_{first}").isNull())
    keyed = payloads.withColumn("_key", F.explode(F.array_distinct(first)) if is_list else F.col(first))
    met = keyed.join(named, F.col("_key") == F.col(f"want_{first}")).drop("_key")
    loose = payloads.crossJoin(small(open_, BROADCAST_SUBSCRIPTIONS))
    both = met.unionByName(loose)
    return both.where(reduce(lambda a, b: a & b, [wants(F.col(f"want_{n}"), F.col(n), many) for n, many in fields.items()]))
