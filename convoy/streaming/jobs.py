"""Structured Streaming jobs over canonical readings.

The stream's event time is ``observed_at``.  Nothing in the fleet model sets a policy for
late rows, so this one does: a watermark of ``LATE``, beyond which rows are dropped.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from convoy import schema
from convoy.functions import spatial
from convoy.operators import pipeline, sinks

LATE = "10 minutes"
#: Seconds behind a tenant's newest exception for which an exception, or the leader that it follows, is held for later batches.
HELD_SECONDS = schema.MERGE_SECONDS + 600


def deduplicated(readings: DataFrame, late: str = LATE) -> DataFrame:
    """Each reading once, however often the source repeats it within the watermark."""
    return readings.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["tenant_id", "telemetry_id"])


def windowed_counts(readings: DataFrame, window: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Readings and largest values per tenant, kind and tumbling window."""
    rows = readings.withWatermark("observed_at", late).groupBy("tenant_id", "kind", F.window("observed_at", window))
    return rows.agg(F.count("*").alias("n"), F.max("value").alias("most")).select("tenant_id", "kind", F.col("window.start").alias("begins"), "n", "most")


def sessions(readings: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Runs of a driver's readings without a longer gap."""
    rows = readings.withWatermark("observed_at", late).groupBy("tenant_id", "driver_id", F.session_window("observed_at", gap))
    return rows.agg(F.count("*").alias("n")).select("tenant_id", "driver_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")


HOT = "tenant_id string, driver_id string, lon double, lat double, hos double, updated_at timestamp"
_STATE = "lon double, lat double, placed long, hos double, clocked long"


def hot_state(readings: DataFrame, idle_ms: int = 48 * 3600 * 1000, late: str = LATE) -> DataFrame:
    """Each driver's latest place and clock by event time, as keyed state that goes when the watermark is so far past the last of them."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lon, lat, placed, hos, clocked = state.get if state.exists else (None, None, -1, None, -1)
        for rows in batches:
            at = rows["observed_at"].astype("datetime64[us]").astype("int64")
            for mine, is_place in ((rows[(rows.kind == "position") & rows.lon.notna()], True), (rows[rows.kind == "hos-remaining"], False)):
                if len(mine):
                    k = at[mine.index].idxmax()
                    if is_place and at[k] >= placed:
                        lon, lat, placed = float(mine.lon[k]), float(mine.lat[k]), int(at[k])
                    elif not is_place and at[k] >= clocked:
                        hos, clocked = float(mine.value[k]), int(at[k])
        state.update((lon, lat, placed, hos, clocked))
        state.setTimeoutTimestamp(max(max(placed, clocked) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"tenant_id": [key[0]], "driver_id": [key[1]], "lon": [lon], "lat": [lat], "hos": [hos], "updated_at": [pd.Timestamp(max(placed, clocked), unit="us")]})

    slim = readings.withWatermark("observed_at", late).select("tenant_id", "driver_id", "kind", "value", "observed_at", F.col("location.lon").alias("lon"), F.col("location.lat").alias("lat"))
    return slim.groupBy("tenant_id", "driver_id").applyInPandasWithState(update, HOT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


OVERLAY = "tenant_id string, driver_id string, probe_id string, observed_at timestamp, lon double, lat double, tick_at timestamp"


def overlay(probes: DataFrame, ticks: DataFrame, idle_ms: int = 48 * 3600 * 1000, late: str = LATE) -> DataFrame:
    """Each probe with its driver's last tick at or before it, by event time: an as-of join of two streams.

    probes: ``tenant_id``, ``driver_id``, ``probe_id``, ``observed_at``; ticks: the same without ``probe_id``, and ``lon``, ``lat``.
    A probe is answered once the watermark, that of the slower stream, has passed it, so ticks that come late, but within the watermark, count;
    without a tick its place is null.  Of ticks at one moment the largest place counts.  State per driver: probes that wait, ticks
    ahead of the watermark and the last one behind it; a driver without ticks for so long is forgotten.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = map(json.loads, state.get) if state.exists else ([], [])
        for rows in () if state.hasTimedOut else batches:
            at = rows["observed_at"].astype("datetime64[us]").astype("int64")
            for t, probe, lon, lat, is_probe in zip(at.tolist(), rows.probe_id, rows.lon, rows.lat, rows.is_probe, strict=True):
                if is_probe:
                    waiting.append([t, probe])
                elif pd.notna(lon) and pd.notna(lat):
                    known.append([t, float(lon), float(lat)])
        known.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        due = sorted(w for w in waiting if w[0] <= mark)
        waiting = [w for w in waiting if w[0] > mark]
        out = []
        for t, probe in due:
            k = bisect.bisect_right(known, t, key=lambda x: x[0]) - 1
            at, lon, lat = known[k] if k >= 0 else (None, None, None)
            out.append((key[0], key[1], probe, pd.Timestamp(t, unit="us"), lon, lat, None if at is None else pd.Timestamp(at, unit="us")))
        known = known[max(0, bisect.bisect_right(known, mark, key=lambda x: x[0]) - 1) :]
        expires = max([k[0] for k in known], default=mark) // 1000 + idle_ms
        if not waiting and (not known or expires <= mark // 1000):
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(known), json.dumps(waiting)))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, min([w[0] // 1000 + 1 for w in waiting] or [expires])))
        if out:
            yield pd.DataFrame(out, columns=["tenant_id", "driver_id", "probe_id", "observed_at", "lon", "lat", "tick_at"]).astype({"lon": float, "lat": float, "tick_at": "datetime64[us]"})

    null = F.lit(None)
    asked = probes.withWatermark("observed_at", late).select("tenant_id", "driver_id", "observed_at", F.col("probe_id").cast("string").alias("probe_id"), null.cast("double").alias("lon"), null.cast("double").alias("lat"), F.lit(True).alias("is_probe"))
    given = ticks.withWatermark("observed_at", late).select("tenant_id", "driver_id", "observed_at", null.cast("string").alias("probe_id"), "lon", "lat", F.lit(False).alias("is_probe"))
    both = asked.unionByName(given)
    return both.groupBy("tenant_id", "driver_id").applyInPandasWithState(update, OVERLAY, "known string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def feed(exceptions: DataFrame, district: str | None = None) -> DataFrame:
    """The live feed of exceptions, of one district where given."""
    return exceptions if district is None else exceptions.where(F.col("district_id") == district)


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """Gives every row without a leader, in order, the first leader that it matches, or makes it one; leaders that are there stay.

    Rows that move match within the merge radius and window, others (all of one driver and kind) within the time that one judgement covers.
    """
    rows = rows.sort_values(["at", "exception_id"], kind="stable").reset_index(drop=True)
    at, ids = rows["at"].to_numpy(), rows["exception_id"].to_numpy()
    rlon, rlat = np.radians(rows["lon"].to_numpy()), np.radians(rows["lat"].to_numpy())
    moving = bool(rows["moving"].iloc[0])
    reach = (schema.MERGE_SECONDS if moving else schema.CORROBORATE_SECONDS) * 1_000_000
    out = rows["leader_id"].to_numpy(object)
    leaders = [k for k in range(len(rows)) if out[k] == ids[k]]
    for k in range(len(rows)):
        if out[k] is not None:
            continue
        near = np.array(leaders[bisect.bisect_left(leaders, at[k] - reach, key=lambda i: at[i]) : bisect.bisect_right(leaders, at[k] + reach, key=lambda i: at[i])], np.int64)
        if moving:
            h = np.sin((rlat[near] - rlat[k]) / 2) ** 2 + np.cos(rlat[k]) * np.cos(rlat[near]) * np.sin((rlon[near] - rlon[k]) / 2) ** 2
            near = near[2 * spatial.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= schema.MERGE_KM]
        out[k] = ids[near[0]] if len(near) else ids[k]
        if not len(near):
            bisect.insort(leaders, k)
    began = dict(zip(ids[leaders], at[leaders], strict=True))
    return pd.DataFrame({"exception_id": ids, "leader_id": out, "lead_at": [began[v] for v in out]})


def correlate(held: DataFrame, new: DataFrame) -> DataFrame:
    """Held and new exceptions with ``leader_id`` and ``lead_at`` (microseconds), null where nothing backs them up yet, and ``joined``: led since now.

    As one judgement per batch spreads a driver's vendors and kinds over several exceptions, a second vendor for the same kind counts
    across them.  An incident that was opened stays: what comes later joins it, or leads one of its own.
    """
    fresh = new.dropDuplicates(["tenant_id", "exception_id"]).join(held.select("tenant_id", "exception_id"), ["tenant_id", "exception_id"], "left_anti")
    rows = held.withColumn("joined", F.lit(False)).unionByName(fresh.withColumns({"leader_id": F.lit(None).cast("string"), "lead_at": F.lit(None).cast("long"), "joined": F.lit(False)}))
    rows = rows.withColumn("_at", F.unix_micros("raised_at"))
    near = (-schema.CORROBORATE_SECONDS * 1_000_000, schema.CORROBORATE_SECONDS * 1_000_000)
    driver, alike = (Window.partitionBy(*k).orderBy("_at").rangeBetween(*near) for k in (pipeline.WITH_ORDER, [*pipeline.WITH_ORDER, "kind"]))
    seen = F.size(F.array_distinct(F.flatten(F.collect_list("providers").over(alike))))
    rows = rows.withColumns({"_kinds": F.size(F.collect_set("kind").over(driver)), "_providers": seen})
    backed = F.col("leader_id").isNotNull() | F.col("kind").isin(*schema.NEEDS_NO_SECOND) | (F.col("_providers") >= 2) | (F.col("_kinds") > 1)
    rows = rows.withColumn("_backed", backed).drop("_kinds", "_providers")
    moving = F.col("kind").isin(*schema.LOCATION_CAUSED)
    slim = rows.where("_backed").select(
        "tenant_id", F.when(moving, F.col("district_id")).otherwise(F.col("driver_id")).alias("_where"), F.when(~moving, F.col("kind")).otherwise("").alias("_what"),
        "exception_id", "leader_id", F.col("_at").alias("at"), F.col("location.lon").alias("lon"), F.col("location.lat").alias("lat"), moving.alias("moving"),
    )
    led = slim.groupBy("tenant_id", "_where", "_what").applyInPandas(
        lambda key, pdf: _follow(pdf).assign(tenant_id=key[0]), "tenant_id string, exception_id string, leader_id string, lead_at long"
    )
    out = rows.withColumnRenamed("leader_id", "_before").drop("lead_at", "joined", "_at", "_backed").join(led, ["tenant_id", "exception_id"], "left")
    return out.withColumn("joined", F.col("leader_id").isNotNull() & F.col("_before").isNull()).drop("_before")


def _kept(rows: DataFrame, newest: object) -> DataFrame:
    """What later batches may need; a tenant's clock is its newest exception, of those that are not ahead of the newest fetch."""
    past = F.lit(True) if newest is None else F.col("raised_at") <= F.lit(newest)
    clock = F.max(F.when(past, F.unix_micros("raised_at"))).over(Window.partitionBy("tenant_id"))
    age = clock - F.coalesce("lead_at", F.unix_micros("raised_at"))
    return rows.withColumn("_age", age).where(F.col("_age").isNull() | (F.col("_age") <= HELD_SECONDS * 1_000_000)).drop("_age", "joined")


def _written(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame | None:
    """What an earlier batch wrote; None where a stream from before it did so goes on."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(found: DataFrame) -> DataFrame:
    """Each incident as its latest batch left it; found: the incidents that ``ingest`` writes, with their ``batch``."""
    latest = Window.partitionBy("tenant_id", "incident_id").orderBy(F.desc("batch"))
    return found.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def ingest(raw: DataFrame, drivers: DataFrame, places: list[tuple[str, float, float]], corridors: DataFrame, folder: str, seconds: int = 5) -> DataStreamWriter:
    """Writer of a stream of raw records: per micro-batch, archive, normalise, judge, detect, and write everything.

    A batch that runs again overwrites its own folder, so every table has each row once, except that a batch writes the incidents
    that it opened or that grew, whole: ``current`` gives each as it is.  Drivers go on from where the batch before left them, and detection goes over the batch's
    exceptions and those held from earlier ones; both alternate between two folders, so that a batch that runs again finds what it found
    before.  Records that
    do not parse, readings that cannot be judged and records fetched over an hour before the batch's newest go to folders of their own.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        newest = batch.agg(F.max("fetched_at")).first()[0]
        fresh = batch.where(F.col("fetched_at") >= F.lit(newest) - F.expr("INTERVAL 1 HOUR")) if newest else batch
        known = _written(spark, f"{folder}/drivers/{(number - 1) % 2}", drivers.schema) if number else None
        spot = f"batch={number}"
        batch.withColumns({"dt": F.date_format("fetched_at", "yyyy-MM-dd"), "hh": F.date_format("fetched_at", "HH")}).write.mode("overwrite").partitionBy("tenant_id", "provider", "dt", "hh").json(f"{folder}/raw/{spot}")
        out = pipeline.land(fresh, drivers if known is None else known, places, corridors, pipeline.Landing(folder, spot), drivers_at=f"{folder}/drivers/{number % 2}")
        new = out["exceptions"]
        columns = T.StructType([*new.schema.fields, T.StructField("leader_id", T.StringType()), T.StructField("lead_at", T.LongType())])
        held = _written(spark, f"{folder}/held/{(number - 1) % 2}", columns) if number else None
        held = held if held is not None else spark.createDataFrame([], columns)
        rows = correlate(held, new).persist()
        grown = rows.where("joined").select("tenant_id", "leader_id").distinct()
        pipeline.incidents(rows.join(grown, ["tenant_id", "leader_id"], "left_semi"), []).write.mode("overwrite").parquet(f"{folder}/incidents/{spot}")
        opened = pipeline.incidents(rows.where("joined AND leader_id = exception_id"), []).select("incident_id")
        pipeline.events_of(new, spark.read.parquet(f"{folder}/incidents/{spot}").join(opened, "incident_id", "left_semi")).write.mode("overwrite").json(f"{folder}/events/{spot}")
        _kept(rows, newest).write.mode("overwrite").parquet(f"{folder}/held/{number % 2}")
        if newest:
            batch.where(F.col("fetched_at") < F.lit(newest) - F.expr("INTERVAL 1 HOUR")).write.mode("overwrite").json(f"{folder}/too_old/{spot}")
        rows.unpersist()
        batch.unpersist()

    return raw.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/_checkpoint").trigger(processingTime=f"{seconds} seconds")


def history(readings: DataFrame, folder: str, seconds: int = 300) -> DataStreamWriter:
    """Writer of good readings as Parquet by tenant and hour; the others are left to ``rejected``."""
    rows = readings.where(sinks.good_reading()).withColumns({"dt": F.date_format("observed_at", "yyyy-MM-dd"), "hh": F.date_format("observed_at", "HH")})
    return rows.writeStream.format("parquet").partitionBy("tenant_id", "dt", "hh").option("path", f"{folder}/history").option("checkpointLocation", f"{folder}/_history").trigger(processingTime=f"{seconds} seconds")


def rejected(readings: DataFrame) -> DataFrame:
    return readings.where(~sinks.good_reading())


def lag_seconds(progress: dict) -> float | None:
    """How far a query's newest event time is ahead of its watermark, from a progress report."""
    times = progress.get("eventTime", {})
    if "max" not in times or "watermark" not in times:
        return None
    return (pd.Timestamp(times["max"]) - pd.Timestamp(times["watermark"])).total_seconds()


class Lag(StreamingQueryListener):
    """Keeps, per query name, how far event time is ahead of the watermark, and the rows and seconds of the last batch; a backlog
    builds up where a batch takes longer than its trigger allows."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = json.loads(event.progress.json)
        took = progress.get("durationMs", {}).get("triggerExecution", 0) / 1000
        self.latest[progress.get("name") or progress["id"]] = {"lag_seconds": lag_seconds(progress), "rows": progress.get("numInputRows", 0), "seconds": took}

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def backlog(landed: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Per tenant and provider, how many landed records no batch has archived yet, and the oldest of them."""
    left = landed.join(done.select(*keys).distinct(), keys, "left_anti")
    return left.groupBy("tenant_id", "provider").agg(F.count("*").alias("waiting"), F.min("fetched_at").alias("oldest"))
