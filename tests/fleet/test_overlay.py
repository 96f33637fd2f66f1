"""The as-of join of two streams against the batch."""

import random
from datetime import UTC, datetime, timedelta

from convoy.streaming import jobs

BEGIN = datetime(2026, 9, 8, 14, 30, tzinfo=UTC)
TICK = "tenant_id string, driver_id string, observed_at timestamp, lon double, lat double"
PROBE = "tenant_id string, driver_id string, observed_at timestamp, probe_id string"


def _at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def test_overlay_of_streams_equals_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    ticks = [("t", f"d{rnd.randrange(6)}", rnd.randrange(3000), rnd.random(), rnd.random()) for _ in range(300)]
    ticks = [r for r in ticks if r[1] != "d5"] + [("t", "d0", 100, None, 1.0)]  # a driver without ticks, a tick without a place
    probes = [("t", f"d{rnd.randrange(6)}", rnd.randrange(3000), f"p{k}") for k in range(200)]
    # rows land up to eight minutes late, which is within the watermark; the last of all ends every wait
    order = lambda r: r[2] + rnd.randrange(480)
    for name, rows, kind in (("ticks", ticks, TICK), ("probes", probes, PROBE)):
        rows = sorted(rows, key=order)
        end = ("t", "end", 90_000, *((0.0, 0.0) if name == "ticks" else ("end",)))
        for k in range(0, len(rows) + 1, 60):
            part = [(a, b, _at(c), *rest) for a, b, c, *rest in [*rows[k : k + 60], *([end] if k + 60 > len(rows) else [])]]
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}") for name, kind in (("probes", PROBE), ("ticks", TICK))]
    q = jobs.overlay(*streams).writeStream.format("memory").queryName("overlay").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.probe_id: (r.lon, r.lat, r.tick_at) for r in spark.table("overlay").collect() if r.probe_id != "end"}
    want = {}
    for _, d, t, p in probes:
        before = [(c, lon, lat) for _, e, c, lon, lat in ticks if e == d and c <= t and lon is not None]
        c, lon, lat = max(before, default=(None, None, None))
        want[p] = (lon, lat, None if c is None else _at(c).replace(tzinfo=None))
    assert got == want and any(v[0] is None for v in want.values()) and sum(v[0] is not None for v in want.values()) > 100
