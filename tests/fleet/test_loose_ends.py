"""Small operators: witness lines, incident creation, polls, lag, backlog, retention, runbooks, saved space, sizes, retrieval."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy import schema
from convoy.functions import text
from convoy.operators import access, events, exports, nearest, pipeline, places, retrieval, sinks, sizes
from convoy.operators.access import Engine, Principal
from convoy.sources import readers, registry
from tests.fleet import demo as fleet
from convoy.streaming import jobs

TENANT = "acme-freight"


def test_the_fleet_is_the_same_at_any_partitioning_and_scales(spark):
    one = {r.driver_id: r for r in fleet.fleet(spark).drop("path").collect()}
    assert len(one) == 60 and sorted({r.district_id for r in one.values()}) == ["aus", "chi", "dal", "den", "phx"]
    assert {r.status for r in one.values()} == {s for s, _ in fleet.STATUS_SHARES}
    assert {k: r for k, r in one.items()} == {r.driver_id: r for r in fleet.fleet(spark).drop("path").repartition(3).collect()}
    big = fleet.drivers(spark, "t", times=50)
    shares = {r.status: r.n / 3000 for r in big.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert big.count() == 3000 and big.select("driver_id").distinct().count() == 3000 and big.schema.simpleString() == schema.DRIVER.simpleString()
    assert all(abs(shares[s] - p) < 0.05 for s, p in fleet.STATUS_SHARES)
    assert big.where("status = 'off-duty' AND hos_remaining_minutes <> 660 OR hos_remaining_minutes NOT BETWEEN 0 AND 660").count() == 0


def test_witness_lines(spark):
    rows = spark.createDataFrame([(["a", "b"], False), (["a"], True), (["a"], False)], "p array<string>, paged boolean")
    assert [r[0] for r in rows.select(text.witness(F.col("p"), F.col("paged"))).collect()] == ["a + b agree", "a + a second signal", "a only"]


def test_incidents_are_created_by_writers_in_scope_only(spark):
    engine, at = Engine({"drivers": fleet.drivers(spark, TENANT)}), F.lit(fleet.EPOCH)
    new = lambda *p, **k: engine.seen_by(Principal(TENANT, *p, **k)).create_incident("Flood", "warning", "dal", ["drv-1001", "drv-1000", "nobody"], at)
    row = new(roles=("dispatcher",)).first()
    assert row.driver_ids == ["drv-1000", "drv-1001"] and row.status == "open" and len(row.incident_id) == 24
    assert new(roles=("viewer",)).count() == 0 and new("district", "aus", roles=("dispatcher",)).count() == 0


def test_polls_read_what_is_new(spark):
    rows = spark.createDataFrame([(k, datetime(2026, 1, 1, 0, k)) for k in range(5)], "k int, at timestamp")
    assert [r.k for r in access.since(rows, "at", None).collect()] == list(range(5))
    assert [r.k for r in access.since(rows, "at", F.lit(datetime(2026, 1, 1, 0, 2))).collect()] == [3, 4]


def test_retention_and_backlog(spark):
    rows = spark.createDataFrame([("t", "p", k, datetime(2026, 1, 1 + k)) for k in range(4)], "tenant_id string, provider string, k int, fetched_at timestamp")
    assert [r.k for r in sinks.retained(rows, "fetched_at", F.lit(datetime(2026, 1, 4))).orderBy("k").collect()] == [1, 2, 3]
    (left,) = jobs.backlog(rows, rows.where("k < 2"), ["k"]).collect()
    assert (left.waiting, left.oldest) == (2, datetime(2026, 1, 3)) and jobs.backlog(rows, rows, ["k"]).count() == 0


def test_lag_is_listened_to(spark, tmp_path):
    lag = jobs.Lag()
    spark.streams.addListener(lag)
    try:
        rows = fleet.trace(spark, TENANT, 5).select(*schema.TELEMETRY.fieldNames())
        rows.write.parquet(f"{tmp_path}/in")
        query = jobs.windowed_counts(readers.stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("lagged").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(50):
            if lag.latest.get("lagged"):
                break
            query.awaitTermination(0.2)
        assert "lag_seconds" in lag.latest["lagged"] and lag.latest["lagged"]["seconds"] >= 0
    finally:
        spark.streams.removeListener(lag)
    assert jobs.lag_seconds({"eventTime": {"max": "2026-01-01T00:10:00.000Z", "watermark": "2026-01-01T00:00:00.000Z"}}) == 600


def test_history_streams_good_readings_by_hour(spark, tmp_path):
    good = fleet.trace(spark, TENANT, 4).select(*schema.TELEMETRY.fieldNames())
    good.unionByName(good.limit(3).withColumn("value", F.lit(float("nan")))).write.parquet(f"{tmp_path}/in")
    source = readers.stream(spark, f"{tmp_path}/in")
    jobs.history(source, str(tmp_path)).trigger(availableNow=True).start().awaitTermination(60)
    back = readers.history(spark, f"{tmp_path}/history")
    assert back.count() == 240 and {(r.tenant_id, str(r.dt), int(r.hh)) for r in back.select("tenant_id", "dt", "hh").distinct().collect()} == {(TENANT, "2026-09-08", 14)}
    assert jobs.rejected(spark.read.schema(schema.TELEMETRY).parquet(f"{tmp_path}/in")).count() == 3
    assert jobs.feed(spark.createDataFrame([("dal",), ("aus",)], "district_id string"), "dal").count() == 1


def test_runbooks_and_saved_space(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nIntro\n## One\nbody\n")
    docs = readers.documents(spark, str(tmp_path), TENANT)
    assert [(r.source, r.tenant_id) for r in docs.collect()] == [("a.md", TENANT)] and retrieval.chunk_markdown(docs).count() == 2
    shares = spark.createDataFrame([("x" * 100, "y" * 24), ("", "y")], "g string, t string").select(exports.saved_share(F.col("g"), F.col("t")).alias("s")).collect()
    assert [r.s for r in shares] == [0.76, None]


def test_sign_in_by_domain(spark):
    people = spark.createDataFrame([("a@ACME-freight.com",), ("b@nowhere.org",), (None,), ("",)], "email string")
    got = [r[0] for r in people.select(registry.identity_provider(F.col("email"), registry.memberships(spark))).collect()]
    assert got == ["carrier:acme-freight.com", "hosted", "hosted", "hosted"]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_many_questions_find_what_one_by_one_finds(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", block)
    rnd = random.Random(block)
    words = [f"word{k}" for k in range(40)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    chunks = [(rnd.choice("ab"), f"c{k:03d}", make(rnd.randrange(0, 12))) for k in range(120)] + [("a", "c500", None), (None, "c501", make(5)), ("a", "c502", chunk := make(6)), ("a", "c499", chunk)]
    questions = [("a", k, make(rnd.randrange(0, 6))) for k in range(9)] + [("b", 50, make(4)), ("c", 51, make(4)), ("a", 60, chunk), (None, 61, chunk)]
    found = retrieval.retrieve_many(spark.createDataFrame(chunks, "tenant_id string, chunk_id string, text string").repartition(3), spark.createDataFrame(questions, "tenant_id string, question_id int, text string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault((r.tenant_id, r.question_id), []).append((r.chunk_id, round(r.score, 6)))
    # by plain loops
    import hashlib
    from collections import Counter

    def vector(t):
        c = Counter(int(hashlib.sha256(w.encode()).hexdigest()[:4], 16) % 256 for w in (t or "").split())
        n = math.sqrt(sum(v * v for v in c.values()))
        return {k: v / n for k, v in c.items()}

    want = {}
    for tenant, q, t in questions:
        scored = []
        for own, c, u in chunks:
            if own == tenant and tenant is not None:
                x, y = vector(t), vector(u)
                cosine = sum(x[k] * y.get(k, 0) for k in x)
                if cosine > 0:
                    scored.append((-math.floor((0.7 * cosine + 0.3 * len(set(t.split()) & set(u.split())) / len(set(t.split()))) * 1e9 + 0.5), c))
        if scored:
            want[(tenant, q)] = [(c, round(-s / 1e9, 6)) for s, c in sorted(scored)[:3]]
    assert {k: [c for c, _ in v] for k, v in got.items()} == {k: [c for c, _ in v] for k, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


@pytest.mark.parametrize(("rows", "words"), [(7, 10**9), (10**9, 20), (1000, 10**9)])
def test_chunks_are_scored_in_bounded_slices(monkeypatch, rows, words):
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "CHUNK_ROWS", rows)
    monkeypatch.setattr(retrieval, "CHUNK_WORDS", words)
    lists = [["w"] * (k * 7 % 31) for k in range(100)]
    batch = pa.RecordBatch.from_pydict({"tenant_id": ["a"] * 100, "chunk_id": list(range(100)), "words": pa.array(lists, pa.list_(pa.string()))}).slice(3)
    pieces = list(retrieval._pieces(batch))
    assert [i for p in pieces for i in p.column(1).to_pylist()] == list(range(3, 100))
    assert all(0 < p.num_rows <= rows and (p.num_rows == 1 or len(p.column(2).flatten()) <= words) for p in pieces)


def test_farthest_of_many_places():
    rng = np.random.default_rng(4)
    for n in (2, 3, 50, 400):
        lon, lat = rng.normal(-97, 0.5, n), rng.normal(32, 0.5, n)
        x, y = np.radians(lon), np.radians(lat)
        h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
        assert abs(pipeline._farthest(list(lon), list(lat)) - 2 * 6371 * np.arcsin(np.sqrt(h.max()))) < 1e-9
    assert pipeline._farthest([1.0, 1.0], [2.0, 2.0]) == 0


def test_the_index_gives_what_one_list_gives(spark, monkeypatch):
    corridors = fleet.corridors(spark)
    points = fleet.drivers(spark, TENANT).select("driver_id", "lon", "lat", F.when(F.col("driver_id") < "drv-1020", F.col("district_id")).alias("at"))
    near = lambda: sorted((r.driver_id, r.nearest.corridor_id, r.nearest.metres) for r in pipeline.nearest_corridor(points, corridors, F.col("lon"), F.col("lat"), F.col("at")).collect())
    depots = fleet.territories(spark, TENANT).select("district_id", "lon", "lat")
    three = lambda: sorted((r.driver_id, r["rank"], r.district_id) for r in places.nearest_place(points, depots, "driver_id", "district_id", 3).collect())
    one = near(), three()
    monkeypatch.setattr(nearest, "FEW", 1)
    monkeypatch.setattr(nearest, "LIST", 2)
    assert len(one[0]) == 60 and len(one[1]) == 180 and (near(), three()) == one


def test_broadcasts_are_counted(spark):
    rows = spark.range(20)
    plan = lambda n: spark.range(5).join(sizes.small(rows, n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(20) and "strategy=broadcast" not in plan(19)
    payloads = spark.createDataFrame([(1, ["a"], "open")], "id int, driver_ids array<string>, status string")
    subs = spark.createDataFrame([(1, "a", None), (2, None, "open"), (3, None, "shut")], "sub int, want_driver_ids string, want_status string")
    assert sorted(r.sub for r in events.fan_out(payloads, subs, {"driver_ids": True, "status": False}).collect()) == [1, 2]
