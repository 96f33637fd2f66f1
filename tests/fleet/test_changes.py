"""Change logs: replays give the tables."""

import random

from pyspark.sql import functions as F

from convoy.operators import changes

COLUMNS = "tenant_id string, k string, value double, tags array<string>"


def _versions(seed, n=5):
    rnd, out, state = random.Random(seed), [], {}
    for _ in range(n):
        for k in range(40):
            at = (rnd.choice(["a", "b", None]), f"k{k}" if k else None)
            lot = rnd.random()
            if lot < 0.3:
                state[at] = (rnd.choice([None, 1.5, float("nan")]), rnd.choice([None, [], ["x"]]))
            elif lot < 0.5:
                state.pop(at, None)
        out.append([(*at, *v) for at, v in state.items()])
    return out


def _text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_replay_gives_every_version(spark, tmp_path):
    tables = [spark.createDataFrame(rows, COLUMNS) for rows in [[], *_versions(1)]]
    keys = ["tenant_id", "k"]
    for v in range(1, len(tables)):
        changes.append(changes.changes(tables[v - 1], tables[v], keys, v), f"{tmp_path}/log")
    log = changes.read(spark, f"{tmp_path}/log")
    for v in range(1, len(tables)):
        for base in (0, v // 2):
            assert _text(changes.replay(tables[base], changes.read(spark, f"{tmp_path}/log", base), keys, v).collect()) == _text(tables[v].collect())
    squeezed = changes.compacted(changes.read(spark, f"{tmp_path}/log", 1, 4), keys)
    assert _text(changes.replay(tables[1], squeezed, keys, 4).collect()) == _text(tables[4].collect())
    assert squeezed.count() <= log.where("version BETWEEN 2 AND 4").select(*keys).distinct().count()
    numbers = log.groupBy("version", "shard").agg(F.sort_array(F.collect_list("number")).alias("n")).collect()
    assert all(r.n == list(range(1, len(r.n) + 1)) for r in numbers)
    images = {r.op: (r.b, r.a) for r in log.groupBy("op").agg(F.bool_and(F.col("before").isNull()).alias("b"), F.bool_and(F.col("after").isNull()).alias("a")).collect()}
    assert images == {"insert": (True, False), "update": (False, False), "delete": (False, True)}


def test_a_version_written_again_replaces_itself_and_readers_open_new_ones_only(spark, tmp_path):
    one, two, three = (spark.createDataFrame(rows, COLUMNS) for rows in _versions(2, 3))
    keys, folder = ["tenant_id", "k"], f"{tmp_path}/log"
    changes.append(changes.changes(one, two, keys, 1), folder)
    for _ in range(2):
        changes.append(changes.changes(two, three, keys, 2), folder)
    log = changes.read(spark, folder)
    assert log.count() == log.select("version", "shard", "number").distinct().count() and log.where("version = 1").count() > 0
    plan = changes.read(spark, folder, after=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan
    assert changes.changes(two, two, keys, 3).count() == 0


def test_a_point_read_opens_the_row_groups_that_may_hold_it(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from convoy.operators import sinks

    rows = spark.range(100_000).select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tenant_id"), F.lpad((F.col("id") * 7919 % 100_003).cast("string"), 6, "0").alias("driver_id"), F.xxhash64("id").alias("ref"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    path = f"{tmp_path}/clustered"
    sinks.clustered(rows.repartition(7), ["tenant_id", "driver_id"], path, ("ref",), 256 << 10)
    groups = [(g.num_rows, [(g.column(k).statistics.min, g.column(k).statistics.max) for k in (0, 1)], g.column(2).path_in_schema) for f in glob.glob(f"{path}/*.parquet") for m in [pq.read_metadata(f)] for k in range(m.num_row_groups) for g in [m.row_group(k)]]
    assert len(groups) > 8 and sum(n for n, *_ in groups) == 100_000
    one = rows.where("id = 5").first()
    holds = [n for n, ((a, b), (c, d)), _ in groups if a <= one.tenant_id <= b and c <= one.driver_id <= d]
    assert len(holds) <= 2  # one, and one that goes over a border between tenants

    def scanned(found):
        found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    table = spark.read.parquet(path)
    point = table.where((F.col("tenant_id") == one.tenant_id) & (F.col("driver_id") == one.driver_id))
    assert point.count() == 1 and scanned(point) <= sum(holds)
    assert scanned(table.where(F.col("ref") == one.ref)) <= 3 * max(n for n, *_ in groups)  # Bloom filters err rarely
