"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the (unit) vectors are learned so that signs quantise them with
least error; each gives as many bits as the vector has components.  The bits are
cut into the keys of many tables; vectors of one label that agree in a whole key
meet in that key's bucket.

The index has a row per vector and table: bucket, id and the code's first 64 bits,
but no vector.  In a bucket of up to ``RUN`` vectors, pairs whose codes differ in at
some bits at most become candidates; they are made distinct and the vectors are joined
once, to rerank by the cosine in double precision.  Larger buckets get their vectors
and are split into blocks, every two of which meet in one cell, so nothing is capped
and no task holds a large bucket; a cell returns a row per linked vector (its number of
links, and the smallest vector its links there lead to), not a row per pair.  A pair
counts in the first table where it meets.

The key's width follows the number of vectors, so buckets stay small, and the
number of tables follows the width, so that a pair at the threshold meets with
probability ``RECALL`` for independent bits (better for learned ones).  Only the
rotations are fitted on a sample, of ``FIT_ROWS`` vectors; every vector is indexed.

Equal vectors of a label are one class with a multiplicity.

Null labels, null ids, and vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are reported with 0 links.  Vectors
of different length never link.  Repeated rows are vectors of their own, which link;
so are different vectors that share an id.  Further columns are dropped.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import words as W
from convoy.llm.graph import components
from convoy.llm.shared import settled, split_join, table

THRESHOLD, RECALL = 0.93, 0.985
FIT_ROWS, FIT_STEPS = 4096, 30
#: Vectors of a bucket up to which its pairs are tried by their codes alone, and of a block of a larger one.
RUN, BLOCK = 32, 1024
#: Bits of a code; candidates may differ in as many of them as a pair at the threshold does on average and FAR_DEVIATIONS more.
CODE, FAR_DEVIATIONS = 64, 6
#: Bits of a key: about the logarithm of the number of vectors, within these.
LEAST_BITS, MOST_BITS = 8, 40


def fit_rotations(sample: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """``count`` rotations for balanced sign codes, each from a random start: count x dim x dim."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(FIT_STEPS if len(sample) else 0):
            code = np.where(sample @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(sample.T @ code)
            r = left @ right
        out.append(r)
    return np.stack(out)


def layout(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Bits of a key, tables, and rotations needed for them."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree))
    return bits, tables, math.ceil(bits * tables / dim)


def far(threshold: float) -> int:
    """Bits of the code in which a candidate may differ: 24 of 64 at 0.93."""
    share = math.acos(threshold) / math.pi
    return math.ceil(CODE * share + FAR_DEVIATIONS * math.sqrt(CODE * share * (1 - share)))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / np.where(scale > 0, scale, 1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def signs_of(units: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Bits of each vector; turned: the rotations' columns, one for each bit."""
    return units @ turned >= 0


def keys_of(signs: np.ndarray, bits: int) -> np.ndarray:
    """Key of each vector in each table: vectors x tables."""
    return (signs.reshape(len(signs), signs.shape[1] // bits, bits) * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(2)


def usable(vector: Column) -> Column:
    """Whether a vector can link: present, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, filled up with zeros, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    first = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[rows, :d] = unit(flat[first[rows][:, None] + np.arange(d)])
    return out, size


@dataclass
class Tables:
    """Columns of the rotations by vector length, and how bits make keys."""

    turned: dict[int, np.ndarray]
    bits: int
    tables: int

    def signs(self, units: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(size), self.bits * self.tables), bool)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            out[rows] = signs_of(units[rows, :d], self.turned[int(d)])
        return out

    def first_meeting(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first table in which each pair of sign rows agrees."""
        return (keys_of(x, self.bits) == keys_of(y, self.bits)).argmax(1)


INDEX = "bucket long, cid long, t int, code long"
MEETINGS = "bucket long, t int, a long, b long"


def _index(classes: DataFrame, shared) -> DataFrame:
    """A row per class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                units, size = _units(part.column(2))
                signs = own.signs(units, size)
                t = np.arange(own.tables)
                where = W.mix(part.column(1).to_numpy().view(np.uint64) ^ W.mix(size.astype(np.uint64), 1), 2)[:, None] ^ W.mix(t.astype(np.uint64), 3)[None, :]
                bucket = W.mix(keys_of(signs, own.bits).view(np.uint64) ^ where, 4)
                marks = np.zeros((part.num_rows, CODE), bool)
                marks[:, : signs.shape[1]] = signs[:, :CODE]
                code = np.packbits(marks, axis=1).view(np.int64)[:, 0]
                cols = (bucket.view(np.int64).ravel(), np.repeat(part.column(0).to_numpy(), own.tables), np.tile(t.astype(np.int32), part.num_rows), np.repeat(code, own.tables))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "cid", "t", "code"])

    return classes.select("cid", "place", "vec").mapInArrow(run, INDEX)


def _meetings(batches: Iterator[pa.RecordBatch], most: int, small: int) -> Iterator[pa.RecordBatch]:
    """From index rows sorted by bucket: candidates (a, b) of buckets of at most ``small``, and the rows (a) of larger ones.

    The last bucket of a batch is carried over while it is small; a larger one streams through.
    """
    held = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int32, np.int64))
    running = None  # the large bucket that streams through

    def large(bucket: np.ndarray, cid: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(t), pa.array(cid), pa.nulls(len(cid), pa.int64())], ["bucket", "t", "a", "b"])

    def whole(bucket: np.ndarray, cid: np.ndarray, t: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(bucket):
            return
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        run = np.cumsum(new) - 1
        often = np.bincount(run)[run] > small
        if running is not None:
            often |= bucket == running
        if often.any():
            yield large(bucket[often], cid[often], t[often])
        bucket, cid, t, code = (x[~often] for x in (bucket, cid, t, code))
        for step in range(1, small):
            i = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(i):
                break
            i = i[(np.bitwise_count((code[i] ^ code[i + step]).view(np.uint64)) <= most) & (cid[i] != cid[i + step])]
            x, y = cid[i], cid[i + step]
            cols = (bucket[i], t[i], np.minimum(x, y), np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "t", "a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(np.concatenate([h, b.column(k).to_numpy()]) for k, h in enumerate(held))
        last = rows[0][-1]
        done = rows[0] != last
        yield from whole(*[x[done] for x in rows])
        rest = tuple(x[~done] for x in rows)
        if len(rest[0]) > small or (running is not None and last == running):
            yield large(*rest[:3])
            running, held = last, tuple(x[:0] for x in rest)
        else:
            held = rest
    yield from whole(*held)


LINKS = "cid long, links long, to long"


def _gathered(cid: np.ndarray, n: np.ndarray, a: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """From links between rows ``a`` and ``c``: each linked row's number of links, and the smallest id they lead to."""
    links = np.bincount(a, n[c], len(cid)) + np.bincount(c, n[a], len(cid))
    to = cid.copy()
    while True:
        low = np.minimum(to[a], to[c])
        before = to.copy()
        np.minimum.at(to, a, low)
        np.minimum.at(to, c, low)
        if np.array_equal(before, to):
            break
    found = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(cid[found]), pa.array(links[found].astype(np.int64)), pa.array(to[found])], ["cid", "links", "to"])


def _reranked(candidates: DataFrame, classes: DataFrame, shared, threshold: float) -> DataFrame:
    """Links among candidates (a, b, t)."""
    side = lambda name: classes.select(F.col("cid").alias(name), F.col("label").alias(f"label_{name}"), F.col("n").alias(f"n_{name}"), F.col("vec").alias(f"vec_{name}"))
    rows = candidates.join(side("a"), "a").join(side("b"), "b").where("label_a = label_b AND size(vec_a) = size(vec_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            (x, size), (y, _) = _units(b.column(5)), _units(b.column(6))
            near = np.einsum("ij,ij->i", x, y) >= threshold
            keep = np.flatnonzero(near)
            first = own.first_meeting(own.signs(x[keep], size[keep]), own.signs(y[keep], size[keep]))
            keep = keep[first == b.column(2).to_numpy()[keep]]
            cid, back = np.unique(np.concatenate([b.column(c).to_numpy()[keep] for c in (0, 1)]), return_inverse=True)
            n = np.zeros(len(cid), np.int64)
            n[back] = np.concatenate([b.column(c).to_numpy()[keep] for c in (3, 4)])
            yield _gathered(cid, n, back[: len(keep)], back[len(keep) :])

    return rows.select("a", "b", "t", "n_a", "n_b", "vec_a", "vec_b").mapInArrow(run, LINKS)


def _cells(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (bucket, t, cid) of large buckets by cell, with their vectors: a bucket, or two blocks of it."""
    counts = large.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    rows = split_join(large, counts, "bucket", "cid").withColumn("block", F.pmod(F.xxhash64("cid"), "_blocks").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)).alias("_other")).withColumns({"_i": F.least("block", "_other"), "_j": F.greatest("block", "_other")})
    rows = rows.select(F.xxhash64("bucket", "_i", "_j").alias("cell"), "bucket", "t", "block", (F.col("_i") != F.col("_j")).alias("cross"), "cid")
    return rows.join(classes.select("cid", "label", "n", "vec"), "cid").select("cell", "bucket", "t", "block", "cross", "cid", "label", "n", "vec")


def _links(cells: DataFrame, shared, threshold: float) -> DataFrame:
    """Links found in cells."""

    def of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        cell, bucket, t, block, cross, cid, n = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "bucket", "t", "block", "cross", "cid", "n"))
        label = np.unique(np.array(b.column(6).to_pylist(), object).astype(str), return_inverse=True)[1]
        units, size = _units(b.column(8))
        own = shared.value
        signs = own.signs(units, size)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out_a, out_c = [], []
        for i, j in zip(starts, [*starts[1:], len(cell)], strict=True):
            for k in range(i, j, 256):  # some rows against the rest of the cell
                stop = min(k + 256, j)
                near = units[k:stop] @ units[k:j].T >= threshold
                x, y = np.nonzero(np.triu(near, 1))
                x, y = x + k, y + k
                ok = (bucket[x] == bucket[y]) & (label[x] == label[y]) & (size[x] == size[y]) & (cid[x] != cid[y]) & (~cross[x] | (block[x] != block[y]))
                x, y = x[ok], y[ok]
                for m in range(0, len(x), 16384):
                    p, q = x[m : m + 16384], y[m : m + 16384]
                    first = own.first_meeting(signs[p], signs[q]) == t[p]
                    out_a.append(p[first])
                    out_c.append(q[first])
        if out_a:
            yield _gathered(cid, n, np.concatenate(out_a), np.concatenate(out_c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column(0).to_numpy(zero_copy_only=False)
            start = int(np.searchsorted(cell, cell[-1]))
            if start or (held and held[0].column(0)[-1].as_py() != cell[0].item()):
                first = [x for x in (*held, b.slice(0, start)) if x.num_rows]
                if first:
                    yield from of(first)
                held = []
            held.append(b.slice(start))
        if held:
            yield from of(held)

    return cells.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, LINKS)


def _linked(classes: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, to) of all classes that link with others, in several rows each."""
    spark = classes.sparkSession
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    sample = [r.vec for r in classes.select("vec", "h").orderBy("h").limit(FIT_ROWS).collect()]
    dim = max(map(len, sample), default=1)
    fitted = unit(np.array([v for v in sample if len(v) == dim] or np.zeros((0, dim))))
    bits, tables, _ = layout(most, dim, threshold)
    turned = {}
    for (d,) in classes.select(F.size("vec")).distinct().collect():  # one length as a rule
        own = fit_rotations(fitted if d == dim else np.zeros((0, d)), math.ceil(bits * tables / d))
        turned[d] = np.concatenate(list(own), 1)[:, : bits * tables]
    shared = spark.sparkContext.broadcast(Tables(turned, bits, tables))
    most_apart, small = far(threshold), RUN
    met = _index(classes, shared).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _meetings(batches, most_apart, small), MEETINGS)
    met = settled(met, "vector-meetings")
    candidates = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.min("t").alias("t"))
    found = _reranked(candidates, classes, shared, threshold)
    large = met.where("b IS NULL").select("bucket", "t", F.col("a").alias("cid"))
    if not large.isEmpty():
        found = found.unionByName(_links(_cells(large, classes), shared, threshold))
    return settled(found, "vector-links")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Key, ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = df.sparkSession
    fine = usable(F.col(vector)) & F.col(label).isNotNull() & F.col(key).isNotNull()
    kind = df.schema[vector].dataType.simpleString()
    vec = F.col(vector) if kind in ("array<float>", "array<double>") else F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("id"), F.when(fine, F.col(label).cast("string")).alias("label"), F.when(fine, vec).alias("vec"))
    rows = rows.withColumns({"h": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "g": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec"))})
    classes = rows.where("vec IS NOT NULL").groupBy("label", "h", "g").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = settled(classes.withColumn("place", F.xxhash64("label")), "vector-classes")
    plain = classes.select("least").distinct().count() == classes.count()  # else different vectors share an id
    classes = classes.withColumn("cid", F.col("least") if plain else F.xxhash64("label", "h", "g"))
    if classes.isEmpty():
        near = spark.createDataFrame([], "node long, component long")
        links = spark.createDataFrame([], "cid long, links long")
    else:
        found = _linked(classes, threshold)
        near = components(found, "cid", "to")
        if not plain:
            least = near.join(classes.select(F.col("cid").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("least"))
            near = near.join(least, "component").select("node", F.col("least").alias("component"))
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("label", "h", "g", "cid", "n", "least").join(links, "cid", "left").join(near.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("label", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = rows.drop("vec").join(known, ["label", "h", "g"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op9_hamming_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings of a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_cosine_similarity(a.u, b.u) >= 0.93),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
r AS (SELECT a AS node, b AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
SELECT m.vec_id, coalesce(n, 0) AS n_links, least(m.vec_id, coalesce(least, m.vec_id)) AS component_id, m.vec_id = least(m.vec_id, coalesce(least, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN n ON n.vec_id = m.vec_id LEFT JOIN c ON node = m.vec_id
"""
