"""N-gram Jaccard join with a token-group matrix.

Documents link when their sets of word shingles have a Jaccard similarity of the
threshold or more; each document gets its component under these links.

1.  A document shows the first of its shingles in one global order, as many as it
    can miss at the threshold and one more; documents that link show a shingle in
    common.  The order puts shingles that are frequent in a bounded sample last, which
    sets cost, never results.
2.  One shuffle by shingle.  Shingles of up to ``SMALL`` documents give candidate
    pairs; the others keep their rows, and meet a few centres first.
3.  Candidates are checked for size, then by parity sketches (their distance bounds
    the sets' difference), then exactly.  Linked documents form groups.
4.  The matrix: for each frequent shingle, the groups that hold it.  A group, cut by the
    size of its sets, keeps the union of its shingles as a bit table.  A document that
    meets a group other than its own is bounded by its overlap with that union: a bit
    that only the document has stands for a shingle that no member has.  Only groups
    that pass are opened, and their members verified.
    Documents that are no longer apart are not compared at all.

Equal sets within a batch become one at once, so large groups of copies send few
rows.  Sets are read again for documents with candidates only.

Texts are lower-cased A-Z; fewer words than a shingle are one shingle; null and
empty texts have an empty set and link with nothing.  A null key links with
nothing and its component is null.  Repeated rows each get a row; rows that
share a key count as one document, which links where one of its texts does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import words as W
from convoy.llm.graph import components
from convoy.llm.shared import settled, split_join, table

WIDTH = 5
#: Links need 5 * intersection >= 4 * union, a similarity of 0.8.
NUMERATOR, DENOMINATOR = 4, 5
#: Documents of a shingle up to which all their pairs are candidates.
SMALL = 16
#: The order counts the shingles of one document in SAMPLE_PART (of SAMPLE_LEAST documents at least, SAMPLE_MOST at most); a
#: frequent shingle occurs SAMPLE_COUNT times there, or so often that no more than LATE_MOST are frequent (8 bytes each).
SAMPLE_PART, SAMPLE_LEAST, SAMPLE_MOST, SAMPLE_COUNT, LATE_MOST = 16, 8000, 200_000, 3, 1_000_000
#: Centres that the documents of a frequent shingle meet first.
CENTRES = 6
#: Documents of a block.
BLOCK = 256
#: Documents with candidates up to which their ids are broadcast (8 bytes each), and bytes of group unions up to which they are.
BROADCAST_IDS, BROADCAST_BYTES = 2_000_000, 16 << 20


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text that has any."""
    for w in W.words(texts, lower=True):
        shingle, first = W.shingles(w, WIDTH)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
        shingle, doc = shingle[new], doc[new]
        at = np.searchsorted(doc, np.arange(len(first)))
        for d in np.flatnonzero(at[1:] > at[:-1]):
            yield w.rows.start + int(d), shingle[at[d] : at[d + 1]]


def shown(n: int) -> int:
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def _slots(tokens: np.ndarray, wide: int) -> tuple[np.ndarray, int]:
    count = max(64, 1 << int(wide * len(tokens) - 1).bit_length())
    return (W.mix(tokens, 71) & np.uint64(count - 1)).astype(np.int64), count


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the shingles in each of some slots; the distance of two never exceeds their sets' difference.

    There are as many slots as the next power of two from the set's size on, so a sketch costs an eighth to a quarter of a byte
    per shingle; a longer one folds to a shorter one's slots.
    """
    slot, count = _slots(tokens, 1)
    return np.packbits((np.bincount(slot, minlength=count) & 1).astype(np.uint8)).tobytes()


#: Slots of a bit table for each shingle.
TABLE_SLOTS = 4


def bit_table(tokens: np.ndarray) -> bytes:
    """Which of some slots have a shingle; a slot that only one of two tables has stands for a shingle that only one has."""
    slot, count = _slots(tokens, TABLE_SLOTS)
    bits = np.zeros(count, np.uint8)
    bits[slot] = 1
    return np.packbits(bits).tobytes()


def _stack(marks: list[bytes], rows: np.ndarray, size: int, fold=np.bitwise_xor) -> np.ndarray:
    """Sketches (or, with ``bitwise_or``, bit tables) of some rows as words, folded to ``size`` bytes."""
    out = np.frombuffer(b"".join(marks[k] for k in rows), np.uint64).reshape(len(rows), -1)
    while out.shape[1] * 8 > size:
        half = out.shape[1] // 2
        out = fold(out[:, :half], out[:, half:])
    return out


def _by_size(x: list[bytes], y: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """Which pairs have marks of the same two sizes, and the smaller size."""
    size = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(size, axis=0):
        yield np.flatnonzero((size[:, 0] == la) & (size[:, 1] == lb)), min(la, lb)


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Distance of each pair of sketches."""
    out = np.zeros(len(x), np.int64)
    for rows, size in _by_size(x, y):
        out[rows] = np.bitwise_count(_stack(x, rows, size) ^ _stack(y, rows, size)).sum(1, dtype=np.int64)
    return out


def missing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Slots that only the first of each pair of bit tables has: shingles that the other lacks, at least."""
    out = np.zeros(len(x), np.int64)
    for rows, size in _by_size(x, y):
        out[rows] = np.bitwise_count(_stack(x, rows, size, np.bitwise_or) & ~_stack(y, rows, size, np.bitwise_or)).sum(1, dtype=np.int64)
    return out


def all_apart(x: list[bytes], y: list[bytes], fold=np.bitwise_xor) -> np.ndarray:
    """Distance of every sketch (or bit table) of one list and every one of another."""
    sx, sy = np.array([len(a) for a in x]), np.array([len(b) for b in y])
    out = np.zeros((len(x), len(y)), np.int64)
    for la in np.unique(sx):
        for lb in np.unique(sy):
            i, j = np.flatnonzero(sx == la), np.flatnonzero(sy == lb)
            b = _stack(y, j, min(la, lb), fold)
            for k, a in zip(i, _stack(x, i, min(la, lb), fold), strict=True):
                out[k, j] = np.bitwise_count(a[None, :] ^ b).sum(1, dtype=np.int64)
    return out


# ---- rows of the first shuffle ------------------------------------------------

DOC, EDGE, PAIR, FREQUENT = 0, 1, 2, 3
SHOWN = "token long, doc long, n long, other long, kind int, sketch binary"
FOUND_NAMES = ["kind", "token", "a", "b", "n", "sketch"]
FOUND = "kind int, token long, a long, b long, n long, sketch binary"


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that are frequent in the sample, LATE_MOST at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in _sets(b.column(0))]
            if sets:
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    total = docs.count()
    wanted = min(SAMPLE_MOST, max(SAMPLE_LEAST, total // SAMPLE_PART))
    sample = docs.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 20)) < int(min(1.0, wanted / max(total, 1)) * (1 << 20))).select("text")
    rows = settled(sample.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_COUNT), "frequent")
    sizes = sorted(((r.n, r.k) for r in rows.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    room, least = LATE_MOST, 1 << 62
    for n, k in sizes:
        if k > room:
            break
        room, least = room - k, n
    return np.sort(rows.where(F.col("n") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _show(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for b in batches:
            valid = pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            size, marks = np.zeros(len(ids), np.int64), [None] * len(ids)
            rows: dict[bytes, tuple[int, int, np.ndarray]] = {}  # by set: the key that stands for it, the set's size, what it shows
            edges: list[tuple[int, int]] = []
            for r, tokens in _sets(b.column(1)):
                size[r] = len(tokens)
                if not valid[r]:
                    continue
                marks[r] = sketch(tokens)
                mark = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if mark in rows:  # an equal set: one key stands for both
                    other = rows[mark][0]
                    edges.append((int(ids[r]), other))
                    continue
                if len(late):
                    place = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                    tokens = tokens[np.argsort(late[place] == tokens, kind="stable")]
                rows[mark] = (int(ids[r]), int(size[r]), tokens[: shown(size[r])])
            n_of = [len(t) for *_, t in rows.values()]
            token = np.concatenate([t for *_, t in rows.values()]) if rows else np.zeros(0, np.uint64)
            doc = np.repeat(np.array([i for i, *_ in rows.values()], np.int64), n_of)
            full = np.repeat(np.array([n for _, n, _ in rows.values()], np.int64), n_of)
            yield _rows(token, doc, full, None, FREQUENT)
            a, c = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else [np.zeros(0, np.int64)] * 2
            yield _rows(W.mix(a.view(np.uint64), 91), a, np.zeros(len(a), np.int64), c, EDGE)
            yield _rows(W.mix(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64), 92), pa.array(ids, mask=~valid), size, None, DOC, marks)

    return run


def _rows(token: np.ndarray, doc, n: np.ndarray, other, kind: int, marks: list | None = None) -> pa.RecordBatch:
    others = pa.array(other) if other is not None else pa.nulls(len(token), pa.int64())
    sketches = pa.array(marks, pa.binary()) if marks is not None else pa.nulls(len(token), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), doc if isinstance(doc, pa.Array) else pa.array(doc), pa.array(n), others, pa.array(np.full(len(token), kind, np.int32)), sketches], ["token", "doc", "n", "other", "kind", "sketch"])


def _meet(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: documents, edges, pairs of shingles of at most ``small`` documents, rows of frequent ones.

    The last run of a batch is carried over while it is small; a longer one streams through.
    """
    held: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))
    running = None  # the frequent token whose rows stream through
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.column(4).to_numpy(zero_copy_only=False)
        for k in (DOC, EDGE):
            part = b.filter(pa.array(kind == k))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(0), part.column(1), part.column(3), part.column(2), part.column(5)], FOUND_NAMES)
        part = b.filter(pa.array(kind == FREQUENT))
        rows = tuple(np.concatenate([h, part.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, (0, 1, 2), strict=True))
        last = rows[0][-1] if len(rows[0]) else None
        done = rows[0] != last
        yield from _runs(*[x[done] for x in rows], running, small)
        rest = tuple(x[~done] for x in rows)
        if len(rest[0]) > small or (running is not None and last == running):
            yield _frequent_rows(*rest)
            running, held = last, tuple(x[:0] for x in rest)
        else:
            held = rest
    yield from _runs(*held, running, small)


def _runs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, running, small: int) -> Iterator[pa.RecordBatch]:
    if not len(token):
        return
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run]
    often = size > small
    if running is not None:
        often |= token == running
    if often.any():
        yield _frequent_rows(token[often], doc[often], n[often])
    token, doc, n = token[~often], doc[~often], n[~often]
    a_s, b_s = [], []
    for step in range(1, small):
        i = np.flatnonzero(token[step:] == token[:-step])
        if not len(i):
            break
        j = i + step
        i, j = i[fits(n[i], n[j])], j[fits(n[i], n[j])]
        a_s.append(np.minimum(doc[i], doc[j]))
        b_s.append(np.maximum(doc[i], doc[j]))
    if a_s:
        pair = np.unique(np.stack([np.concatenate(a_s), np.concatenate(b_s)], 1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        zero = np.zeros(len(pair), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), PAIR, np.int32)), pa.array(zero), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(zero), pa.nulls(len(pair), pa.binary())], FOUND_NAMES)


def _frequent_rows(token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(token), FREQUENT, np.int32)), pa.array(token), pa.array(doc), pa.nulls(len(token), pa.int64()), pa.array(n), pa.nulls(len(token), pa.binary())], FOUND_NAMES)


def fits(n, m):
    """Whether sets of these sizes can link at all; for numbers, arrays and columns."""
    return (n * DENOMINATOR >= m * NUMERATOR) & (m * DENOMINATOR >= n * NUMERATOR)


def fits_any(n: Column, least: Column, most: Column) -> Column:
    """Whether a set of size ``n`` can link with one of ``least`` to ``most``."""
    return (most * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= least * NUMERATOR)


# ---- verification ---------------------------------------------------------------


def _token_sets(docs: DataFrame, ids: DataFrame, repeated: bool = False) -> DataFrame:
    """(doc, tokens) of the documents named; only their texts are read again.  ``repeated``: equal rows become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_sets(b.column(1)))
            rows = pa.array([r for r, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([t.tobytes() for _, t in got], pa.binary())], ["doc", "tokens"])

    few = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc", "left_semi")
    sets = chosen.mapInArrow(run, "doc long, tokens binary")
    return sets.distinct() if repeated else sets


def _side(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow a link, which leaves at most a ninth of both sizes apart."""
    rows = pairs.join(_side(sketches, "a", "n", "sketch"), "a").where("a <> b").join(_side(sketches, "b", "n", "sketch"), "b").where(fits(F.col("n_a"), F.col("n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                room = (b.column(2).to_numpy() + b.column(4).to_numpy()) * (DENOMINATOR - NUMERATOR)
                far = apart(b.column(3).to_pylist(), b.column(5).to_pylist()) * (NUMERATOR + DENOMINATOR) > room
                yield b.select(["a", "b"]).filter(pa.array(~far))

    return rows.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long")


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that link."""
    both = near.join(_side(sets, "a", "tokens"), "a").join(_side(sets, "b", "tokens"), "b").select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[k] = DENOMINATOR * shared >= NUMERATOR * (len(x) + len(y) - shared)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def _labelled(rows: DataFrame, groups: DataFrame, doc: str = "doc") -> DataFrame:
    return rows.join(groups.withColumnRenamed("node", doc), doc, "left").withColumn("component", F.coalesce("component", doc))


def _asked(often: DataFrame, sizes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which documents ask which groups of several members, from the matrix of frequent shingles and groups; and all groups' members.

    often: ``token``, ``doc``, ``n``; sizes: ``doc``, ``n`` of all documents.
    """
    rows = _labelled(often, groups)
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = settled(split_join(rows, mixed, "token"), "matrix-rows")
    members = _labelled(sizes, groups).join(rows.select("component").distinct(), "component", "left_semi")
    members = settled(members.select("doc", "n", "component"), "members")
    of_group = members.groupBy("component").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    matrix = rows.select("token", F.col("component").alias("group")).distinct().join(of_group.where("size > 1").withColumnRenamed("component", "group"), "group")
    queries = rows.select("token", "doc", "n", "component").join(of_group.select("component", F.col("size").alias("own")), "component")
    # the smaller group asks the larger one
    asks = (F.col("component") != F.col("group")) & (F.struct("own", "component") < F.struct(F.col("size"), F.col("group")))
    possible = fits_any(F.col("n"), F.col("least"), F.col("most"))
    return settled(split_join(queries, matrix, "token").where(asks & possible).select("doc", "n", "group", "size").distinct(), "asked"), members


def _blocks(rows: DataFrame, by: list[str], name: str, size: int) -> DataFrame:
    """Rows (``by``, doc, n, sketch) packed into blocks of about ``size``."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_blocks"))
    placed = rows.join(counts, by).withColumn(f"{name}_block", F.pmod(F.xxhash64("doc"), "_blocks"))
    return placed.groupBy(*by, f"{name}_block").agg(F.collect_list(F.struct("doc", "n", "sketch")).alias(name))


def _near_in_blocks(pairs: DataFrame, fold=np.bitwise_xor) -> DataFrame:
    """From rows with two blocks ``x`` and ``y``, the pairs (a, b) whose sizes and sketches (or bit tables) allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                (dx, nx, mx), (dy, ny, my) = ([z.values.field(k) for k in range(3)] for z in (x, y))
                dx, nx, dy, ny = (z.to_numpy() for z in (dx, nx, dy, ny))
                near = fits(nx[:, None], ny[None, :]) & (dx[:, None] != dy[None, :])
                near &= all_apart(mx.to_pylist(), my.to_pylist(), fold) * (NUMERATOR + DENOMINATOR) <= (nx[:, None] + ny[None, :]) * (DENOMINATOR - NUMERATOR)
                i, j = np.nonzero(near)
                found = np.unique(np.stack([np.minimum(dx[i], dy[j]), np.maximum(dx[i], dy[j])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return pairs.select("x", "y").mapInArrow(run, "a long, b long")


def _tables(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, n, sketch) of the documents named, with the bit table of their shingles as ``sketch``; equal rows become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(r, len(t), bit_table(t)) for r, t in _sets(b.column(1))]
            row, n, bits = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], ["doc", "n", "sketch"])

    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc", "left_semi").mapInArrow(run, "doc long, n long, sketch binary").distinct()


def _unions(rows: DataFrame) -> DataFrame:
    """The union of the bit tables of each cell; rows: ``cell``, ``sketch``, of one size in a cell.  Every batch is added up before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None  # the cell that may go on in the next batch, where rows are sorted
        for b in batches:
            cell = b.column(0).to_numpy()
            order = np.argsort(cell, kind="stable")
            marks, found = b.column(1), []
            for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                both = np.bitwise_or.reduce([np.frombuffer(marks[int(k)].as_buffer(), np.uint64) for k in rows])
                if last is not None and last[0] == cell[rows[0]]:
                    both, last = both | last[1], None
                found.append((int(cell[rows[0]]), both))
            if last is not None:
                found.insert(0, last)
            last = found.pop() if found else None
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([u.tobytes() for _, u in found], pa.binary())], ["cell", "bits"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1].tobytes()], pa.binary())], ["cell", "bits"])

    kind = "cell long, bits binary"
    return rows.select("cell", "sketch").mapInArrow(add, kind).repartition("cell").sortWithinPartitions("cell").mapInArrow(add, kind)


def _bounded(asks: DataFrame, unions: DataFrame) -> DataFrame:
    """Of documents and the cells that they ask, those whose overlap with the cell's union of shingles allows a link with a member.

    asks: ``doc``, ``n``, ``cell``, ``sketch``; unions: ``cell``, ``bits``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            overlap = n - missing(b.column(3).to_pylist(), b.column(4).to_pylist())
            yield b.select(["doc", "n", "cell", "sketch"]).filter(pa.array(overlap * DENOMINATOR >= n * NUMERATOR))

    few = (unions.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= BROADCAST_BYTES
    rows = (asks.join(F.broadcast(unions), "cell") if few else split_join(asks, unions, "cell")).select("doc", "n", "cell", "sketch", "bits")
    return rows.mapInArrow(run, "doc long, n long, cell long, sketch binary")


def _lone_pairs(often: DataFrame, lone: DataFrame, sketches: DataFrame) -> DataFrame:
    """Near pairs (a, b) of documents that are groups of their own and show a frequent shingle in common.

    Sets that link differ in size by a factor of 5 / 4 at most, so rows lie in bands of (a little over) that width and a block
    meets those of its own band and the next one only.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(1.001 * np.log(DENOMINATOR / NUMERATOR)))
    rows = often.join(lone, "doc", "left_semi").select("token", "doc").join(sketches, "doc").withColumn("band", band)
    blocks = _blocks(rows, ["token", "band"], "x", BLOCK)
    other = blocks.withColumnsRenamed({"x": "y", "x_block": "y_block"})
    meets = other.select("token", "band", F.col("band").alias("own"), "y_block", "y").unionByName(other.select("token", F.col("band") - 1, F.col("band").alias("own"), "y_block", "y").toDF("token", "band", "own", "y_block", "y"))
    return _near_in_blocks(blocks.join(meets, ["token", "band"]).where("own > band OR x_block <= y_block"))


def _opened(often: DataFrame, asked: DataFrame, members: DataFrame, sketches: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """Near pairs (a, b) of documents and members of the groups that are opened, and of documents that are groups of their own.

    Askers and members of an opened group meet block by block.  A cell is what a group has of one size of bit tables.
    Either kind of pairs is written by a plan of its own.
    """
    lone = members.groupBy("component").agg(F.count("*").alias("k")).where("k = 1").select(F.col("component").alias("doc"))
    near = settled(_lone_pairs(often, lone, sketches).distinct(), "lone-pairs")
    if not asked.isEmpty():
        inside = members.join(asked.select(F.col("group").alias("component")).distinct(), "component").select("doc", F.col("component").alias("group"))
        tables = settled(_tables(docs, inside.select("doc").unionByName(asked.select("doc")).distinct()), "bit-tables")
        inside = inside.distinct().join(tables, "doc").withColumn("cell", F.xxhash64("group", F.octet_length("sketch")))
        cells = inside.groupBy("cell", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        asks = split_join(asked.select("doc", "n", "group").distinct(), cells, "group").where(fits_any(F.col("n"), F.col("least"), F.col("most")))
        asks = asks.select("doc", "n", "cell").join(tables, ["doc", "n"])
        bound = settled(_bounded(asks, settled(_unions(inside), "unions")), "bounded")
        opened = bound.select("cell").distinct()
        held = inside.join(F.broadcast(opened) if opened.count() <= BROADCAST_IDS else opened, "cell").select("cell", "doc", "n", "sketch")
        pairs = _near_in_blocks(split_join(_blocks(held, ["cell"], "y", BLOCK), _blocks(bound, ["cell"], "x", BLOCK // 4), "cell", "y_block"), np.bitwise_or)
        near = near.unionByName(settled(pairs.distinct(), "opened-pairs"))
    return near.distinct().join(known, ["a", "b"], "left_anti")


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` of every row."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    late = spark.sparkContext.broadcast(_frequent(docs))
    small = SMALL
    found = docs.mapInArrow(_show(late), SHOWN).repartition("token").sortWithinPartitions("token").mapInArrow(lambda batches: _meet(batches, small), FOUND)
    found = settled(found, "shown")
    equal = found.where(F.col("kind") == EDGE).select("a", "b")
    often = found.where(F.col("kind") == FREQUENT).select("token", F.col("a").alias("doc"), "n")
    centres = often.groupBy("token").agg(*[F.min_by(F.struct("doc", "n"), F.xxhash64("doc", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)])
    stars = split_join(often, centres.select("token", F.explode(F.array(*[f"c{k}" for k in range(CENTRES)])).alias("c")), "token").where(fits(F.col("n"), F.col("c.n")) & (F.col("doc") != F.col("c.doc")))
    stars = stars.select(F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b"))
    pairs = settled(found.where(F.col("kind") == PAIR).select("a", "b").unionByName(stars).distinct(), "candidates")
    marked = found.where((F.col("kind") == DOC) & F.col("sketch").isNotNull()).select(F.col("a").alias("doc"), "n", "sketch")
    sketches = settled(marked.distinct(), "sketches")
    repeated = sketches.count() < marked.count()

    def verified(near: DataFrame) -> DataFrame:
        near = settled(near, "near")
        return _verified(near, settled(_token_sets(docs, _ids(near), repeated), "token-sets"))

    groups = settled(components(settled(verified(_near(pairs, sketches)).unionByName(equal), "links")), "groups")
    asked, members = _asked(often, sketches.select("doc", "n").distinct(), groups)
    final = groups
    if not members.isEmpty():
        more = settled(verified(_opened(often, asked, members, sketches, docs, pairs)), "links")
        if not more.isEmpty():
            final = components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    rows = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc"), F.col("n").alias("n_shingles"))
    return _labelled(rows, final).select(F.col("doc").alias(key), "n_shingles", F.col("component").alias("component_id"))


def op3_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity components of all documents."""
    return similar_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, b AS reach FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.reach = e2.a),
c AS (SELECT node, min(reach) AS least FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON node = w.doc_id
"""
