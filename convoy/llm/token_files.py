"""Token-id files with a minimal perfect hash index.

A file holds the raw ids of a run of documents in ascending key order, then the
documents' keys and offsets, then an index: a minimal perfect hash from each
distinct key to its first entry, with a 32-bit fingerprint per slot, so that one
probe finds a document's ids or tells that the key is absent.

Layout, little-endian: ids (2 or 4 bytes each) | keys int64 | key present uint8 |
offsets uint64, one more than entries | run lengths uint32 | displacements int64 |
slot entries uint32 | slot fingerprints uint32 | footer: ten uint64 (magic,
version, id width, entries, ids, distinct keys, displacements, three zeros).

Spark range-partitions and sorts the documents by key; each task streams its rows
into files of bounded size, written under a temporary name and renamed, so a
task that runs again leaves the same files.  The manifest is a table.  Paths go
through pyarrow's file systems, so the folder can be any that it opens.  Files are
read back, and keys looked up, by as many tasks as there are files, up to some a core.

Nulls: a null text has no ids of its own (only the end id); a null key is an
entry that sorts first; looked up, it is not found.  Repeated keys are consecutive
entries of one slot, and may go on in the next file.  An empty table gives no
files.  Other columns are not stored.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.llm import words as W
from convoy.llm.shared import fresh_dir, settled, table

MAGIC = int.from_bytes(b"CONVOYID", "little")
FOOTER = 80
#: A file is closed at so many ids or entries.
FILE_IDS, FILE_ENTRIES = 8 << 20, 100_000
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 1_000_000
#: Words that the library encodes at once; bounds its results, which take a kilobyte or two each.
SLICE = 2048
#: Bytes of text cut at once; the larger, the fewer look-ups of words that repeat, and the more memory (some sixty times as much).
CHUNK = 1 << 20
#: Tasks per core that read files, at most; files whose first keys a look-up broadcasts at once (8 bytes each).
READ_TASKS, BROADCAST_FILES = 8, 1_000_000
#: A fixed value: how a tokenizer's pattern says that letters stand apart from all else.
LETTER_RUNS = r"[\p{L}]+|"


# ---- minimal perfect hash -------------------------------------------------


def _hash(key: np.ndarray, valid: np.ndarray, seed: int) -> np.ndarray:
    return W.mix(np.where(valid, key.astype(np.int64).view(np.uint64), np.uint64(0x5BD1E995)) ^ valid.astype(np.uint64), seed)


def _slots(own: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (W.mix(own ^ W.mix(displacement.astype(np.uint64), 5), 6) % np.uint64(n)).astype(np.int64)


def build_index(key: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement per bucket, and the slot of each of the distinct keys: hash and displace.

    Buckets of several keys go first, by size, each at the first displacement
    that sends its keys to free slots; single keys then take the free slots
    left, written as negative displacements.
    """
    n = len(key)
    buckets = max(1, (n + 3) // 4)
    own = _hash(key, valid, 1)
    bucket = (_hash(key, valid, 2) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(first)
    out, slot, taken = np.zeros(buckets, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        members = order[first[b] : first[b + 1]]
        d = 1
        while True:
            trial = np.arange(d, d + 64)
            at = _slots(own[members][None, :].repeat(64, 0), trial[:, None].repeat(size[b], 1), n)
            ranked = np.sort(at, 1)
            good = ~taken[at].any(1) & (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                out[b], slot[members] = trial[k], at[k]
                taken[at[k]] = True
                break
            d += 64
    free = iter(np.flatnonzero(~taken).tolist())
    for b in np.flatnonzero(size == 1):
        s = next(free)
        out[b], slot[order[first[b]]] = -1 - s, s
    return out, slot


# ---- one file ------------------------------------------------------------


def encode_file(key: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
    entry = np.flatnonzero(new)
    runs = np.diff(np.concatenate([entry, [n]]))
    displacement, slot = build_index(key[entry], valid[entry])
    slots, prints = np.zeros(len(entry), "<u4"), np.zeros(len(entry), "<u4")
    slots[slot] = entry
    prints[slot] = _hash(key[entry], valid[entry], 3) & np.uint64(0xFFFFFFFF)
    length = np.zeros(n, "<u4")
    length[entry] = runs
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    footer = np.array([MAGIC, 1, width, n, len(ids), len(entry), len(displacement), 0, 0, 0], "<u8")
    parts = [ids.astype(f"<u{width}"), key.astype("<i8"), valid.astype("u1"), offsets, length, displacement.astype("<i8"), slots, prints, footer]
    return b"".join(p.tobytes() for p in parts)


class TokenFile:
    """Keyed access to one file."""

    def __init__(self, source: io.RawIOBase | pa.NativeFile, size: int):
        self.source = source
        source.seek(size - FOOTER)
        magic, _, self.width, self.n, self.n_ids, distinct, buckets, *_ = np.frombuffer(source.read(FOOTER), "<u8").astype(np.int64).tolist()
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(self.n_ids * self.width)
        raw, self._at = source.read(size - FOOTER - self.n_ids * self.width), 0
        take = lambda kind, count: self._take(raw, kind, count)
        self.key, self.valid, self.offsets = take("<i8", self.n), take("u1", self.n).astype(bool), take("<u8", self.n + 1).astype(np.int64)
        self.runs, self.displacement = take("<u4", self.n), take("<i8", buckets)
        self.slots, self.prints = take("<u4", distinct), take("<u4", distinct)

    def _take(self, raw: bytes, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(raw, kind, count, self._at)
        self._at += out.nbytes
        return out

    def find(self, key: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        """First entry of each key, or -1: one probe each."""
        key = np.asarray(key, np.int64)
        valid = np.ones(len(key), bool) if valid is None else valid
        if not len(self.slots):
            return np.full(len(key), -1, np.int64)
        d = self.displacement[(_hash(key, valid, 2) % np.uint64(len(self.displacement))).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, _slots(_hash(key, valid, 1), np.maximum(d, 0), len(self.slots)))
        entry = self.slots[slot].astype(np.int64)
        hit = self.prints[slot] == (_hash(key, valid, 3) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        hit &= (self.key[entry] == key) & (self.valid[entry] == valid)
        return np.where(hit, entry, -1)

    def ids(self, entry: int) -> np.ndarray:
        start, stop = int(self.offsets[entry]), int(self.offsets[entry + 1])
        self.source.seek(start * self.width)
        return np.frombuffer(self.source.read((stop - start) * self.width), f"<u{self.width}")

    def all_ids(self) -> np.ndarray:
        self.source.seek(0)
        return np.frombuffer(self.source.read(self.n_ids * self.width), f"<u{self.width}")


def open_path(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# ---- encoding ------------------------------------------------------------


class WordEncoder:
    """Ids of texts, for tokenizers that treat what ASCII white space parts on its own and drop it.

    Distinct words go through the library once per worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fold = "Lowercase" in steps and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        self.marks = any(LETTER_RUNS in s.get("pattern", {}).get("Regex", "") for s in spec["pre_tokenizer"].get("pretokenizers", []))
        self.clear()

    def cut(self, texts: pa.Array) -> Iterator[W.Words]:
        """Words as the library would part them anyway: marks behind letters on their own and, if
        it lower-cases everything but its special tokens, A-Z lower-cased where no such token can be."""
        special = self.fold and pc.any(pc.match_substring(texts, "<|")).as_py()
        return W.words(texts, lower=self.fold and not special, marks=self.marks, chunk=CHUNK)

    def clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, code: np.ndarray, texts: list[str]) -> None:
        if len(self.known) + len(code) > CACHE_WORDS:
            self.clear()
        got = [e.ids for k in range(0, len(texts), SLICE) for e in self.library.encode_batch_fast(texts[k : k + SLICE], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        number = np.arange(len(got)) + len(self.first) - 1
        self.flat = np.concatenate([self.flat, np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        keys, values = np.concatenate([self.known, code]), np.concatenate([self.number, number])
        order = np.argsort(keys, kind="stable")
        self.known, self.number = keys[order], values[order]

    def encode(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents, one after the other, and how many each has."""
        distinct, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[place] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            if len(self.known) + len(new) > CACHE_WORDS:  # all of this chunk's words have to be known at once
                self.clear()
                new = np.arange(len(distinct))
            raw = w.data.tobytes()
            self._add(distinct[new], [raw[a:b].decode() for a, b in zip(w.start[one[new]].tolist(), w.end[one[new]].tolist(), strict=True)])
        number = self.number[np.searchsorted(self.known, distinct)][back] if len(distinct) else np.zeros(0, np.int64)
        size = self.first[number + 1] - self.first[number]
        stop = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[number] - stop[:-1], size) + np.arange(stop[-1])]
        return ids, np.diff(stop[w.first])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---- jobs -----------------------------------------------------------------

#: ``first_key`` is null where the file begins with a null key.
MANIFEST = "file string, part int, number int, first_key long, entries long, ids long"


def write(df: DataFrame, key: str, text: str, tokenizer: str, folder: str, end_id: int | None = None, width: int = 2, partitions: int | None = None) -> DataFrame:
    """Writes the files of all rows in ascending key order; returns the manifest.

    ``width``: bytes of an id, 2 where the vocabulary has at most 65,536.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(partitions, "k") if partitions else rows.repartitionByRange("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        valid: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            k, v, n, all_ids = (np.concatenate(x) for x in (keys, valid, lengths, ids))
            target = f"{folder}/part-{part:06d}-{number:04d}.ids"
            store, path = open_path(target)
            store.create_dir(os.path.dirname(path), recursive=True)
            own = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
            with store.open_output_stream(own) as out:
                out.write(encode_file(k, v, n, all_ids, width))
            store.move(own, path)
            row = [[target], [part], [number], [int(k[0]) if v[0] else None], [len(k)], [len(all_ids)]]
            number += 1
            for x in (keys, valid, lengths, ids):
                x.clear()
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["file", "part", "number", "first_key", "entries", "ids"])

        for b in batches:
            for w in tok.cut(b.column(1)):
                own, size = tok.encode(w)
                if end_id is not None:
                    own = np.insert(own, np.cumsum(size), end_id)
                    size = size + 1
                k = b.column(0).slice(w.rows.start, w.rows.stop - w.rows.start)
                keys.append(pc.fill_null(k, 0).to_numpy(zero_copy_only=False).astype(np.int64))
                valid.append(pc.is_valid(k).to_numpy(zero_copy_only=False))
                lengths.append(size)
                ids.append(own.astype(f"<u{width}"))
                if sum(map(len, ids)) >= FILE_IDS or sum(map(len, keys)) >= FILE_ENTRIES:
                    yield flush()
        if keys:
            yield flush()

    # a row per file: few enough for one table file, whatever the number of tasks that write
    manifest = settled(rows.sortWithinPartitions("k", "t").mapInArrow(run, MANIFEST).repartition(1), "token-manifest")
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(Window.orderBy("part")).alias("_base"))  # a row per writing task
    return manifest.join(parts, "part").withColumn("base", F.col("_base") + before(Window.partitionBy("part").orderBy("number"))).drop("_base")


def _tasks(spark: SparkSession, files: int) -> int:
    return max(1, min(files, READ_TASKS * spark.sparkContext.defaultParallelism))


def read(manifest: DataFrame, key: str) -> DataFrame:
    """Key, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files, each looked up in its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, local = open_path(path)
                with store.open_input_file(local) as source:
                    f = TokenFile(source, source.size())
                    entry = f.find(f.key, f.valid)
                    run_first = np.maximum.accumulate(np.where(f.runs > 0, np.arange(f.n), 0))
                    if not np.array_equal(entry, run_first):
                        raise ValueError(f"index of {path} does not fit its keys")
                    ids = f.all_ids()
                at = f.offsets.tolist()
                crc = [zlib.crc32(ids[i:j].astype("<u4")) for i, j in zip(at, at[1:], strict=False)]
                out = [pa.array(f.key, mask=~f.valid), pa.array(base + f.offsets[:-1]), pa.array(np.diff(f.offsets)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, [key, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "base")
    files = files.repartitionByRange(_tasks(manifest.sparkSession, manifest.count()), "file")
    return files.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Ids of the given keys: each is sent to the files whose key range holds it (as a rule one), and probed there.

    The first keys of all files are broadcast, in blocks; each block is a pass over the keys.
    """
    wanted = keys.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    order = Window.partitionBy("_block").orderBy("part", "number")
    files = manifest.select("part", "number", "first_key", "file").withColumn("_block", F.floor(F.col("part") / BROADCAST_FILES))
    total, placed = manifest.count(), None
    blocks = [r[0] for r in files.select("_block").distinct().orderBy("_block").collect()]
    ranked = files.withColumn("_n", F.row_number().over(order) - 1)
    for block in blocks:
        own = ranked.where(F.col("_block") == block)
        first = pc.fill_null(own.orderBy("_n").select("first_key").toArrow().column(0), -(1 << 63)).to_numpy()
        part = _placed(wanted, spark.sparkContext.broadcast(first)).join(own.select("_n", "file"), "_n").select("file", "k")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        return spark.createDataFrame([], f"`{key}` long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, source = None, None, None
        for b in batches:
            files_of = b.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(files_of)) if files_of[i] != files_of[i - 1]], len(files_of)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if files_of[i] != path:
                    if source is not None:
                        source.close()
                    path = files_of[i]
                    store, local = open_path(path)
                    source = store.open_input_file(local)
                    f = TokenFile(source, source.size())
                ks = b.column(1).slice(i, j - i).to_numpy()
                entry = f.find(ks)
                found = [(k, f.ids(e + n).tolist()) for k, e in zip(ks.tolist(), entry.tolist(), strict=True) if e >= 0 for n in range(int(f.runs[e]))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], [key, "ids"])
        if source is not None:
            source.close()

    placed = placed.repartition(_tasks(spark, total), "file").sortWithinPartitions("file", "k")
    return placed.mapInArrow(run, f"`{key}` long, ids array<int>")


def _placed(wanted: DataFrame, ranges) -> DataFrame:
    """(_n, k) for every key and each file, by its number, of a block whose range may hold it; ranges: the files' first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = ranges.value
        for b in batches:
            k = b.column(0).to_numpy()
            # a key that begins files may also end the one before them
            low = np.maximum(np.searchsorted(first, k, "left") - 1, 0)
            count = np.searchsorted(first, k, "right") - low
            count[count < 0] = 0
            which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.repeat(k, count))], ["_n", "k"])

    return wanted.mapInArrow(run, "_n int, k long")


def encode_documents(docs: DataFrame) -> DataFrame:
    """Writes all documents with the 49k word vocabulary and end id 1, and reads them back."""
    import public_tokenizers

    folder = fresh_dir(docs.sparkSession, "token-files")
    manifest = write(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return read(manifest, "doc_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to indexed files and read back from them."""
    return encode_documents(table(spark, sf_dir, "documents"))
