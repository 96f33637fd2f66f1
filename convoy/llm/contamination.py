"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when the document holds at least ``threshold`` of
the item's distinct word shingles, however long the document is.  Items are put
in partitions by the size of their shingle set; each partition fixes how many of
the smallest shingle hashes its items show.  With ``k = n - ceil(threshold * n) + 1``
for the partition's largest ``n``, a document that misses them all misses too
much of the item to reach the threshold; so the candidates lose no match, and
each is then verified by exact shingle containment.

The index goes to the executors in blocks of at most ``BLOCK_SHINGLES`` shingles
(16 bytes each); a larger benchmark takes several passes over the documents, so
what is broadcast stays bounded and no document is shuffled.

Shingles: A-Z lower-cased, words outside 0x20 and 0x09-0x0D.  A text of fewer
words than a shingle has its whole sequence as its one shingle; a null or empty
text has none, matches nothing and is never dropped.  Equal documents and equal
items are each reported.  Null ids are kept as nulls; ids may be of any type.  Further
columns are dropped by ``matches`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import words as W
from convoy.llm.shared import settled, table

WIDTH, THRESHOLD = 5, 0.8
#: Shingles of the items that one pass holds in memory.
BLOCK_SHINGLES = 2_000_000


@dataclass
class Index:
    """Items of one block: their shingles, and the MinHash values that find them."""

    item: pa.Array  #: item ids
    first: np.ndarray  #: first shingle of each item
    shingle: np.ndarray  #: sorted distinct shingles, item after item
    need: np.ndarray  #: shingles that make a match
    value: np.ndarray  #: MinHash values, sorted
    owner: np.ndarray  #: the item that shows each value
    seen: np.ndarray  #: which low bits occur among the values


def need_of(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.maximum(1, np.ceil(n * threshold - 1e-9)).astype(np.int64)


def build_index(ids: pa.Array, texts: pa.Array, width: int = WIDTH, threshold: float = THRESHOLD) -> Index:
    item, sets = [], []
    for w in W.words(texts, lower=True):
        shingle, first = W.shingles(w, width)
        for k in range(len(first) - 1):
            if first[k] < first[k + 1]:
                item.append(w.rows.start + k)
                sets.append(np.unique(shingle[first[k] : first[k + 1]]))
    sizes = np.array([len(x) for x in sets], np.int64)
    value, owner = [], []
    partition = np.floor(np.log(np.maximum(sizes, 1)) / math.log(1.5)).astype(int)
    for p in np.unique(partition):
        members = np.flatnonzero(partition == p)
        largest = sizes[members].max()
        show = int(largest - need_of(largest, threshold) + 1)
        for k in members:
            order = np.argsort(W.mix(sets[k], 41))[:show]
            value.append(sets[k][order])
            owner.append(np.full(len(order), k))
    value = np.concatenate(value) if value else np.zeros(0, np.uint64)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(value, kind="stable")
    bits = min(26, max(10, int(16 * len(value)).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[(value & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return Index(ids.take(pa.array(item, pa.int64())), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat, need_of(sizes, threshold), value[order], owner[order], seen)


def search(index: Index, texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(row, item number, shared shingles) of each match in a batch of texts."""
    if not len(index.value):
        return
    for w in W.words(texts, lower=True):
        shingle, first = W.shingles(w, width)
        maybe = np.flatnonzero(index.seen[(shingle & np.uint64(len(index.seen) - 1)).astype(np.int64)])
        low, high = np.searchsorted(index.value, shingle[maybe]), np.searchsorted(index.value, shingle[maybe], "right")
        hit = np.flatnonzero(high > low)
        doc = np.searchsorted(first, maybe[hit], "right") - 1
        pairs = {(d, int(k)) for d, a, b in zip(doc.tolist(), low[hit].tolist(), high[hit].tolist(), strict=True) for k in index.owner[a:b]}
        own, of = np.zeros(0, np.uint64), -1
        for d, k in sorted(pairs):
            if d != of:
                own, of = np.unique(shingle[first[d] : first[d + 1]]), d
            wanted = index.shingle[index.first[k] : index.first[k + 1]]
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[place] == wanted).sum())
            if shared >= index.need[k]:
                yield w.rows.start + d, k, shared


def blocks(items: DataFrame, item: str, text: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The items in blocks of bounded size, one block in the driver at a time."""
    sized = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = sized.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    n = max(1, math.ceil(total / 2 / BLOCK_SHINGLES))  # a shingle starts at a word, and that takes two bytes
    for k in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k)
        rows = part.toArrow()
        yield rows.column("i").combine_chunks(), rows.column("t").combine_chunks()


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: ids, item shingles, shared shingles, containment.

    The ids keep their columns' names; where both have the same, the item's is called ``item_`` and that."""
    spark, named = docs.sparkSession, item if item != key else f"item_{item}"
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{named}` {kinds[1]}, n_item_shingles long, n_shared long, containment double"
    out = None
    for ids, texts in blocks(items, item, item_text):
        index = spark.sparkContext.broadcast(build_index(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                found = list(search(ix, b.column(1)))
                row, k, shared = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
                n = np.diff(ix.first)[k]
                names = [key, named, "n_item_shingles", "n_shared", "containment"]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), ix.item.take(pa.array(k)), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array(shared / np.maximum(n, 1))], names)

        part = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns; nothing is shuffled.

    What one block of items leaves is written before the next goes over it, so that a task holds one block's index."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for number, (ids, texts) in enumerate(blocks(items, item, item_text)):
        docs = settled(docs, "uncontaminated") if number else docs
        index = spark.sparkContext.broadcast(build_index(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _, _ in search(index.value, b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document that holds four fifths of its shingles."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = """
    SELECT DISTINCT {id}, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
          FROM (SELECT {id}, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0)
"""
ORACLE_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", lower=_LOWER, table="documents")}),
     b AS ({_SHINGLES.format(id="item_id", lower=_LOWER, table="benchmark")}),
     n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS k FROM b JOIN d USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, k AS n_shared, k / CAST(n AS DOUBLE) AS containment
FROM m JOIN n USING (item_id) WHERE 10 * k >= 8 * n
"""
