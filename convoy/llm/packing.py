"""Packing documents into sequences of equal length and about equal cost.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays within a
piece.  Documents are cut into pieces of a whole sequence and a rest.  Pieces go by
descending cost, each to the sequence of lowest cost that has room for it; where none has,
the cheapest with any room takes as much as it holds, and what is left goes on as a
piece of its own.  Sequences are laid out beforehand so that their room is what the pieces need: whole ones,
and for the remainder one for each power of two in it.  So no sequence is padded.

Documents are encoded where they are read and dealt, as ids, by a hash of key and ids to
groups of some two million tokens; each group is packed on its own.  So a task holds one
group's ids (two or four bytes each), the mix of a group is that of the corpus, and the result does not depend
on how the input is split into files.  A group that comes out far larger (one key on a large share of the
rows) is packed in parts of the same bound; rows without a key are dealt by where they are read.

Nulls: a null text has the end id only; a null key is packed like others.  Repeated rows
are packed once each.  An empty table gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm.shared import table
from convoy.llm.token_files import encoder

#: Tokens of a sequence.
SEQUENCE = 4096
#: Cost of a token, and of a pair of tokens that attend to each other: a layer of width 1024 takes 24 * 1024 ** 2 operations a token
#: and 4 * 1024 for each token that it looks at.
LINEAR, QUADRATIC = 1.0, 1 / 6144
#: Bytes of text that make a group, on average, and tokens at which a larger one is parted.
GROUP_BYTES, GROUP_TOKENS = 8 << 20, 8 << 20
#: Sequence numbers that each group has.
NUMBERS = 1 << 32


def rooms(tokens: int, sequence: int = SEQUENCE) -> np.ndarray:
    """Lengths of the sequences that hold so many tokens without padding."""
    full, rest = divmod(tokens, sequence)
    return np.array([sequence] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def pack(sizes: np.ndarray, sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) of every piece, by sequence and offset; sizes: tokens of each document."""
    room = rooms(int(sizes.sum()), sequence)
    length, cost = room.copy(), np.zeros(len(room))
    pieces = [(-min(sequence, n - s), d, s) for d, n in enumerate(sizes.tolist()) for s in range(0, n, sequence)]
    heapq.heapify(pieces)  # longest first; of one length the first document
    out = []
    while pieces:
        size, d, s = heapq.heappop(pieces)
        size = -size
        fits = np.flatnonzero(room >= size)
        if not len(fits):
            fits = np.flatnonzero(room)
        to = int(fits[np.argmin(cost[fits])])
        take = min(size, int(room[to]))
        out.append((d, s, take, to, int(length[to] - room[to])))
        room[to] -= take
        cost[to] += linear * take + quadratic * take * take
        if take < size:
            heapq.heappush(pieces, (take - size, d, s + take))
    rows = np.array(out, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 4], rows[:, 3]))]


def encoded(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """``k`` and ``ids``, the document's ids and the end id as little-endian integers of ``width`` bytes."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        for b in batches:
            for w in tok.cut(b.column(1)):
                own, size = tok.encode(w)
                own = np.insert(own, np.cumsum(size), end_id).astype(f"<u{width}")
                at = np.concatenate([[0], np.cumsum(size + 1)]) * width
                ids = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.rows.start, w.rows.stop - w.rows.start), ids.cast(pa.binary())], ["k", "ids"])

    return rows.mapInArrow(run, "k long, ids binary")


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def packed(df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, width: int = 2, sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """A row for every piece: key, where it starts in its document, length, crc32 of its ids as 32-bit integers, the document's
    tokens, sequence, offset there, and cost.  ``width``: bytes of an id, 2 where the vocabulary has at most 65,536."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + 8 * F.count("*")).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = encoded(df, key, text, tokenizer, end_id, width)
    salt = F.when(F.col("k").isNull(), F.monotonically_increasing_id())
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("k", "ids", salt), F.lit(groups)))
    # a group's rows come one after the other, in an order that the rows alone decide
    dealt = dealt.repartition("g").sortWithinPartitions("g", "k", F.crc32("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held, tokens = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, tokens
            sizes = np.array([len(ids) // width for _, ids in held], np.int64)
            rows = pack(sizes, sequence, linear, quadratic)
            d, start, length, to, offset = rows.T
            crc = [zlib.crc32(np.frombuffer(held[i][1], f"<u{width}", n, s * width).astype("<u4")) for i, s, n in rows[:, :3].tolist()]
            keys = pa.array([held[i][0] for i in d.tolist()], pa.int64())
            out = [keys, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[d]), pa.array(group * NUMBERS + number + to), pa.array(offset), pa.array(linear * length + quadratic * length * length)]
            number += int(to[-1]) + 1
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays(out, [key, *[c.split()[0] for c in PIECE.split(", ")]])

        for b in batches:
            gs = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(gs[1:] != gs[:-1]) + 1).tolist(), len(gs)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if int(gs[i]) != group:
                    if held:
                        yield flush()
                    group, number = int(gs[i]), 0
                for k, ids in zip(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist(), strict=True):
                    held.append((k, ids))
                    tokens += len(ids) // width
                    if tokens >= GROUP_TOKENS:
                        yield flush()
        if held:
            yield flush()

    return dealt.mapInArrow(run, f"`{key}` long, {PIECE}")


def sequences(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Per sequence its pieces, tokens and cost, and the padding that it needs: none at a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"), F.sum("cost").alias("cost"))
    return rows.withColumn("padding", F.when(F.bit_count("tokens") == 1, F.lit(0).cast("long")).otherwise(F.lit(sequence) - F.col("tokens")))


def pack_documents(docs: DataFrame) -> DataFrame:
    """All documents in sequences of 4096 tokens of the 49k word vocabulary, each with end id 2."""
    import public_tokenizers

    return packed(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))
