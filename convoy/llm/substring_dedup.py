"""Substring dedup by recompression.

A document's words are recompressed in rounds: maximal runs of one symbol get a
name of their own, then neighbours whose names' coins say left and right are
paired; symbols over a round's length stand aside.  Names are hashes of what they
stand for, so every task names the same runs and pairs alike, equal passages get
the same symbols inside, and no round needs a shuffle.

1.  Long repeats: after all rounds (``HIGH_ROUNDS``) symbols hold some tens of words.
    One shuffle brings the occurrences of each symbol of at least a window together,
    verified by a second hash over its words.  Where it also stands in a smaller
    document, all windows inside are removed at once.
2.  Short repeats and what is left: after two rounds (``ROUNDS``) symbols are small
    enough to be settled within a window: each carries the stretch of words that
    settled how it was made, and wherever those words occur the same symbol arises.
    Each window is filed under the settled symbol of least name inside it (or under
    itself where none is), and consecutive windows of one symbol make a stretch.
    Stretches inside a long symbol go on only from the smallest document that has it.

A second shuffle brings the stretches of a symbol together.  A stretch that also occurs
in a smaller document is removed there and then.  The others of symbols that occur
in different surroundings are opened: their single windows are compared.  A window
whose symbol occurs in one surrounding only has no copy.  Symbols that are frequent in
a bounded sample of documents are split over tasks by stretch, and always opened; that
sets cost, never results.  Every task first settles what repeats within its own batch,
so a passage of very many documents sends one row per batch.  Names of windows have
128 bits, those of long symbols and stretches 64 beside the 64 of their key.

Null and empty texts have no words.  A null key neither gives nor loses windows.
Texts that repeat under one key are told apart by a checksum and do not count
against each other.  Windows are judged on the input.  Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import words as W
from convoy.llm.shared import settled, table

WINDOW = 13
#: Longest symbol, in words, that takes part in each round: of the rounds whose symbols a window settles, and of those that follow.
ROUNDS, HIGH_ROUNDS = (1, 1), (4, 4, 8, 8, 16, 16, 32, 32, 32)
#: A symbol is frequent if it files one in so many stretches of the sample, and LEAST_HOT at least; there are as many frequent ones at most (8 bytes each).
HOT_SHARE, LEAST_HOT = 1000, 64
#: The sample: one document in SAMPLE_PART, of SAMPLE_LEAST documents at least and SAMPLE_MOST at most; tasks that share a frequent symbol.
SAMPLE_PART, SAMPLE_LEAST, SAMPLE_MOST, SPLIT = 16, 4000, 200_000, 64


@dataclass
class Symbols:
    """Symbols of a chunk in order: name, words ``start:end``, words ``low:high`` that settle it, document."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray

    def pick(self, keep: np.ndarray) -> Symbols:
        return Symbols(*[getattr(self, f)[keep] for f in self.__dataclass_fields__])


def _beside(s: Symbols, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol, where its left neighbour's settling words begin and its right neighbour's end;
    at a document's edges, a place outside it."""
    left, right = np.empty_like(s.low), np.empty_like(s.high)
    left[1:], right[:-1] = s.low[:-1], s.high[1:]
    edge = np.ones(len(s.doc) + 1, bool)
    edge[1:-1] = s.doc[1:] != s.doc[:-1]
    left[edge[:-1]] = first[s.doc[edge[:-1]]] - 1
    right[edge[1:]] = first[s.doc[edge[1:]] + 1] + 1
    return left, right


def _name_runs(s: Symbols, cap: int, first: np.ndarray) -> Symbols:
    able = s.end - s.start <= cap
    same = (s.name[1:] == s.name[:-1]) & (s.doc[1:] == s.doc[:-1]) & able[1:] & able[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.concatenate([begin, [len(s.name)]]))
    last = begin + size - 1
    name = np.where(size > 1, W.mix(s.name[begin] ^ W.mix(size.astype(np.uint64), 21), 22), s.name[begin])
    left, right = _beside(s, first)  # what stands next to the run's ends shows that it goes no further
    low = np.where(able[begin], np.minimum(s.low[begin], left[begin]), s.low[begin])
    high = np.where(able[last], np.maximum(s.high[last], right[last]), s.high[last])
    return Symbols(name, s.start[begin], s.end[last], low, high, s.doc[begin])


def _name_pairs(s: Symbols, cap: int, first: np.ndarray, seed: int) -> Symbols:
    able = s.end - s.start <= cap
    coin = (W.mix(s.name, 100 + seed) >> np.uint64(63)).astype(bool)
    is_left, is_right = able & ~coin, able & coin
    joins = np.zeros(len(s.name), bool)
    joins[:-1] = is_left[:-1] & is_right[1:] & (s.doc[1:] == s.doc[:-1])
    joined = np.concatenate([[False], joins[:-1]])
    left, right = _beside(s, first)
    low = np.where(is_right & ~joined, np.minimum(s.low, left), s.low)
    high = np.where(is_left & ~joins, np.maximum(s.high, right), s.high)
    name, end = s.name.copy(), s.end.copy()
    at = np.flatnonzero(joins)
    name[at] = W.rolling(np.stack([s.name[at], s.name[at + 1]], 1).ravel(), 2, 200 + seed)[::2] if len(at) else name[at]
    end[at], high[at] = s.end[at + 1], high[at + 1]
    return Symbols(name, s.start, end, low, high, s.doc).pick(~joined)


def recompress(w: W.Words, rounds: tuple[int, ...] = ROUNDS) -> Symbols:
    """The symbols of a chunk of documents after the first rounds."""
    place = np.arange(len(w.hash))
    s = Symbols(w.hash, place, place + 1, place, place + 1, np.repeat(np.arange(len(w.first) - 1), np.diff(w.first)))
    return climb(s, w.first, rounds, 0)


def climb(s: Symbols, first: np.ndarray, rounds: tuple[int, ...] = HIGH_ROUNDS, seed: int = len(ROUNDS)) -> Symbols:
    """The symbols after further rounds, each naming runs and pairs of the symbols of the one before."""
    for k, cap in enumerate(rounds):
        if len(s.name):
            s = _name_pairs(_name_runs(s, cap, first), cap, first, seed + k)
    return s


class Ranges:
    """Hashes of any run of words of a chunk."""

    def __init__(self, code: np.ndarray, seed: int):
        self.up, self.down = W.powers(len(code) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(W.mix(code, seed) * self.up[: len(code)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return W.mix((self.total[end] - self.total[start]) * self.down[start] ^ W.mix((end - start).astype(np.uint64), 31), 32)


@dataclass
class Cut:
    """Stretches of a chunk: symbol key, hash of the stretch, document, first window within it, windows, and the long symbol around it or -1;
    and the long symbols: name, hash of the words, document, first window within it, windows."""

    key: np.ndarray
    code: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    within: np.ndarray
    long: tuple[np.ndarray, ...]


def stretches(w: W.Words, width: int = WINDOW, rounds: tuple[int, ...] = ROUNDS) -> Cut:
    s = recompress(w, rounds)
    top = climb(s, w.first)
    top = top.pick(top.end - top.start >= width)
    s = s.pick(s.high - s.low <= width)
    count = np.maximum(np.diff(w.first) - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + w.first[doc]
    # settled symbols inside a window are neighbours: those that end settling soon enough, from the first that starts late enough
    a = np.searchsorted(s.low, window)
    b = np.searchsorted(s.high, window + width, "right")
    prio = W.mix(s.name, 300)
    best, choice = np.full(len(window), np.iinfo(np.uint64).max), np.full(len(window), -1)
    for k in range(int((b - a).max(initial=0))):
        at = np.minimum(a + k, max(len(prio) - 1, 0))
        better = (a + k < b) & (prio[at] < best)
        best[better], choice[better] = prio[at[better]], at[better]
    around = np.searchsorted(top.start, window, "right") - 1
    if len(top.start):
        around[window + width > top.end[np.maximum(around, 0)]] = -1
    new = np.ones(len(window), bool)
    new[1:] = (choice[1:] != choice[:-1]) | (choice[1:] < 0) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(window)]]))
    start, own, sym = window[begin], doc[begin], choice[begin]
    within = np.where(around[begin] == around[begin + size - 1], around[begin], -1)  # stretches stay whole, so that they are cut alike everywhere
    ranges = Ranges(w.hash, 30)
    inside = sym >= 0
    at = np.maximum(sym, 0)
    if len(s.low):
        low, high, shift = np.where(inside, s.low[at], start), np.where(inside, s.high[at], start + width), np.where(inside, s.start[at] - s.low[at], 0)
    else:
        low, high, shift = start, start + width, np.zeros(len(start), np.int64)
    key = W.mix(ranges.of(low, high) ^ W.mix(shift.astype(np.uint64), 33), 34)
    code = W.mix(ranges.of(start, start + size - 1 + width) ^ W.mix((low - start).astype(np.uint64), 35), 36)
    long = (top.name, ranges.of(top.start, top.end), top.doc, top.start - w.first[top.doc], top.end - top.start - width + 1)
    return Cut(key, code, own, start - w.first[own], size, within, long)


# ---- rows ------------------------------------------------------------------

_SIZE, _TAG = 8, 24
_MOST = (1 << _SIZE) - 1


def _pack(start: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """First window, windows (below 256) and the text's checksum in one number."""
    return (start.astype(np.int64) << (_SIZE + _TAG)) | (size.astype(np.int64) << _TAG) | tag.astype(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> (_SIZE + _TAG), (packed >> _TAG) & ((1 << _SIZE) - 1), packed & ((1 << _TAG) - 1)


def _tags(w: W.Words) -> np.ndarray:
    """Checksum of each document's words."""
    whole = Ranges(w.hash, 40).of(w.first[:-1], w.first[1:])
    return (whole & np.uint64((1 << _TAG) - 1)).astype(np.int64)


def _settle_batch(key: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows repeat a stretch of a smaller document of the same batch."""
    order = np.lexsort((doc, code, key))
    k, c, d = key[order], code[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else d
    out = np.zeros(len(k), bool)
    out[order] = d > least
    return out


ROWS = "key long, code long, doc long, pos long, state int"
#: States of a row of stretches: to be judged, removed already, and of a frequent symbol.
OPEN, DONE, HOT = 0, 1, 2
LONG = "key long, code long, doc long, pos long, size long, state int, inside binary"
#: A stretch inside a long symbol: symbol key, hash, first window within the long symbol, windows, state.
INSIDE = np.dtype([("key", "<u8"), ("code", "<u8"), ("at", "<u4"), ("size", "u1"), ("state", "u1")])


def _chunks(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[tuple]:
    """Stretches of texts with a key, cut to pieces of a bounded number of windows and with frequent symbols split; and the documents' ids and checksums."""
    for b in batches:
        valid, ids = pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False), pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
        for w in W.words(b.column(1)):
            cut = stretches(w)
            state = np.zeros(len(cut.key), np.int32)
            if len(hot):
                often = hot[np.minimum(np.searchsorted(hot, cut.key), len(hot) - 1)] == cut.key
                state[often] = HOT
                cut.key[often] = W.mix(cut.key[often] ^ W.mix(cut.code[often] % np.uint64(SPLIT), 53), 54)
            yield cut, state, valid[w.rows], ids[w.rows], _tags(w)


def _rows(key: np.ndarray, code: np.ndarray, doc: np.ndarray, pos: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    """Rows of stretches; those that are removed already go under a key of their own."""
    key = np.where(state == DONE, W.mix(doc.view(np.uint64) ^ W.mix(pos.view(np.uint64), 51), 52), key)
    cols = (key.view(np.int64), code.view(np.int64), doc, pos, state.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "code", "doc", "pos", "state"])


def _cut_outside(hot):
    """Stretches of texts that are not inside a long symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, state, valid, ids, tags in _chunks(batches, hot.value):
            keep = valid[cut.doc] & (cut.within < 0)
            key, code, own, start, size, state = (x[keep] for x in (cut.key, cut.code, cut.doc, cut.start, cut.size, state))
            doc, pos = ids[own], _pack(start, size, tags[own])
            yield _rows(key, code, doc, pos, np.where(_settle_batch(key, code, doc), DONE, state))

    return run


def _cut_long(hot):
    """Long symbols of texts with the stretches inside; of those that repeat a smaller document's within the batch, the place only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, state, valid, ids, tags in _chunks(batches, hot.value):
            name, code, own, start, size = cut.long
            keep = np.flatnonzero(valid[own])
            inside = np.zeros(len(cut.key), INSIDE)
            at = np.maximum(cut.within, 0)
            for field, values in (("key", cut.key), ("code", cut.code), ("at", cut.start - (start[at] if len(start) else 0)), ("size", cut.size), ("state", state)):
                inside[field] = values
            inside = inside[cut.within >= 0]
            first = np.searchsorted(cut.within[cut.within >= 0], np.arange(len(name) + 1))
            doc = ids[own[keep]]
            done = _settle_batch(name[keep], code[keep], doc)
            held = [None if gone else inside[first[k] : first[k + 1]].tobytes() for k, gone in zip(keep.tolist(), done.tolist(), strict=True)]
            pos = _pack(start[keep], np.zeros(len(keep)), tags[own[keep]])
            key = np.where(done, W.mix(doc.view(np.uint64) ^ W.mix(pos.view(np.uint64), 51), 52), name[keep])
            cols = (key.view(np.int64), code[keep].view(np.int64), doc, pos, size[keep].astype(np.int64), np.where(done, DONE, OPEN).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(held, pa.binary())], ["key", "code", "doc", "pos", "size", "state", "inside"])

    return run


def _resolve_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From long symbols sorted by key, code and document: what is removed, and the stretches inside those of the smallest documents."""
    open_run = None  # key, code and smallest document of the run that a batch's end cuts
    for b in batches:
        if not b.num_rows:
            continue
        key, code, doc, pos, size, state = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if open_run is not None and open_run[:2] == (key[0], code[0]):
            least[np.cumsum(new) == 1] = open_run[2]
        open_run = (key[-1], code[-1], least[-1])
        gone = (state == DONE) | (doc > least)
        parts = (size[gone] + _MOST - 1) // _MOST
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, _, tag = _unpack(np.repeat(pos[gone], parts))
        at = _pack(start + k * _MOST, np.minimum(np.repeat(size[gone], parts) - k * _MOST, _MOST), tag)
        yield _rows(np.zeros(len(at), np.uint64), np.repeat(code[gone], parts).view(np.uint64), np.repeat(doc[gone], parts), at, np.full(len(at), DONE))
        kept = np.flatnonzero(~gone)
        for some in np.array_split(kept, max(1, len(kept) // 4096)):
            raw = b.column(6).take(pa.array(some))
            inside = np.frombuffer(b"".join(raw.to_pylist()), INSIDE)
            each = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // INSIDE.itemsize
            start, _, tag = _unpack(np.repeat(pos[some], each))
            at = _pack(start + inside["at"], inside["size"], tag)
            yield _rows(inside["key"].copy(), inside["code"].copy(), np.repeat(doc[some], each), at, inside["state"])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Keys of symbols that are frequent in the sample, sorted."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, *_ in _chunks(batches, np.zeros(0, np.uint64)):
            key, n = np.unique(cut.key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    total = docs.count()
    wanted = min(SAMPLE_MOST, max(SAMPLE_LEAST, total // SAMPLE_PART))
    sample = docs.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 20)) < int(min(1.0, wanted / max(total, 1)) * (1 << 20)))
    counts = settled(sample.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_HOT), "frequent")
    least = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    return np.sort(counts.where(F.col("n") > least).select("key").toArrow().column(0).to_numpy().view(np.uint64))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, code and document: what is removed, and what has to be opened.

    Only the run that a batch's end cuts is carried over, as its first document's rows.
    """
    held: list[np.ndarray] | None = None  # rows of the open run's first documents
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        mark = np.zeros(len(cols[0]), bool)  # rows that were seen before
        if held is not None:
            mark = np.concatenate([np.ones(len(held[0]), bool), mark])
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        key, code, doc, pos, state = cols
        done = state == DONE
        n = len(key)
        new_key = np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        new_code = new_key.copy()
        new_code[1:] |= code[1:] != code[:-1]
        least = doc[np.maximum.accumulate(np.where(new_code, np.arange(n), 0))]
        gone = done | ((doc > least) & ~mark)
        run = np.cumsum(new_key) - 1
        several = (np.bincount(run, new_code)[run] > 1) | (state == HOT)
        last = run == run[-1]
        opened = ~gone & several & ~last & ~done
        yield _kept(doc, pos, gone & ~mark, opened)
        stay = last & ~gone & ~done
        held = [x[stay] for x in cols] if stay.any() else None
    if held is not None:
        key, code, doc, pos, state = held
        several = (len(np.unique(code)) > 1) | (state == HOT)
        yield _kept(doc, pos, np.zeros(len(key), bool), several)


def _kept(doc: np.ndarray, pos: np.ndarray, gone: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
    which = np.flatnonzero(gone | opened)
    return pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(pos[which]), pa.array(opened[which])], ["doc", "pos", "open"])


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of the opened stretches of texts."""
    for b in batches:
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
        for w in W.words(b.column(1)):
            tags, one, two = _tags(w), Ranges(w.hash, 61), Ranges(w.hash, 62)
            docs, pos = [], []
            for k in range(w.rows.stop - w.rows.start):
                start, size, tag = _unpack(np.array(lists[w.rows.start + k], np.int64))
                start, size = start[tag == tags[k]], size[tag == tags[k]]
                at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                pos.append(at)
                docs.append(np.full(len(at), k))
            own, at = np.concatenate(docs), np.concatenate(pos)
            first = w.first[own] + at
            cols = [one.of(first, first + WINDOW).view(np.int64), two.of(first, first + WINDOW).view(np.int64), ids[w.rows][own], _pack(at, np.ones(len(at)), tags[own])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "g", "doc", "pos"])


def _without(text_kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without the words of removed windows."""
        for b in batches:
            lists = b.column(2)
            for w in W.words(b.column(1)):
                n, tags = w.rows.stop - w.rows.start, _tags(w)
                part = lists.slice(w.rows.start, n)
                size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                start, width, tag = _unpack(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                own = np.repeat(np.arange(n), size)
                fits = tag == tags[own]
                begin = w.first[own[fits]] + start[fits]
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + width[fits] - 1 + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                doc = np.repeat(np.arange(n), np.diff(w.first))
                stay = ~gone
                s, e, d = w.start[stay], w.end[stay], doc[stay]
                length = e - s + 1  # a word and the space behind it
                stop = np.cumsum(length)
                out = np.append(w.data, np.uint8(0x20))[np.minimum(np.repeat(s - stop + length, length) + np.arange(stop[-1] if len(stop) else 0), len(w.data))]
                out[stop - 1] = 0x20
                last = np.searchsorted(d, np.arange(n), "right") - 1
                has = np.bincount(d, minlength=n) > 0
                ends = np.concatenate([[0], stop])
                first_out = ends[np.searchsorted(d, np.arange(n))]
                last_out = np.where(has, ends[np.maximum(last, 0) + 1] - 1, first_out)
                raw = out.tobytes()
                kept = [raw[x:y].decode() for x, y in zip(first_out.tolist(), last_out.tolist(), strict=True)]
                counts = [np.diff(w.first), np.bincount(doc[gone], minlength=n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.rows.start, n), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_words``, ``n_removed`` and the ``kept`` words (joined by one space) of every text.

    A word goes if a window of 13 words around it also starts in a text with a smaller key.
    """
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    hot = df.sparkSession.sparkContext.broadcast(_frequent(docs))
    long = docs.mapInArrow(_cut_long(hot), LONG).repartition("key").sortWithinPartitions("key", "code", "doc").mapInArrow(_resolve_long, ROWS)
    rows = long.unionByName(docs.mapInArrow(_cut_outside(hot), ROWS))
    found = rows.repartition("key").sortWithinPartitions("key", "code", "doc").mapInArrow(_resolve, "doc long, pos long, open boolean")
    found = settled(found, "stretches")
    opened = found.where("open").groupBy("doc").agg(F.collect_list("pos").alias("list"))
    windows = docs.join(opened.hint("shuffle_hash"), "doc").mapInArrow(_open_windows, "h long, g long, doc long, pos long")
    windows = settled(windows, "windows")
    least = windows.groupBy("h", "g").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    more = windows.join(least, ["h", "g"]).where("least < doc").select("doc", "pos")
    gone = found.where("NOT open").select("doc", "pos").unionByName(more).groupBy("doc").agg(F.collect_list("pos").alias("list"))
    out = docs.join(gone.hint("shuffle_hash"), "doc", "left").select("doc", "text", "list").mapInArrow(_without("string"), "doc long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc", key)


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that start in an earlier document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM m WHERE again)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n_removed
      FROM e LEFT JOIN gone USING (doc_id, i) GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
