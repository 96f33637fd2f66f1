"""Word and shingle hashing over Arrow string batches, vectorised in numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Words get 64-bit
hashes straight from the UTF-8 buffer, so no Python string is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; bounds the temporaries at about 20 times as much.
CHUNK_BYTES = 1 << 19
#: Powers that a worker keeps (16 bytes each); chunks of up to a megabyte need no more.
KEPT_POWERS = (1 << 20) + 64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, seeded."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _give_back() -> None:
    """Lets a worker return what it frees: Arrow takes memory from malloc, and malloc maps blocks of a megabyte on their own."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        for option in (-3, -1):  # glibc's M_MMAP_THRESHOLD and M_TRIM_THRESHOLD
            libc.mallopt(option, 1 << 20)
    except (OSError, AttributeError):
        pass  # another C library; it has its own ways


_give_back()


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 77)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` or more powers of the base and of its inverse modulo 2**64; those for very long texts are not kept."""
    return _kept_powers() if size <= KEPT_POWERS else _powers(size)


@dataclass
class Words:
    """Words of a run of documents: byte spans, hashes and first word of each document."""

    data: np.ndarray  #: the bytes
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte behind each word
    hash: np.ndarray  #: 64-bit hash of each word
    first: np.ndarray  #: index of each document's first word, and the number of words at the end
    rows: slice  #: which rows of the batch these documents are


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and row offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def words(texts: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES, marks: bool = False) -> Iterator[Words]:
    """The words of all texts, whole documents together, some ``chunk`` bytes at a time.

    ``marks``: punctuation right behind an ASCII letter begins a word of its own.
    """
    data, at = buffers(texts)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + chunk, "right")) - 1)
        yield _words(data[at[row] : at[stop]], at[row : stop + 1] - at[row], slice(row, stop), lower, marks)
        row = stop


def _words(data: np.ndarray, at: np.ndarray, rows: slice, lower: bool, marks: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    size = len(data)
    inside = np.zeros(size + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(size + 2, bool)  # a document starts behind this place
    edge[at] = True
    if marks:
        edge[1:size] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    here = inside[1:-1]
    start = np.flatnonzero(here & (~inside[:-2] | edge[:size]))
    end = np.flatnonzero(here & (~inside[2:] | edge[1 : size + 1])) + 1
    up, down = powers(size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * up[:size], out=total[1:])
        code = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, code, np.searchsorted(start, at), rows)


def rolling(code: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive codes, documents disregarded."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        own = mix(code, seed)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out *= _BASE
            out += own[k : k + n]
    return mix(out, seed)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's shingles, and the first of each document.

    A document of fewer words has its whole sequence as its one shingle, one
    without words has none.  Repeats stay.
    """
    count = np.diff(w.first)
    each = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(each)])
    doc = np.repeat(np.arange(len(count)), each)
    place = np.arange(first[-1]) - first[doc] + w.first[doc]
    full = rolling(w.hash, width)
    out = np.zeros(len(place), np.uint64)
    long = count[doc] >= width
    out[long] = full[place[long]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        part = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = mix(rolling(part, len(part)), 1000 + len(part))[0]
    return out, first
