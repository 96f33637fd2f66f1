"""Exact token counts at every prefix of a text, by prefix dynamic programming.

Byte-pair encoding has this property: the encoding of a prefix ends in exactly
one token ``t`` such that the encoding of what precedes ``t`` ends in a token
that is stable next to ``t``.  So the last token and the count of every prefix
follow from those of shorter prefixes, in one pass and without encoding any
prefix anew.  The tables are filled for many distinct pieces at once in numpy;
pieces over ``LONG`` bytes are walked one by one, with the tokens that end at each
byte from a table of token ends, so time is in proportion to their length.

``prefix_tables`` stores the counts of all prefixes of a text in a column, from
which ``truncate_stored`` and any other budget question are plain expressions.

A text is cut where white space follows something else; the tokenizer's own
splitting never joins across such a place, so equal segments have equal tables
and each is computed once per worker, within a bounded cache.

Nulls and empty texts have 0 tokens.  Special tokens written inside a text
count as one token, as the library has it by default.  Very long texts are
handled in full; memory holds one chunk of texts and the cache.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm import words as W

#: Distinct segments whose counts a worker keeps.
CACHE_SEGMENTS = 1_000_000
#: Bytes of text cut at once; the larger, the fewer look-ups of words that repeat.
CHUNK = 2 << 20
#: Distinct pieces handled at once; bounds the tables.
PIECES = 65_536
#: Bytes of a piece from which it is walked by itself.
LONG = 32
#: Pairs of tokens whose stability a worker keeps for such walks.
CACHE_PAIRS = 500_000
_EMPTY = np.uint64(0)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class Lookup:
    """A static open-addressing table from 64-bit keys to numbers, probed in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[slot[left]] < 0
            _, one = np.unique(slot[left[free]], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            s = slot[left]
            hit = self.keys[s] == keys[left]
            out[left[hit]] = self.values[s[hit]]
            left = left[~hit & (self.values[s] >= 0)]
        return out


class PrefixCounter:
    """Prefix tables of a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], _byte_symbols()
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or model.get("end_of_word_suffix"):
            raise ValueError("prefix tables need a plain byte-level BPE tokenizer")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = Tokenizer.from_file(path).pre_tokenizer
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}  # merge order stands for the id
        left, right, pairs, ids = list(range(256)), list(range(256)), [], []
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = as_bytes(a), as_bytes(b)
            rank.setdefault(a + b, 256 + k)
            left.append(rank[a])
            right.append(rank[b])
            pairs.append((rank[a] << 32) | rank[b])
            ids.append(256 + k)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.longest = max(map(len, rank))
        self.pairs = Lookup(np.array(pairs, np.uint64) + np.uint64(1), np.array(ids, np.int64))
        up, _ = W.powers(self.longest + 1)
        keys = np.array([self._whole(np.frombuffer(t, np.uint8)) for t in rank], np.uint64)
        self.tokens = Lookup(keys, np.array(list(rank.values()), np.int64))
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.rank = rank
        self.ends: dict[bytes, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pair_stable: dict[tuple[int, int], bool] = {}
        self.spaces: dict[str, bool] = {}

    def _whole(self, data: np.ndarray) -> np.uint64:
        up, down = W.powers(len(data) + 1)
        with np.errstate(over="ignore"):
            return W.mix(np.array([(W._byte_codes()[data] * up[: len(data)]).sum() + np.uint64(len(data))], np.uint64))[0]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token ``b`` next to token ``a``.

        Both are taken apart in reverse merge order; the pair falls if two parts
        that meet at the border would have merged before the parts grew further.
        """
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            merged = self.pairs.get(((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)) + np.uint64(1))
            falls = (merged >= 0) & (merged < limit[live])
            out[live[falls]] = False
            x_whole, y_whole = x < 256, y < 256
            take_a = ~x_whole & (y_whole | (x > y))
            done = falls | (x_whole & y_whole)
            limit[live] = np.where(take_a, x, y + 1)
            a[live] = np.where(take_a, self.right[x], x)
            b[live] = np.where(take_a, y, self.left[y])
            live = live[~done]
        return out

    def _stays(self, a: int, b: int) -> bool:
        """``stable`` for one pair, kept."""
        known = self.pair_stable.get((a, b))
        if known is not None:
            return known
        x, y, limit, out = a, b, 1 << 62, True
        left, right, merged = self.left_of, self.right_of, self.merged
        while True:
            if merged.get((x, y), limit) < limit:
                out = False
                break
            if x < 256 and y < 256:
                break
            if y < 256 or x > y:
                limit, x = x, right[x]
            else:
                limit, y = y + 1, left[y]
        if len(self.pair_stable) >= CACHE_PAIRS:
            self.pair_stable.clear()
        self.pair_stable[a, b] = out
        return out

    def _long_table(self, piece: bytes) -> list[int]:
        """Token counts of every prefix of one piece of any length."""
        if not self.ends:  # every end of every token; those that are tokens themselves with their rank
            self.left_of, self.right_of = self.left.tolist(), self.right.tolist()
            for k in range(256, len(self.left_of)):
                self.merged.setdefault((self.left_of[k], self.right_of[k]), k)
            for token in self.rank:
                for k in range(1, len(token)):
                    self.ends.setdefault(token[k:], -1)
            self.ends.update(self.rank)
        ends, stays = self.ends, self._stays
        count, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        for i in range(1, len(piece) + 1):
            found, begin = [], i
            while begin and (token := ends.get(piece[begin - 1 : i])) is not None:
                begin -= 1
                if token >= 0:
                    found.append((begin, token))
            for begin, token in reversed(found):
                if not begin or stays(last[begin], token):
                    last[i], count[i] = token, count[begin] + 1
                    break
        return count

    def tables(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Token counts of every prefix of every piece, flat: piece k's are at
        ``at[k] + k`` and on, one more than its bytes."""
        sizes = np.diff(at)
        if not (sizes > LONG).any():
            return self._short_tables(data, at)
        short = sizes <= LONG
        out = np.zeros(len(data) + len(sizes), np.int64)
        into = np.repeat(short, sizes + 1)
        out[into] = self._short_tables(data[np.repeat(short, sizes)], np.concatenate([[0], np.cumsum(sizes[short])]))
        for k in np.flatnonzero(~short).tolist():
            out[at[k] + k : at[k + 1] + k + 1] = self._long_table(data[at[k] : at[k + 1]].tobytes())
        return out

    def _short_tables(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, sizes = len(at) - 1, np.diff(at)
        up, down = W.powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(W._byte_codes()[data] * up[: len(data)], out=total[1:])
        base = at[:-1] + np.arange(n)
        count = np.zeros(len(data) + n, np.int64)
        last = np.full(len(data) + n, -1, np.int64)
        for i in range(1, int(sizes.max(initial=0)) + 1):
            left = np.flatnonzero(sizes >= i)
            for length in range(min(i, self.longest), 0, -1):
                if not len(left):
                    break
                end = at[left] + i
                with np.errstate(over="ignore"):
                    key = W.mix((total[end] - total[end - length]) * down[end - length] + np.uint64(length))
                token = self.tokens.get(key)
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                piece, token = left[hit], token[hit]
                if length < i:
                    fits = self.stable(last[base[piece] + i - length], token)
                    piece, token, hit = piece[fits], token[fits], hit[fits]
                last[base[piece] + i] = token
                count[base[piece] + i] = count[base[piece] + i - length] + 1
                keep = np.ones(len(left), bool)
                keep[hit] = False
                left = left[keep]
        return count

    def piece_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Token count of each piece: the last entry of its table."""
        out = np.zeros(len(pieces), np.int64)
        order = np.argsort(np.fromiter(map(len, pieces), np.int64, len(pieces)), kind="stable")
        for k in range(0, len(order), PIECES):
            part = order[k : k + PIECES]
            at = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in part])]).astype(np.int64)
            table = self.tables(np.frombuffer(b"".join(pieces[i] for i in part), np.uint8), at)
            out[part] = table[at[1:] + np.arange(len(part))]
        return out

    def _around_specials(self, text: str) -> list[str | int]:
        """What stands between special tokens, and the length of each special token."""
        parts: list[str | int] = [text]
        for special in self.specials:
            cut: list[str | int] = []
            for p in parts:
                if isinstance(p, int) or special not in p:
                    cut.append(p)
                    continue
                for k, x in enumerate(p.split(special)):
                    cut += [len(special)] * (k > 0) + [x] * bool(x)
            parts = cut
        return [p for p in parts if p]

    def split_segment(self, text: str) -> list[bytes | None]:
        """The pieces that the tokenizer encodes on their own; None is a special token."""
        out: list[bytes | None] = []
        for p in self._around_specials(text):
            if isinstance(p, int):
                out.append(None)
            else:
                out += [p[s:e].encode() for _, (s, e) in self.split.pre_tokenize_str(p)]
        return out

    def segment_counts(self, segments: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Token counts of segments; ``plain``: a segment is one piece for sure."""
        pieces: list[bytes] = []
        owner: list[int] = []
        out = np.zeros(len(segments), np.int64)
        for k, seg in enumerate(segments):
            if plain[k]:
                pieces.append(seg)
                owner.append(k)
            else:
                for p in self.split_segment(seg.decode()):
                    if p is None:
                        out[k] += 1
                    else:
                        pieces.append(p)
                        owner.append(k)
        np.add.at(out, owner, self.piece_counts(pieces))
        return out

    def _is_space(self, c: str) -> bool:
        """Whether the tokenizer's splitting takes a character for white space: two of them between letters stay apart."""
        if c not in self.spaces:
            self.spaces[c] = c == " " or len(self.split.pre_tokenize_str(f"x{c}{c}x")) == 4
        return self.spaces[c]

    def _parts(self, text: str) -> list[tuple[int, int, bool]]:
        """Begin, end and whether it is a special token, of each piece of a text, in characters."""
        out, at = [], 0
        for p in self._around_specials(text):
            if isinstance(p, int):
                out.append((at, at + p, True))
                at += p
            else:
                out += [(at + s, at + e, False) for _, (s, e) in self.split.pre_tokenize_str(p)]
                at += len(p)
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of each prefix of a text, by characters, from 0 to all of them.

        The text is split once.  A prefix that ends inside a piece has the pieces before it and the open piece's table;
        one that ends in white space has all of that white space as one piece; one that ends inside a contraction or a
        special token is split from there anew, which takes a few characters.
        """
        out = np.zeros(len(text) + 1, np.int64)
        parts = self._parts(text)
        runs: list[list[int]] = []  # white space, however many pieces it is
        after_special = False
        for s, e, special in parts:
            for k in range(s, s if special else e):
                if not self._is_space(text[k]):
                    break
                if runs and runs[-1][1] == k and not (k == s and after_special):
                    runs[-1][1] = k + 1
                else:
                    runs.append([k, k + 1])
            after_special = special
        tables = self._tables_of({text[s:e] for s, e, special in parts if not special} | {text[b:z] for b, z in runs})
        done, starts = 0, [b for b, _ in runs]
        for n, (s, e, special) in enumerate(parts):
            piece = text[s:e]
            if special:
                begin = parts[n - 1][0] if n and not parts[n - 1][2] else s
                run = runs[max(bisect.bisect_right(starts, begin) - 1, 0)] if runs else (s, s)
                begin = run[0] if run[0] <= begin < run[1] else begin
                for k in range(s + 1, e):
                    out[k] = out[begin] + self._count(text[begin:k])
                done += 1
            elif piece[0] == "'" and len(piece) in (2, 3) and piece[1:].isalpha():
                out[s + 1 : e] = [done + self._count(piece[:k]) for k in range(1, len(piece))]
                done += int(tables[piece][-1])
            else:
                out[s + 1 : e] = done + tables[piece][1 : e - s]
                done += int(tables[piece][-1])
            out[e] = done
        fixed = out.copy()
        for b, z in runs:
            fixed[b + 1 : z + 1] = out[b] + tables[text[b:z]][1:]
        return fixed

    def _tables_of(self, pieces: set[str]) -> dict[str, np.ndarray]:
        """The table of each piece, by characters."""
        listed = sorted(pieces, key=len)
        raw = [p.encode() for p in listed]
        out = {}
        for k in range(0, len(raw), PIECES):
            part = raw[k : k + PIECES]
            at = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
            data = np.frombuffer(b"".join(part), np.uint8)
            flat = self.tables(data, at)
            for n, p in enumerate(listed[k : k + PIECES]):
                own = flat[at[n] + n : at[n + 1] + n + 1]
                ends = np.flatnonzero(np.append((data[at[n] : at[n + 1]] & 0xC0) != 0x80, True))
                out[p] = own[ends]
        return out

    def _count(self, text: str) -> int:
        pieces = self.split_segment(text)
        return sum(p is None for p in pieces) + int(self.piece_counts([p for p in pieces if p is not None]).sum())

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix such that it and all shorter ones have at most ``budget`` tokens."""
        over = np.flatnonzero(self.prefix_counts(text) > budget)
        return int(over[0]) - 1 if len(over) else len(text)


def _odd_rows(texts: pa.Array) -> np.ndarray:
    """Rows with odd white space or a special token's opening, which are split whole."""
    import pyarrow.compute as pc

    bad = pc.match_substring_regex(pc.fill_null(texts, ""), "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
    return bad.to_numpy(zero_copy_only=False)


_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_texts(tok: PrefixCounter, texts: pa.Array) -> np.ndarray:
    """Tokens of each text of a batch."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    odd = _odd_rows(texts) | (np.logical_or.reduce([_has(texts, s) for s in tok.specials]) if tok.specials else False)
    out = np.zeros(len(texts), np.int64)
    for w in W.words(texts, chunk=CHUNK):
        n_docs = w.rows.stop - w.rows.start
        skip = odd[w.rows]
        # a segment is a word with the white space before it; what follows the last word is one more
        docs = np.repeat(np.arange(n_docs), np.diff(w.first))
        at = W.buffers(texts.slice(w.rows.start, n_docs))[1]
        at = at - at[0]
        first = np.zeros(len(w.start), bool)
        first[w.first[:-1][np.diff(w.first) > 0]] = True
        begin = np.empty(len(w.start), np.int64)
        begin[1:] = w.end[:-1]
        begin[first] = at[:-1][docs[first]]
        finish = np.where(np.diff(w.first) > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, at[:-1])
        tail = np.flatnonzero(finish < at[1:])
        begin, end = np.concatenate([begin, finish[tail]]), np.concatenate([w.end, at[1:][tail]])
        docs = np.concatenate([docs, tail])
        keep = ~skip[docs]
        begin, end, docs = begin[keep], end[keep], docs[keep]
        if len(begin):
            up, down = W.powers(len(w.data) + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(len(w.data) + 1, np.uint64)
                np.cumsum(W._byte_codes()[w.data] * up[: len(w.data)], out=total[1:])
                code = W.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
            distinct, one, back = np.unique(code, return_index=True, return_inverse=True)
            out[w.rows] += np.bincount(docs, _cached(tok, w, distinct, begin[one], end[one])[back], n_docs).astype(np.int64)
        for d in np.flatnonzero(skip):
            row = w.rows.start + int(d)
            pieces = tok.split_segment(texts[row].as_py())
            out[row] = sum(p is None for p in pieces) + tok.piece_counts([p for p in pieces if p is not None]).sum()
    return out


def _has(texts: pa.Array, what: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.match_substring(pc.fill_null(texts, ""), what).to_numpy(zero_copy_only=False)


def _cached(tok: PrefixCounter, w: W.Words, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Counts of distinct segments, from the worker's cache or new."""
    place = np.searchsorted(tok.known, code)
    found = np.zeros(len(code), bool)
    inside = place < len(tok.known)
    found[inside] = tok.known[place[inside]] == code[inside]
    out = np.zeros(len(code), np.int64)
    out[found] = tok.counts[place[found]]
    new = np.flatnonzero(~found)
    if len(new):
        letters = np.concatenate([[0], np.cumsum(_ALPHA[w.data])])
        body = begin[new] + (w.data[begin[new]] == 0x20)
        plain = (letters[end[new]] - letters[body] == end[new] - body) & (end[new] > body)
        raw = w.data.tobytes()
        out[new] = tok.segment_counts([raw[b:e] for b, e in zip(begin[new].tolist(), end[new].tolist(), strict=True)], plain)
        if len(tok.known) + len(new) > CACHE_SEGMENTS:
            tok.known, tok.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate([tok.known, code[new]]), np.concatenate([tok.counts, out[new]])
        order = np.argsort(keys, kind="stable")
        tok.known, tok.counts = keys[order], counts[order]
    return out


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Key, ``n_bytes`` and ``n_tokens`` of each row's text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = counter(path)
        for b in batches:
            size = np.diff(W.buffers(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(count_texts(tok, b.column(1)))], [key, "n_bytes", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")


def prefix_tables(df: DataFrame, key: str, text: str, path: str, name: str = "prefix_tokens") -> DataFrame:
    """Key, text and an array of the token counts of all its prefixes, by characters, from 0 on; null where the text is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = counter(path)
        for b in batches:
            for k in range(b.num_rows):  # a row at a time: a count takes as much room as some characters
                t = b.column(1)[k].as_py()
                counts = pa.array([None if t is None else tok.prefix_counts(t).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), counts], [key, text, name])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{text}` string, `{name}` array<int>")


def truncate_stored(stored: DataFrame, key: str, text: str, budget: int, name: str = "prefix_tokens") -> DataFrame:
    """Key, the longest prefix of each text such that it and all shorter ones are within ``budget`` tokens, and its count, from stored tables."""
    over = F.array_position(F.transform(name, lambda n: n > budget), F.lit(True))
    stop = F.when(over > 0, over - 2).otherwise(F.size(name) - 1).cast("int")
    rows = stored.withColumn("_stop", stop)
    return rows.select(F.col(key), F.substr(F.col(text), F.lit(1), F.col("_stop")).alias(text), F.coalesce(F.get(name, F.col("_stop")), F.lit(0)).cast("long").alias("n_tokens"))


def truncate(df: DataFrame, key: str, text: str, path: str, budget: int) -> DataFrame:
    """Key, the longest safe prefix of each text within ``budget`` tokens, and its token count."""
    return truncate_stored(prefix_tables(df, key, text, path), key, text, budget)


def op6_prefix_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and which are over 1,024 tokens."""
    import public_tokenizers

    from convoy.llm.shared import table

    counted = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
