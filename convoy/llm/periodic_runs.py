"""Periodic runs of words in texts, after Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q, words q apart being
the same, that no neighbouring word extends.  Found are those of at least ``LEAST``
words and four periods:

1. A text is cut where no such run can be: all three consecutive words of a run occur
   three times in it, so words outside stretches of such triples lie in no run.  Counting
   is by hashed triples, which keeps too much at worst; it is repeated within stretches.
2. A stretch is factorised from its suffix automaton: each factor is the longest that
   occurs before, or a new word.
3. Main's algorithm, by Z functions around each border of factors, finds the runs that
   cross or touch it.  As a factor is the longest, a run over a border goes back less than
   a period beyond the factor before it, so the windows are linear in the factors.
4. The other runs lie inside a factor, and are copied from its earlier occurrence.

Steps 2 to 4 take time in proportion to the words.  A text is handled whole, in one task
and without a shuffle; a worker holds a batch of texts and one text's automaton (a
kilobyte or less for each word that step 1 leaves).

Nulls: a null or wordless text has no words and no runs.  Null and repeated keys are
rows like others, each text on its own.  An empty table gives no rows.  Other columns
are dropped unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm.shared import table

#: A run has so many words and periods at least.
LEAST, PERIODS = 6, 4
#: How often a part is cut again at most, so that cutting stays linear.
CUTS = 6


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """Factors as (begin, end, begin of an earlier occurrence or -1), from the suffix automaton."""
    n = len(word)
    link, size, ends, step = [-1], [0], [-1], [{}]  # of each state: suffix link, longest string, first end, transitions
    last = 0
    for k, c in enumerate(word):
        new, at = len(link), last
        link.append(0)
        size.append(k + 1)
        ends.append(k)
        step.append({})
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                twin = len(link)
                link.append(link[to])
                size.append(size[at] + 1)
                ends.append(ends[to])
                step.append(dict(step[to]))
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    out, i = [], 0
    while i < n:
        state, j = 0, i
        while j < n and ends[to := step[state][word[j]]] < j:
            state, j = to, j + 1
        out.append((i, j, ends[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = out[-1][1]
    return out


def _z(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of s and its suffix there."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(word: list[int], before: int, border: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that cross or touch the border between the factors before..border and border..end."""
    n, most = len(word), (end - before - 1) // (PERIODS - 1)  # a run over the border has a smaller period than that
    t, u = word[max(0, before - most) : border], word[border:end]
    back = t[::-1]
    own, over = _z(u), _z([*u, -1, *t, *u])
    behind, ahead = _z(back), _z([*back, -1, *u[::-1], *back])
    for p in range(1, most + 1):
        need = max(LEAST, PERIODS * p)
        if p <= len(u):  # a period ahead of the border
            s, e = border - ahead[len(t) + 1 + len(u) - p], border + p + (own[p] if p < len(u) else 0)
            if e - s >= need and (e < end or e == n or word[e] != word[e - p]):
                yield s, e, p
        if p <= len(t):  # a period behind it; one that ends here was found before unless it begins in the factor before
            s, e = border - p - (behind[p] if p < len(t) else 0), border + over[len(u) + 1 + len(t) - p]
            if e - s >= need and (e < end or e == n or word[e] != word[e - p]) and (e > border or s > before):
                yield s, e, p


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """All runs of a sequence as (start, length, period), by start, then period."""
    parts = factors(word)
    by_start: dict[int, dict[int, int]] = {}  # start -> end -> smallest period

    def add(s: int, e: int, p: int) -> None:
        known = by_start.setdefault(s, {})
        known[e] = min(p, known.get(e, p))

    before = 0
    for k, (begin, end, source) in enumerate([*parts, (len(word), len(word), -1)]):
        if k:
            for found in _crossing(word, before, begin, end):
                add(*found)
        if source >= 0:
            shift, stop = begin - source, end - (begin - source)
            for s in range(source + 1, stop):
                for e, p in list(by_start.get(s, {}).items()):
                    if e < stop:
                        add(s + shift, e + shift, p)
        before = begin
    return sorted((s, e - s, p) for s, found in by_start.items() for e, p in found.items())


def stretches(code: np.ndarray) -> list[tuple[int, int]]:
    """Parts (begin, end) of a text outside of which no run can be."""
    out, todo = [], [(0, len(code), 0)]
    while todo:
        begin, end, cuts = todo.pop()
        if end - begin < LEAST:
            continue
        x = code[begin:end].astype(np.uint64)
        bits = np.uint64(64 - (end - begin).bit_length() - 2)
        with np.errstate(over="ignore"):
            bucket = ((x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + x[2:]) * np.uint64(0x94D049BB133111EB) >> bits
        bucket = bucket.astype(np.int64)
        often = np.zeros(len(bucket) + 2, bool)
        often[1:-1] = np.bincount(bucket)[bucket] >= PERIODS - 1
        edges = np.flatnonzero(often[1:] != often[:-1])
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a == end - begin - 2 or cuts == CUTS:
                out.append((begin + a, begin + b + 2))
            elif b - a + 2 >= LEAST:
                todo.append((begin + a, begin + b + 2, cuts + 1))
    return out


def find(text: bytes) -> tuple[list[tuple[int, int, int]], bytes]:
    """Runs of a text as (start, length, period) by word number, and its words without the runs' repeats, a space between them."""
    words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    first: dict[bytes, int] = {}
    code = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
    runs = sorted((a + s, n, p) for a, b in stretches(code) for s, n, p in runs_of(code[a:b].tolist()))
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        s, n, p = np.array(runs).T
        np.add.at(drop, s + p, 1)
        np.add.at(drop, s + n, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return runs, b" ".join(words)


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text's words without what
    a run repeats."""
    rows = df.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], F.col(text).alias("_text"))
    at, names = len(keep), [*rows.columns[:-1], "runs", "collapsed"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find((t or "").encode()) for t in b.column(at).to_pylist()]
            each = [dict(zip(("start", "length", "period"), r, strict=True)) for runs, _ in found for r in runs]
            first = np.cumsum([0, *[len(runs) for runs, _ in found]]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(first), pa.array(each, kind.value_type))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], runs, pa.array([c.decode() for _, c in found], pa.string())], names)

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in rows.columns[:at]], f"runs {RUN}", "collapsed string"])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the most periods, of equals the first by start, then period; null where there is none."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def looped(text: Column, key: Column) -> Column:
    """The text, or for a tenth of the keys its words with a loop from one on: a test of the search over whole tables."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))

    def turn(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.transform(w, lambda c, i: F.when(i < a, c).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    # the words are bound to a variable of a lambda, so that they are cut once
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(turn(w), " ")).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def document_runs(docs: DataFrame) -> DataFrame:
    """Runs of all documents, a tenth of them looped, as counts, the strongest run and digests."""
    rows = docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(rows, "text", ("doc_id",)).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents' words."""
    return document_runs(table(spark, sf_dir, "documents"))
