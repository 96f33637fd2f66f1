"""Merkle manifest, periodic runs and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convoy.llm import merkle, packing, periodic_runs

WORD = public_tokenizers.path("word_bpe_49k.json")
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
crc = lambda key: None if key is None else zlib.crc32(str(key).encode())
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- 11: manifest


def _tree(nodes):
    """Levels of digests up to the apex."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def _proof(levels, at):
    out = []
    for nodes in levels[:-1]:
        own = at // 8 * 8
        out.append((nodes[own : own + 8], at - own))
        at //= 8
    return out


def _manifest(rows):
    """Rows (key, leaf, changed, group) to (key, leaf, subroot, root, proof, folded) by the plain definition."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = _tree([r[1] for r in groups[g]])
    crown = _tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (key, leaf, changed, _) in enumerate(groups[g]):
            path = _proof(trees[g], i) + _proof(crown, k)
            below = changed
            for nodes, at in path:
                below = H(*nodes[:at], below, *nodes[at + 1 :])
            out.append((key, leaf, trees[g][-1][0], crown[-1][0], H(*[v for nodes, at in path for j, v in enumerate(nodes) if j != at]), below, below == crown[-1][0]))
    return out


def _documents(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    out = []
    for r in rows:
        fields = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        low = None if r.text is None else re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        other = low if r.doc_id is not None and crc(r.doc_id) % 3 == 0 else r.text
        out.append((r.doc_id, H(*map(shown, fields)), H(*map(shown, [*fields[:-1], other])), r.lang))
    return _manifest(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest_equals_the_plain_definition(spark, seed):
    rnd = random.Random(seed)
    langs = [None, "", "-", "de", "en", "é", "zz", "日", "a", "b", "c"] if seed == 1 else ["en"]
    rows = [(k * 7 - 500, None if k % 11 == 0 else f"Some Text é {k}", "en" if k % 3 else rnd.choice(langs), None if k % 5 == 0 else "src", None if k % 7 == 0 else k) for k in range(700)]
    rows += [(10_000 + k, "Alone", f"lang{k}", "s", 1) for k in range(70 if seed == 1 else 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = sorted(tuple(r) for r in merkle.document_manifest(docs.repartition(5)).collect())
    assert got == sorted(_documents(docs.collect()))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_odd_tables(spark, tricky, nothing):
    odd = tricky.withColumnsRenamed({"n_tokens": "n_chars"}).withColumns({c: F.lit("mine") for c in ("leaf", "node", "run", "path", "_i", "_n", "_group", "_key", "root")})
    text = lambda rows: sorted(map(str, rows))
    assert text(tuple(r) for r in merkle.document_manifest(odd).collect()) == text(_documents(odd.collect()))
    assert merkle.document_manifest(odd.where("false")).collect() == []
    one = odd.where("doc_id = 5")
    assert [tuple(r) for r in merkle.document_manifest(one).collect()] == _documents(one.collect())


def test_a_hot_group_of_equal_rows_is_numbered_in_parts(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.lit("g").alias("g"), F.lit("x").alias("node"))
    rows = merkle.numbered(docs, "g", ["k", "node"], "hot")
    assert sorted(r._i for r in rows.collect()) == list(range(4000)) and rows.select("_n").distinct().collect() == [(4000,)]


def test_proofs_tell_any_change(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "ab"[k % 2]) for k in range(100)], "k long, t string, g string")
    rows = merkle.manifest(docs, ("k", "t"), "g", "k", fanout=3)
    assert rows.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert rows.where(merkle.fold(merkle.digest(F.lit("other")), F.col("path")) == F.col("root")).isEmpty()
    assert rows.select("root").distinct().count() == 1 and rows.select("subroot").distinct().count() == 2


# ---- 12: runs


def _runs(words):
    """All runs by comparing every word with the one q before it."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            s = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - s >= max(6, 4 * q):
                found.setdefault((s, k + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and crc(doc_id) % 10 == 0 and n:
        g = crc(doc_id) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words)
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def _loopy(rnd, n):
    """Words with loops in loops."""
    out = []
    while len(out) < n:
        kind = rnd.random()
        if kind < 0.3 or not out:
            out += rnd.choices("abc", k=rnd.randrange(1, 6))
        elif kind < 0.6:
            out += rnd.choices("ab", k=rnd.randrange(1, 5)) * rnd.randrange(2, 8)
        else:
            k = rnd.randrange(len(out))
            out += out[k : k + rnd.randrange(1, 40)] * rnd.choice([1, 1, 2, 5])
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_equal_brute_force(word):
    assert periodic_runs.runs_of(word) == _runs(word)


def test_runs_of_loops_in_loops_and_cutting_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        words = _loopy(rnd, rnd.randrange(1, 250))
        want = _runs(words)
        assert periodic_runs.runs_of([ord(c) for c in words]) == want
        assert periodic_runs.find(" ".join(words).encode())[0] == want
    prose = [f"w{rnd.randrange(40)}" for _ in range(3000)]
    prose[500:700], prose[2000:2060] = prose[500:520] * 10, ["x"] * 60
    assert periodic_runs.find(" ".join(prose).encode())[0] == _runs(prose) != []


def test_factors_are_the_longest_that_occur_before():
    rnd = random.Random(6)
    for _ in range(100):
        word = [rnd.randrange(3) for _ in range(rnd.randrange(1, 40))]
        at = 0
        for begin, end, source in periodic_runs.factors(word):
            occurs = lambda n: next((k for k in range(begin) if word[k : k + n] == word[begin : begin + n]), None)  # noqa: B023, E731
            assert begin == at and ((source < 0 and end == begin + 1 and occurs(1) is None) or (source == occurs(end - begin) and (end == len(word) or occurs(end - begin + 1) is None)))
            at = end
        assert at == len(word)


def test_runs_take_time_in_proportion():
    import time

    rnd = random.Random(8)
    for word in ([0] * 200_000, [0, 1, 2] * 70_000, rnd.choices([0, 1], k=100_000), [rnd.randrange(9) for _ in range(500)] * 300):
        began = time.process_time()
        periodic_runs.runs_of(word)
        assert time.process_time() - began < 10


def test_document_runs_equal_the_plain_version(spark, tricky, nothing):
    rnd = random.Random(9)
    rows = [(k, " ".join(_loopy(rnd, k % 90)) if k % 3 else " \t".join(f"w{rnd.randrange(30)}" for _ in range(k))) for k in range(300)]
    rows += [(5000 + k, "é \x0b ü\n" * 9 + "z\xa0z " * k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, periodic_runs.document_runs(docs).collect()))
    assert got == sorted(_row(*r) for r in rows) and sum(crc(r[0]) % 10 == 0 for r in rows) > 20
    odd = tricky.withColumns({c: F.lit("mine") for c in ("runs", "collapsed", "start", "best", "_keep0", "_text")})
    assert sorted(map(str, (tuple(r) for r in periodic_runs.document_runs(odd).collect()))) == sorted(str(_row(r.doc_id, r.text)) for r in odd.collect())
    assert periodic_runs.document_runs(nothing).count() == 0
    spans = periodic_runs.periodic_runs(odd.where("doc_id = 8"), "text", ("runs", "doc_id")).first()
    assert spans.runs == "mine" or spans[0] == "mine"


# ---- 13: packing


def _check(pieces, sizes, sequence):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, to, at in pieces:
        by_doc[d].append((s, n))
        by_seq[to].append((at, n))
    for d, n in enumerate(sizes):
        assert sum(k for _, k in by_doc[d]) == n
    for spans in [*by_doc.values(), *by_seq.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at and n > 0
            at += n
    used = sorted(sum(n for _, n in spans) for spans in by_seq.values())
    assert all(u == sequence or u & (u - 1) == 0 for u in used)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_packing_loses_nothing_and_pads_nothing(sizes):
    _check(packing.pack(np.array(sizes, np.int64), 16).tolist(), sizes, 16)


def test_packing_equals_the_plain_rule_and_balances_cost():
    rnd = random.Random(2)
    for _ in range(20):
        sizes = [rnd.randrange(1, 90) for _ in range(rnd.randrange(1, 60))]
        left = packing.rooms(sum(sizes), 32).tolist()
        full, cost, want = list(left), [0.0] * len(left), []
        todo = sorted((-min(32, n - s), d, s) for d, n in enumerate(sizes) for s in range(0, n, 32))
        while todo:
            n, d, s = todo.pop(0)
            at = [k for k in range(len(left)) if left[k] >= -n] or [k for k in range(len(left)) if left[k]]
            k = min(at, key=lambda k: (cost[k], k))
            take = min(-n, left[k])
            want.append((d, s, take, k, full[k] - left[k]))
            left[k] -= take
            cost[k] += take + take * take / 6144
            if take < -n:
                todo = sorted([*todo, (n + take, d, s + take)])
        assert sorted(map(tuple, packing.pack(np.array(sizes), 32).tolist())) == sorted(want)
    sizes = np.array([rnd.randrange(20, 1500) for _ in range(3000)])
    rows = packing.pack(sizes)
    cost = np.bincount(rows[:, 3], rows[:, 2] + rows[:, 2] ** 2 / 6144)[: int(sizes.sum()) // 4096]
    assert cost.max() < 1.1 * cost.min()


def _ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_hold_the_library_ids(spark, tricky, nothing, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    rnd, library = random.Random(7), Tokenizer.from_file(WORD)
    rows = [(k, " ".join(f"Word{rnd.randrange(999)}é," for _ in range(rnd.choice([3, 50, 2500])))) for k in range(120)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_documents(docs)
    got = packed.collect()
    assert {r.sequence_id >> 32 for r in got} > {0} and packed.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = {k: _ids(library, t) for k, t in rows}
    docs_of, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        docs_of[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(docs_of) == set(ids) and all(sum(n for _, n in v) == len(ids[k]) for k, v in docs_of.items())
    for spans in [*docs_of.values(), *seqs.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
    table = packing.sequences(packed).collect()
    assert all(r.padding == 0 and r.tokens <= 4096 for r in table) and sum(r.tokens for r in table) == sum(map(len, ids.values()))
    again = packing.pack_documents(docs.repartition(7)).collect()
    assert sorted(again) == sorted(got)
    odd = tricky.withColumns({c: F.lit("mine") for c in ("k", "ids", "g", "start", "length", "cost")})
    assert sum(r.length for r in packing.pack_documents(odd).collect()) == sum(len(_ids(library, r.text)) for r in odd.collect())
    assert packing.pack_documents(nothing).count() == 0


def test_a_group_far_over_its_size_is_packed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 5000)
    docs = spark.createDataFrame([(1, "same text " * 40)] * 400, "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    table = defaultdict(int)
    for r in rows:
        table[r.sequence_id] += r.length
    assert sum(table.values()) == 400 * 81 and all(n == 4096 or n & (n - 1) == 0 for n in table.values())
