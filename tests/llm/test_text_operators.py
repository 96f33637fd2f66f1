"""Token counts, token files, language id, repeats, similarity and contamination against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convoy.llm import contamination, graph, jaccard_join, language_id, shared, substring_dedup, token_counts, token_files
from convoy.llm.graph import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
mixed = st.text(alphabet=st.sampled_from(list("abcdeT'sl .,\n\t1234éßñ日本\xa0\x1c") + [" ", " "]), max_size=60)


# ---- 6: token counts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), mixed, st.just("a <|endoftext|>b")), min_size=1, max_size=8))
def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(BYTE)
    got = token_counts.count_texts(token_counts.counter(BYTE), pa.array(texts, pa.string()))
    assert got.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


@settings(max_examples=40, deadline=None)
@given(mixed)
def test_every_prefix_has_its_count(text):
    library = Tokenizer.from_file(BYTE)
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert token_counts.counter(BYTE).prefix_counts(text).tolist() == want


def test_long_pieces_take_time_in_proportion():
    import random
    import time

    library, rnd = Tokenizer.from_file(BYTE), random.Random(4)
    texts = ["".join(rnd.choices(letters, k=100_000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", " ", "-=", "日é")]
    token_counts.count_texts(token_counts.counter(BYTE), pa.array(["x" * 100]))  # builds the tables
    for text in texts:
        began = time.process_time()
        assert token_counts.count_texts(token_counts.counter(BYTE), pa.array([text])).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
        assert time.process_time() - began < 5


def test_truncation_of_a_long_text_from_stored_tables(spark):
    import random

    library, rnd = Tokenizer.from_file(BYTE), random.Random(5)
    text = "\xa0" + " ".join("".join(rnd.choices("etaoinshé'", k=rnd.randrange(1, 9))) for _ in range(20_000))
    stored = token_counts.prefix_tables(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "doc_id", "text", BYTE).cache()
    assert stored.where("doc_id = 1").first().prefix_tokens[-1] == len(library.encode(text, add_special_tokens=False).ids)
    for budget in (0, 1, 1000, 10**6):
        rows = {r.doc_id: r for r in token_counts.truncate_stored(stored, "doc_id", "text", budget).collect()}
        kept = rows[1].text
        assert text.startswith(kept) and len(library.encode(kept, add_special_tokens=False).ids) == rows[1].n_tokens <= budget
        assert kept == text or len(library.encode(text[: len(kept) + 1], add_special_tokens=False).ids) > budget
        assert (rows[2].text, rows[2].n_tokens, rows[3].text, rows[3].n_tokens) == (None, 0, "", 0)


def test_counts_of_tricky_rows(spark, tricky, nothing):
    rows = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.token_counts(tricky, "doc_id", "text", BYTE).collect()}
    assert rows[(0, 0)] == 0 and rows[(1, 0)] == 0 and len(token_counts.token_counts(tricky, "doc_id", "text", BYTE).collect()) == tricky.count()
    assert token_counts.token_counts(nothing, "doc_id", "text", BYTE).count() == 0


def test_truncation_keeps_within_the_budget(spark, tricky):
    library = Tokenizer.from_file(BYTE)
    source = {r.doc_id: r.text for r in tricky.where("doc_id IS NOT NULL").collect()}
    for r in token_counts.truncate(tricky.where("doc_id IN (4, 5, 6, 7, 10)"), "doc_id", "text", BYTE, 3).collect():
        used = len(library.encode(r.text, add_special_tokens=False).ids)
        assert source[r.doc_id].startswith(r.text) and used == r.n_tokens <= 3


# ---- 7: token files


def test_files_round_trip(spark, tricky, nothing, tmp_path):
    library = Tokenizer.from_file(WORD)
    manifest = token_files.write(tricky, "doc_id", "text", WORD, f"file://{tmp_path}/a", end_id=1, partitions=3)
    rows = token_files.read(manifest, "doc_id").collect()
    docs = sorted(tricky.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start, want = 0, []
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    found = token_files.lookup(spark, manifest, spark.createDataFrame([(5,), (4,), (77,), (None,)], "doc_id long"), "doc_id").collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in found) == sorted((k, (*library.encode(t).ids, 1)) for k, t in ((4, "one"), (4, "one"), (4, "one"), (5, "One two THREE")))
    empty = token_files.write(nothing, "doc_id", "text", WORD, f"file://{tmp_path}/b", end_id=1)
    assert token_files.read(empty, "doc_id").count() == 0


def test_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_ENTRIES", 10)
    monkeypatch.setattr(shared, "BATCH_ROWS", 4)
    shared.small_batches(spark)
    docs = spark.createDataFrame([(k - 20, f"text {k}") for k in range(80)] + [(None, "a"), (None, "b")] + [(3, f"again {k}") for k in range(25)], "doc_id long, text string")
    manifest = token_files.write(docs, "doc_id", "text", WORD, f"file://{tmp_path}/a", end_id=1, partitions=4)
    files = manifest.count()
    assert files >= 8
    rows = token_files.read(manifest, "doc_id").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) >= min(files, spark.sparkContext.defaultParallelism)
    placed = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in placed] == list(np.cumsum([0, *[r.n_tokens for r in placed]])[:-1]) and [r.doc_id for r in placed] == sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k))
    library = Tokenizer.from_file(WORD)
    wanted = spark.createDataFrame([(-20,), (-1,), (3,), (59,), (60,), (-21,), (None,)], "doc_id long")
    for block in (1_000_000, 1):
        monkeypatch.setattr(token_files, "BROADCAST_FILES", block)
        found = token_files.lookup(spark, manifest, wanted, "doc_id").collect()
        want = [(k - 20, f"text {k}") for k in (0, 19, 23, 79)] + [(3, f"again {k}") for k in range(25)]
        assert sorted((r.doc_id, tuple(r.ids)) for r in found) == sorted((k, (*library.encode(t, add_special_tokens=False).ids, 1)) for k, t in want)
    monkeypatch.undo()
    shared.small_batches(spark)


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=400))
def test_the_hash_is_minimal_and_perfect(keys):
    key = np.array(sorted(keys), np.int64)
    _, slot = token_files.build_index(key, np.ones(len(key), bool))
    assert sorted(slot.tolist()) == list(range(len(key)))


# ---- 10: language id


def test_gradients_are_those_of_the_loss():
    net = language_id.Network.fresh(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(97, 105, (5, 4)).astype(np.uint8)
    target, weight = np.eye(2)[[0, 1, 0, 1, 1]], np.arange(1.0, 6.0)
    _, grad = net.gradients(x, target, weight)
    for name, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = net.p[name][at]
        loss = []
        for e in (1e-4, -1e-4):
            net.p[name][at] = keep + e
            loss.append(net.gradients(x, target, weight)[0])
        net.p[name][at] = keep
        assert abs((loss[0] - loss[1]) / 2e-4 - g[at]) < 1e-4 * max(1.0, abs(g[at])) + 1e-5


def test_languages_of_held_out_texts(spark):
    import random

    rnd, stems = random.Random(1), {"en": ["the", "ing", "wh", "tion"], "de": ["der", "sch", "ung", "ß"], "fr": ["eau", "que", "é", "ou"]}
    text = lambda lang: " ".join("".join(rnd.choices(stems[lang], k=2)) for _ in range(12))
    rows = [(k, text(lang), lang) for k in range(240) for lang in [list(stems)[k % 3]]]
    rows += [(1000, None, "en"), (1001, "123 ... 456", "de"), (1002, "", None), (1003, "the ing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("mine"), "extra": F.lit(1)})
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    held = {r.doc_id for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()}
    right = [got[k].lang_pred == lang for k, _, lang in rows[:240] if k in held]
    assert sum(right) >= 0.97 * len(right) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "en"


def _plain_scores(net, text):
    """Mean distribution over the bytes of words with a letter, from a network run byte by byte in plain Python."""
    import math

    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    size = language_id.HIDDEN
    squash = lambda x: 1 / (1 + math.exp(-x))

    def states(d, letters):
        h, out = [0.0] * size, []
        for c in letters:
            fed = [a + b for a, b in zip(p[f"w{d}"][c], p[f"b{d}"], strict=True)]
            own = [sum(h[i] * p[f"u{d}"][i][j] for i in range(size)) for j in range(3 * size)]
            z = [squash(fed[j] + own[j]) for j in range(size)]
            r = [squash(fed[size + j] + own[size + j]) for j in range(size)]
            n = [math.tanh(fed[2 * size + j] + r[j] * own[2 * size + j]) for j in range(size)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(size)]
            out.append(h)
        return out

    total, count = [0.0] * len(net.langs), 0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode()):
        if not re.search(rb"[A-Za-z\x80-\xff]", word):
            continue
        for at in range(0, len(word), language_id.SPAN):
            span = word[at : at + language_id.SPAN]
            for f, b in zip(states("f", span), states("b", span[::-1])[::-1], strict=True):
                raw = [math.exp(sum(v * p["out"][i][c] for i, v in enumerate(f + b)) + p["bias"][c]) for c in range(len(net.langs))]
                total = [t + x / sum(raw) for t, x in zip(total, raw, strict=True)]
                count += 1
    return [t / max(1, count) for t in total], count


def test_predictions_equal_a_network_run_byte_by_byte(spark, tricky):
    net = language_id.Network.fresh(["aa", "bb", "cc"], 8)
    rows = [(k, t) for k, t in enumerate(["one two", "é ß 12 !!", "x" * 60 + " y", "12 34", "", None, "The THE the\tqu\xa0ick 日本", "a-b c3 ..."])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in language_id.predict(docs, net).collect():
        scores, count = _plain_scores(net, r.text or "")
        if count and re.search(r"[^\W\d_]", r.text or ""):
            assert r.lang_pred == net.langs[int(np.argmax(scores))] and abs(r.score - max(scores)) < 1e-5
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_held_out_documents_of_the_tables(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the supplied tables are not here")
    found = language_id.op10_byte_network(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = found.agg(F.avg(F.expr("int(lang_pred = lang)")), F.count("*")).first()
    assert n > 150 and right >= 0.97


def test_rare_languages_and_hot_keys_are_learned(spark):
    import random

    rnd, stems = random.Random(2), {"en": ["the", "ing", "wh", "tion"], "xx": ["zk", "vyp", "jem"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(stems[lang], k=2)) for _ in range(n))
    rows = [(k, text("en", 300) + "".join(f" q{rnd.random()}" for _ in range(60)), "en") for k in range(300)] + [(9000 + k, text("xx", 3), "xx") for k in range(3)]
    docs = spark.createDataFrame(rows + [(7, "the same key", "en")] * 2000, "doc_id long, text string, lang string")
    assert language_id._chosen(docs.select(F.col("doc_id").alias("key"), "text", "lang"), 10).count() == 13
    assert language_id.samples(docs).count() == 303
    net = language_id.train(docs)
    assert net.langs == ["en", "xx"]
    long = spark.createDataFrame([(1, "z" * 200_000 + " " + text("en", 40_000)), (2, text("xx", 30))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(long, net).collect()} == {1: "en", 2: "xx"}


def test_all_labelled_documents_are_counted(spark, monkeypatch):
    """Every text counts its words, and the marks come from all held-out scores."""
    seen = {}
    monkeypatch.setattr(language_id, "fit", lambda langs, words, counts: seen.update(langs=langs, counts=dict(zip(words, counts.tolist(), strict=True))))
    rows = [(k, "stone river stone", "en") for k in range(900)] + [(k, "fluss", "de") for k in range(700)] + [(5, "stone river", "en"), (6, None, "en"), (7, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language_id.train(docs)
    assert seen == {"langs": ["de", "en"], "counts": {b"fluss": [700, 0], b"river": [0, 900], b"stone": [0, 1799]}}
    split = {(r.lang, r.check): r.n for r in language_id.samples(docs).groupBy("lang", "check").agg(F.count("*").alias("n")).collect()}
    assert split["en", True] + split["en", False] == 900 and split["de", True] + split["de", False] == 700 and 250 < split["en", True] < 350
    rng = np.random.default_rng(6)
    scores = {"en": rng.random(3000).tolist() + [0.001] * 3, "de": (0.9 + rng.random(1700) * 1e-5).tolist(), "xx": [0.4]}
    got = language_id._low(spark.createDataFrame([(v, x) for v, xs in scores.items() for x in xs], "lang string, score double"))
    assert got == {v: float(np.quantile(x, language_id.LOW_SHARE, method="lower")) for v, x in scores.items()}


def test_nothing_to_learn_from(spark, tricky, nothing):
    assert language_id.train(nothing) is None
    assert {r.lang_pred for r in language_id.predict(tricky, None).collect()} == {"und"}


# ---- 2: repeats


def _without_repeats(docs):
    first = {}
    for k, t in sorted(docs, key=lambda d: d[0]):
        w = words_of(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    out = {}
    for k, t in docs:
        w, gone = words_of(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone |= set(range(i, i + 13))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(6 if seed == 0 else 400)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 60))] for _ in range(12)]
    docs = []
    for k in range(90):
        w = []
        for _ in range(rnd.randrange(0, 6)):
            w += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 30))]
            w += ["same"] * rnd.choice((0, 0, 1, 30))
        docs.append((k, None if k == 7 else " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == _without_repeats(docs)


def test_long_symbols_arise_and_decide(spark):
    import random

    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(400)]
    docs = [(k, " ".join([*(word() for _ in range(40)), *passage[k * 7 :], *(word() for _ in range(40))])) for k in range(6)]
    named = []
    for _, t in docs:
        (w,) = substring_dedup.W.words(pa.array([t]))
        name, code, _, start, size = substring_dedup.stretches(w).long
        assert len(size) and size.min() >= 1  # of 13 words or more
        named.append(set(zip(name.tolist(), code.tolist(), strict=True)))
    assert all(len(named[0] & other) >= 5 for other in named[1:])
    df = spark.createDataFrame(docs, "doc long, text string")
    hot = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    rows = df.mapInArrow(substring_dedup._cut_long(hot), substring_dedup.LONG).repartition("key").sortWithinPartitions("key", "code", "doc").mapInArrow(substring_dedup._resolve_long, substring_dedup.ROWS)
    decided = sum(int(substring_dedup._unpack(np.array([r.pos]))[1][0]) for r in rows.where(f"state = {substring_dedup.DONE}").collect())
    assert decided > 600
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df.withColumnRenamed("doc", "doc_id")).collect()}
    assert got == _without_repeats(docs)


def test_frequent_symbols_are_split(spark, monkeypatch):
    import random

    rnd = random.Random(7)
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", 4)
    word = lambda: f"w{rnd.randrange(30)}"
    stock = "every one of these texts has this line".split()
    docs = [(k, " ".join([*(word() for _ in range(rnd.randrange(20))), *stock, *(word() for _ in range(rnd.randrange(30)))])) for k in range(120)]
    docs += [(200 + k, docs[k][1]) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert len(substring_dedup._frequent(df.withColumnRenamed("doc_id", "doc")))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == _without_repeats(docs)


def test_repeats_in_tricky_rows(tricky, nothing):
    rows = substring_dedup.remove_repeats(tricky).collect()
    assert len(rows) == tricky.count() and sum(r.n_removed for r in rows if r.doc_id == 11) == 15
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 11)
    assert substring_dedup.remove_repeats(nothing).count() == 0


# ---- 3: similarity


def _similar(docs):
    sets, root = {}, {k: k for k, _ in docs}
    for k, t in docs:
        w = words_of(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, _ in docs:
        for b, _ in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k, _ in docs}


@pytest.mark.parametrize("small", [2, 16])
def test_components_equal_brute_force(spark, small, monkeypatch):
    import random

    rnd = random.Random(small)
    for name, value in (("SMALL", small), ("BLOCK", 4), ("CENTRES", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    vocabulary = [f"W{k}" for k in range(300)]
    docs = []
    for _ in range(8):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 80))]
        for _ in range(rnd.choice((1, 2, 25))):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, len(w) // 25) + 1)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            docs.append((len(docs), rnd.choice((" ".join(w), " ".join(w).lower(), "  ".join(w)))))
    docs += [(len(docs) + k, t) for k, t in enumerate((None, "", " ", "a", "A", "a b"))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df).collect()}
    assert got == _similar(docs)


def test_links_beside_null_and_repeated_keys(spark):
    words = [f"w{k}" for k in range(100)]
    near = [*words[:50], "other", *words[51:]]
    rows = [(0, " ".join(words)), (1, " ".join(near)), (None, "short text"), (None, " ".join(words)), (0, "quite another text"), (5, "quite another text"), (7, "a b c"), (7, " ".join(near)), (7, "a b c")]
    got = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r.doc_id is not None)
    assert got == [(True, 0, 1, 0), (True, 0, 96, 0), (True, 1, 96, 0), (True, 5, 1, 0), (True, 7, 1, 0), (True, 7, 1, 0), (True, 7, 96, 0)]
    nulls = [r for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id is None) for r in nulls) == [(1, True), (96, True)]


def test_groups_are_bounded_and_opened(spark, monkeypatch):
    """At production parameters, a chain of texts that change step by step goes through the token-group matrix."""
    import random

    rnd, seen = random.Random(3), {}
    docs, w = [], [f"w{k}" for k in range(120)]
    for _ in range(240):
        w = list(w)
        w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        docs += [(len(docs) + k, " ".join(w[:60] + [f"x{rnd.random()}"] * k + w[60:])) for k in range(2)]
    own = jaccard_join._bounded

    def counted(asks, unions):
        out = own(asks, unions)
        seen.update(asked=asks.count(), opened=out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_bounded", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df).collect()}
    assert got == _similar(docs)
    assert 0 < seen["opened"] <= seen["asked"]


def test_similarity_of_tricky_rows(tricky, nothing):
    rows = jaccard_join.similar_components(tricky).collect()
    assert len(rows) == tricky.count() and {r.component_id for r in rows if r.doc_id in (10, 11)} == {10}
    assert jaccard_join.similar_components(nothing).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 5000), min_size=1, max_size=300), st.sets(st.integers(0, 5000), min_size=1, max_size=300))
def test_sketches_never_overstate(x, y):
    a, b = (np.array(sorted(z), np.uint64) for z in (x, y))
    marks = jaccard_join.sketch(a), jaccard_join.sketch(b)
    d = jaccard_join.apart([marks[0]], [marks[1]])[0]
    assert d <= len(x ^ y) and d == jaccard_join.all_apart([marks[0]], [marks[1]])[0, 0]
    bits = jaccard_join.bit_table(a), jaccard_join.bit_table(b)
    assert jaccard_join.all_apart([bits[0]], [bits[1]], np.bitwise_or)[0, 0] <= len(x ^ y)
    assert jaccard_join.missing([bits[0]], [bits[1]])[0] <= len(x - y) and jaccard_join.missing([bits[0]], [bits[0]])[0] == 0


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 150), 100), **dict.fromkeys((200, 201, 202), 200)}


def _sizes_of_plans(monkeypatch, module) -> list[int]:
    """Gets the operators of each plan that the module writes; every line of a plan's text is one."""
    sizes, own = [], module.settled

    def counted(df, name):
        sizes.append(len(df._jdf.queryExecution().sparkPlan().toString().splitlines()))
        return own(df, name)

    monkeypatch.setattr(module, "settled", counted)
    return sizes


def test_components_are_found_by_small_plans(spark, monkeypatch):
    """The driver plans, replans and keeps every plan, so that its memory follows the plans' sizes."""
    sizes = _sizes_of_plans(monkeypatch, graph)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 6000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 6000), 100)}
    assert len(sizes) > 2 and max(sizes) < 60


def test_near_pairs_are_found_by_small_plans(spark, monkeypatch):
    import random

    rnd, sizes = random.Random(3), _sizes_of_plans(monkeypatch, jaccard_join)
    docs, w = [], [f"w{k}" for k in range(120)]
    for _ in range(240):
        w = list(w)
        w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        docs += [(len(docs) + k, " ".join(w[:60] + [f"x{rnd.random()}"] * k + w[60:])) for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df).collect()}
    assert got == _similar(docs)
    assert len(sizes) > 16 and max(sizes) < 150, sizes


# ---- 8: contamination


def test_matches_equal_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30)))) for k in range(30)] + [(30, None), (31, items_text := "same words here")]
    docs = []
    for k in range(80):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 200))]
        item = words_of(rnd.choice(items)[1])
        for _ in range(rnd.randrange(0, 2)):
            if item:
                item[rnd.randrange(len(item))] = "zz"
        docs.append((k, " ".join(w[:50] + item + w[50:]).upper() if k % 3 else " ".join(w)))
    docs += [(80, None), (81, items_text)]
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(words_of(lower(t)))
    sets = {k: shingles(t) for k, t in items}
    want = sorted((d, i, len(s), len(s & shingles(t))) for d, t in docs for i, s in sets.items() if s and 10 * len(s & shingles(t)) >= 8 * len(s))
    one, two = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 100):  # one block, several blocks
        monkeypatch.setattr(contamination, "BLOCK_SHINGLES", size)
        assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in contamination.matches(one, two).collect()) == want
        kept = {r.doc_id for r in contamination.drop_contaminated(one, two).collect()}
        assert kept == {d for d, _ in docs} - {w[0] for w in want}
    # a task holds one block's index at a time, however many blocks there are
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", 30)
    assert len(list(contamination.blocks(two, "item_id", "text"))) > 5
    left = contamination.drop_contaminated(one, two)
    assert left._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and {r.doc_id for r in left.collect()} == kept
    same = contamination.matches(one, two.withColumnRenamed("item_id", "doc_id"), item="doc_id")
    assert same.columns[:2] == ["doc_id", "item_doc_id"] and same.count() == len(want)


def test_contamination_of_tricky_rows(spark, tricky, nothing):
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert contamination.matches(tricky, items).count() == 0 and contamination.drop_contaminated(tricky, items).count() == tricky.count()
    short = tricky.where("doc_id = 10")
    for kind in ("int", "short", "string", "double", "decimal(10,2)", "date"):
        one = short.select(F.lit(1 if kind != "date" else "2026-01-02").cast(kind).alias("item_id"), "text")
        found = contamination.matches(tricky, one).collect()
        assert {r.doc_id for r in found} == {10, 11} and {r.item_id for r in found} == {one.first().item_id}
    assert contamination.matches(nothing, items).count() == 0 and contamination.drop_contaminated(tricky, items.where("false")).columns == tricky.columns


def test_batches_are_as_before_after_other_queries(spark):
    from convoy.llm import registry

    name = "spark.sql.parquet.columnarReaderBatchSize"
    shared.usual_batches(spark)
    before = spark.conf.get(name)
    shared.small_batches(spark)
    shared.small_batches(spark)
    assert spark.conf.get(name) == str(shared.BATCH_ROWS) != before
    assert registry.with_usual_batches(lambda s, _: s.conf.get(name))(spark, "") == before


def test_digest_of_kept_words(spark):
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(1, " a  b\n")], "doc_id long, text string")).select(F.sha2(F.col("kept").cast("binary"), 256)).first()
    assert rows[0] == hashlib.sha256(b"a b").hexdigest()
