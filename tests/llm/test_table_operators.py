"""URL filter, mixing, sharding, vectors and the pipeline against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convoy.llm import contamination, jaccard_join, language_id, mixing, registry, shared, sharding, token_files, url_filter, vector_dedup

# ---- 1: URL filter


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7?x#y", "a://com?/en/", "http://xcom/en/1", "http://com/en/", "x://b://c/d#e", "http://é.NET/de/8"]
    rows = url_filter.judge(spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")).collect()
    got = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert len(rows) == len(urls) + 1 and {r.verdict for r in rows if r.page_id == 0} == {"block"}
    assert got == {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.example.com", "/en/7", "example.com/en/7"), 4: ("com", "", None), 5: ("xcom", "/en/1", None), 6: ("com", "/en/", "com/en/"), 7: ("b:", "//c/d", None), 8: ("é.net", "/de/8", "net/de/")}


def test_clashing_columns_and_no_pages(spark, monkeypatch):
    rows = [(k, f"http://{'a' if k % 2 else 'b'}.{'com/en' if k % 2 else 'net/de'}/{k}", k) for k in range(40)] + [(40, "http://x.org/q", 40), (40, "http://x.org/q", 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n long").withColumns({c: F.lit("mine") for c in ("score", "threshold", "host", "label", "window", "bin", "_url", "a.b")})
    got = url_filter.judge(pages)
    assert sorted(got.columns) == sorted([*[c for c in pages.columns if c not in ("host", "score")], "host", "path", "rule", "verdict", "score"])
    one = {(r.page_id, r.threshold, r["a.b"], r.host, r.verdict, round(r.score, 9)) for r in got.collect()}
    assert got.count() == 42 and {x[1:3] for x in one} == {("mine", "mine")} and (0, "mine", "mine", "b.net", "allow") in {x[:5] for x in one}
    monkeypatch.setattr(url_filter, "BROADCAST_WINDOWS", 5)  # frequent windows broadcast, the others shuffled
    two = {(r.page_id, r.threshold, r["a.b"], r.host, r.verdict, round(r.score, 9)) for r in url_filter.judge(pages).collect()}
    assert one == two
    assert url_filter.judge(pages.where("false")).count() == 0


def _models(labelled):
    """Log ratio of a window from counts of all contexts, by plain loops."""
    counts = {True: Counter(), False: Counter()}
    windows = lambda u: [s[i : i + 4] for s in ["\x02" * 3 + u + "\x03"] for i in range(len(s) - 3)]
    for u, ok in labelled:
        for w in windows(u):
            for k in range(4):
                counts[ok][w[3 - k :]] += 1
                counts[ok][(k, w[3 - k : 3])] += 1

    def probability(c, w):
        p = 1 / 256
        for k in range(4):
            p = (c[w[3 - k :]] + 4 * p) / (c[(k, w[3 - k : 3])] + 4)
        return p

    return lambda u: sum(math.log(probability(counts[True], w)) - math.log(probability(counts[False], w)) for w in windows(u)) / len(windows(u))


def test_scores_equal_plain_loops(spark):
    rnd = random.Random(2)
    urls = [f"http://{rnd.choice(['ab', 'cd', 'xy'])}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'de', 'es'])}/{rnd.randrange(50)}" for _ in range(120)]
    rows = [(u, ".com" in u if k % 3 else None, k % 5 != 0) for k, u in enumerate(dict.fromkeys(urls))]
    want = _models([(u, ok) for u, ok, fold in rows if ok is not None and fold])
    got = {r.url: r.score for r in url_filter.scores(spark.createDataFrame(rows, "url string, label boolean, train boolean")).collect()}
    assert set(got) == {r[0] for r in rows} and all(abs(s - want(u)) < 1e-9 for u, s in got.items())


def test_threshold_splits_the_labels_best(spark):
    rows = [(0.5, True)] * 5 + [(-0.5, False)] * 5 + [(0.1, False), (0.2, True)]
    assert -0.5 < url_filter.threshold(spark.createDataFrame(rows, "score double, label boolean")).first()[0] <= 0.2
    assert url_filter.threshold(spark.createDataFrame([(0.5, True)], "score double, label boolean")).first()[0] == 0


# ---- 4: mixing


def _water(budget, nodes):
    """Splits a budget among (capacity, weight) by filling the fullest first."""
    left, share = dict(nodes), {}
    while left:
        weight = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if c <= budget * w / weight]
        if not full:
            return share | {k: budget * w / weight for k, (_, w) in left.items()}
        k = min(full, key=lambda n: left[n][0] / left[n][1])
        share[k] = left.pop(k)[0]
        budget -= share[k]
    return share


def test_budgets_equal_plain_filling(spark):
    rnd = random.Random(4)
    leaves = [(d, lang, s, rnd.randrange(1, 500)) for d in "ab" for lang in ("x", "y", "") for s in ("p", "q", "r")]
    df = spark.createDataFrame(leaves, "l0 string, l1 string, l2 string, have long")
    weights = [{"a": 3.0}, {"x": 0.5}, {"p": 2.0}]
    for share in (0.1, 0.7, 1.0):
        got = {(r.l0, r.l1, r.l2): r.budget for r in mixing.leaf_budgets(df, ["l0", "l1", "l2"], weights, F.floor(F.sum("have") * F.lit(share)), 1).collect()}
        sums = defaultdict(int)
        for *path, n in leaves:
            for k in range(4):
                sums[tuple(path[:k])] += n
        goal = {(): math.floor(sums[()] * share)}
        for k in range(3):
            for parent in [p for p in list(goal) if len(p) == k]:
                kids = {p: (sums[p], weights[k].get(p[-1], 1.0)) for p in sums if len(p) == k + 1 and p[:k] == parent}
                goal |= _water(goal[parent], kids)
        assert all(abs(b - math.floor(goal[p] + 1e-6)) <= 1 for p, b in got.items()) and len(got) == len(leaves)


def test_selection_is_a_prefix_of_the_order(spark, tricky, nothing):
    docs = spark.createDataFrame([(k, "x" * (k % 37 * 4), "en", f"s{k % 2}") for k in range(300)], "doc_id long, text string, lang string, source string")
    tree = {"source": F.col("source")}
    chosen = mixing.mix(docs, "doc_id", "text", tree, [{"s0": 3.0, "s1": 1.0}], 0.5, 2, 9).collect()
    total = sum(k % 37 for k in range(300))
    per = Counter()
    for r in chosen:
        per[r.source] += r.mix_tokens
    assert sum(per.values()) <= total * 0.5 and sum(per.values()) > total * 0.5 - 2 * 37 and per["s0"] > 2 * per["s1"]
    again = mixing.mix(docs.repartition(7), "doc_id", "text", tree, [{"s0": 3.0, "s1": 1.0}], 0.5, 2, 9).collect()
    assert {(r.doc_id, r.epoch) for r in chosen} == {(r.doc_id, r.epoch) for r in again}
    out = mixing.mix(tricky, "doc_id", "text", mixing.tree(), [mixing.DOMAINS, mixing.LANGUAGES, {}], 1.0)
    assert set(tricky.columns) < set(out.columns) and out.count() > 0
    clash = docs.withColumns({"epoch": F.lit("mine"), "mix_tokens": F.lit("mine"), "_key": F.lit("mine"), "_tokens": F.lit("mine"), "epochs": F.lit("mine"), "last": F.lit("mine"), "_level_0": F.lit("mine")})
    named = mixing.mix(clash, "doc_id", "text", tree, [{"s0": 3.0, "s1": 1.0}], 0.5, 2, 9, added=("_e", "_t"))
    assert named.columns == [*clash.columns, "_e", "_t"] and {(r.doc_id, r._e) for r in named.collect()} == {(r.doc_id, r.epoch) for r in chosen}
    assert {(r.epoch, r.mix_tokens, r._key, r.last) for r in named.collect()} == {("mine",) * 4}
    assert mixing.mix(clash, "doc_id", "text", tree, [{}], 0.5).select("epoch", "mix_tokens").dtypes == [("epoch", "int"), ("mix_tokens", "bigint")]
    assert mixing.mix(nothing, "doc_id", "text", mixing.tree(), [{}, {}, {}], 0.5).count() == 0


# ---- 5: sharding


def test_shards_hold_their_law(spark, tricky, nothing):
    docs = spark.range(20_000).select(F.col("id").alias("k"))
    rows = sharding.shard(docs, "k", sharding.Tree.regular(24), sharding.Tree.regular(25)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(len(s) - 20_000 / 24) < 160 for s in slots.values())
    assert abs(sum(r.grown_shard == 24 for r in rows) - 800) < 150
    again = {r.k: r.shard for r in sharding.shard(docs.where("k % 7 = 0").repartition(3), "k", sharding.Tree.regular(24)).collect()}
    assert all(again[r.k] == r.shard for r in rows if r.k % 7 == 0)
    assert sharding.shard(tricky, "doc_id", sharding.Tree.regular(3), keep=("text",)).count() == tricky.count()
    assert sharding.shard(nothing, "doc_id", sharding.Tree.regular(3)).count() == 0


def _plain_shard(key, levels, seed=17):
    """The tree's descent in plain Python, with the public xxHash of Spark's function of that name."""
    import struct

    import xxhash

    node = 0
    for level, parents in enumerate(levels):
        best = None
        for child, weight in parents[node]:
            h = 42
            for kind, v in (("<q", key), ("<i", child), ("<i", level), ("<i", seed)):
                h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
            ring = -math.log(((h >> 11) + 0.5) / 2**53) / weight
            best = min(best or (math.inf, 0), (ring, child))
        node = best[1]
    return node


def test_shards_equal_plain_draws_and_grow_into_the_new_one_only(spark):
    import zlib

    docs = spark.createDataFrame([(k * 977 - 3000, None if k % 50 == 0 else f"té{k}" * (k % 9)) for k in range(600)], "doc_id long, text string")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    tree = sharding.Tree.regular(24)
    for r in sharding.place_documents(docs).collect():
        own = _plain_shard(r.doc_id, tree.levels)
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id]), "key", own)
        assert r.grown_shard == _plain_shard(r.doc_id, tree.grown().levels) and r.grown_shard in (own, 24)
    keys = spark.range(5000).select(F.col("id").alias("k"))
    place = lambda t: {r.k: r.shard for r in sharding.shard(keys, "k", t).collect()}
    before = place(tree)
    for new in range(24, 30):
        tree = tree.grown()
        after = place(tree)
        moved = [k for k in before if before[k] != after[k]]
        assert moved and {after[k] for k in moved} == {new} and abs(len(moved) - 5000 / (new + 1)) < 75
        before = after


def test_weights_move_rows_only_where_they_change(spark):
    weights = [1.0] * 24
    docs = spark.range(8000).select(F.col("id").alias("k"))
    before = {r.k: r.shard for r in sharding.shard(docs, "k", sharding.Tree.weighted(weights)).collect()}
    after = {r.k: r.shard for r in sharding.shard(docs, "k", sharding.Tree.weighted([3.0 if s == 5 else 1.0 for s in range(24)])).collect()}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    # rack 1 holds shards 4 to 7, region 0 shards 0 to 11: all that moves goes down that path
    assert moved and all(b in range(12) for _, b in moved) and all(b in range(4, 8) for a, b in moved if a in range(12)) and all(b == 5 for a, b in moved if a in range(4, 8))
    assert Counter(after.values())[5] > 2.3 * 8000 / 26


# ---- 9: vectors


@pytest.mark.parametrize("run", [4, 32])
def test_links_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "RUN", run)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])], int(rng.integers(0, 2))))
    rows += [(len(rows) + k, [float(x) for x in np.ones(16) + rng.normal(size=16) * 0.01], 1) for k in range(60)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 15 + [None], 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 0.0], 1)]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    fine = [(k, np.array(v, np.float32).astype(float), lab) for k, v, lab in rows if k < 900]
    links, root = Counter(), {k: k for k, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, u, la) in enumerate(fine):
        for b, v, lb in fine[i + 1 :]:
            if la == lb and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= links[k] for k, r in got.items()) and found >= 0.97 * sum(links.values())
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 907))
    assert sum(got[k].component_id == find(k) for k, *_ in fine) >= 0.97 * len(fine)


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_recall_around_the_threshold(spark, monkeypatch, bits):
    monkeypatch.setattr(vector_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(vector_dedup, "MOST_BITS", bits)
    rng, n = np.random.default_rng(bits), 5500
    x = vector_dedup.unit(rng.normal(size=(n, 64)))
    z = rng.normal(size=(n, 64))
    z = vector_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.90, 0.97, (n, 1))
    rows = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    units = vector_dedup.unit(rows)
    want = np.zeros(2 * n, int)
    for k in range(0, 2 * n, 500):
        want[k : k + 500] = (units[k : k + 500] @ units.T >= 0.93).sum(1) - 1
    assert all(got[k] <= want[k] for k in range(2 * n)) and want.sum() > 6000
    assert sum(got.values()) >= 0.98 * want.sum()


def test_vectors_that_repeat_or_share_an_id(spark):
    rng = np.random.default_rng(9)
    a, b = (rng.normal(size=64).tolist() for _ in range(2))
    rows = [(5, a, "x", "mine"), (5, a, "x", "mine"), (9, a, "x", "mine"), (5, b, "x", "mine"), (2, b, "x", "mine"), (1, a, "y", "mine"), (None, a, "x", "mine")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links string").withColumns({"cid": F.lit(1), "t": F.lit(1), "vec": F.lit(1)})
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, False), (1, 0, 1, True), (2, 1, 2, True), (5, 1, 2, False), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)]


def test_no_vectors(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd, folder = random.Random(8), tmp_path_factory.mktemp("corpus")
    text = lambda n: " ".join(rnd.choice(["the", "thing", "wh", "tion", "ather", "onder"]) + rnd.choice(["", "ing", "s", str(rnd.randrange(9))]) for _ in range(n))
    item = text(20)
    rows = [(k, text(rnd.randrange(20, 80)), "en", f"src{k % 12}") for k in range(60)]
    rows += [(60, rows[3][1], "en", "src1"), (61, rows[4][1] + " more", "en", "src2"), (62, f"{text(30)} {item} {text(9)}", "en", "src3"), (63, "12 34 !!", "en", "src3"), (64, None, "en", None), (65, text(40), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_does_its_work(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, corpus).cache()
        assert kept.columns == docs.columns
        seen.append(before - {r.doc_id for r in kept.select("doc_id").collect()})
    assert seen[0] == {63, 64} and seen[1] == {60, 61} and seen[2] == {62} and seen[3]
    out = corpus_pipeline.run(spark, corpus).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in kept.collect())
    assert [r.start for r in out] == list(np.cumsum([0, *[r.n_tokens for r in out]])[:-1])


def test_stages_over_no_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, corpus).count() == 0


@pytest.mark.parametrize("languages", [2, 4])
def test_unlearned_languages_go(spark, languages):
    rnd = random.Random(5)
    stems = dict(zip(["en", "de", "fr", "es", "xx"], (["the", "ing", "wha", "ght"], ["der", "sch", "ung", "lich"], ["eau", "que", "oux", "lle"], ["cio", "ndo", "los", "aba"], ["zk", "vyp", "jem", "krz"]), strict=True))
    text = lambda lang, n: " ".join("".join(rnd.choices(stems[lang], k=2)) for _ in range(n))
    rows = [(k, text(lang, rnd.choice([40, 120])), lang) for k in range(400) for lang in [list(stems)[k % languages]]]
    rows += [(1000 + k, text("xx", 100), None) for k in range(40)]
    rows += [(2000 + k, " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(100)), None) for k in range(40)]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    mine = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(-5.0), "lang_pred": F.lit("mine")})
    again = corpus_pipeline.identify_language(spark, mine, "")
    assert again.columns == mine.columns and {(r.doc_id, r.score, r.lang_pred) for r in again.collect()} == {(k, -5.0, "mine") for k in kept}
    assert len([k for k in kept if k < 1000]) >= 0.98 * 400
    assert len([k for k in kept if 1000 <= k < 2000]) <= 4 and len([k for k in kept if k >= 2000]) <= 4


def test_mixing_budgets_estimated_tokens(spark):
    rows = [(k, "word " * (10 + k % 40), "en" if k % 3 else "es", "src1") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"_epoch": F.lit("mine"), "epoch": F.lit("mine")})
    size = {r[0]: math.ceil(len(r[1]) / 4) for r in rows}
    out = corpus_pipeline.mix_sources(spark, docs, "")
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and {r.epoch for r in out.collect()} == {"mine"} and len(kept) == len(set(kept))
    used = {lang: sum(size[k] for k in kept if rows[k][2] == lang) for lang in ("en", "es")}
    have = {lang: sum(size[r[0]] for r in rows if r[2] == lang) for lang in ("en", "es")}
    budget = math.floor(sum(have.values()) * mixing.SHARE)
    level = _water(budget, {v: (have[v], mixing.LANGUAGES[v]) for v in have})
    assert all(level[v] - max(size.values()) < used[v] <= level[v] for v in used)


def test_the_registry_names_all_thirteen():
    names = sorted(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5 and all(m for m in (contamination, jaccard_join, language_id))


@pytest.mark.parametrize(("stage", "owner", "step"), [("identify_language", language_id, "samples"), ("drop_similar", jaccard_join, "similar_components"), ("write_tokens", token_files, "encode_documents")])
def test_stage_run_first_has_small_batches(spark, nothing, monkeypatch, stage, owner, step):
    """A stage on its own must not hand Python the session's batches of 10,000 rows."""

    class Begun(Exception):
        pass

    def begin(docs):
        raise Begun([spark.conf.get(name) for name in shared.SETTINGS])

    shared.usual_batches(spark)
    monkeypatch.setattr(owner, step, begin)
    with pytest.raises(Begun) as got:
        getattr(corpus_pipeline, stage)(spark, nothing, "")
    assert got.value.args[0] == [str(v) for v in (shared.BATCH_ROWS, shared.BATCH_ROWS, shared.BATCH_BYTES)]
