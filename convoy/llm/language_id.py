"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both sides, with its state reset at
white space (and every ``SPAN`` bytes of longer words), and gives each byte
position a distribution over the learned languages.  A document's distribution
is the mean over all positions of words that hold a letter; its best language is
predicted, with that mean as the score.  As a word's positions depend on the
word alone, each distinct word runs through the network once per worker, within
a bounded cache, and every byte of every text still counts.

Training is numpy back-propagation through time with Adam.  Spark counts the words of
all labelled documents by language, and each language's most frequent reach the driver
with their counts, ``TRAIN_WORDS`` shared out evenly, so that every language with a word
is learned; rarer words are not fitted (the documented bound of the classifier).

Null texts and texts without a letter give ``und`` with score 0, as do all texts
when nothing labelled is there to learn from.  Null languages are not learned
from.  Repeated rows are each predicted; further columns can be kept.  Of rows that
share a key and a language one text is learned from.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.llm import words as W
from convoy.llm.shared import settled, table

HIDDEN, SPAN = 16, 24
TRAIN_WORDS, STEPS, BATCH = 24_000, 700, 768
#: Languages up to which their shares are broadcast.
BROADCAST_LANGS = 10_000
#: Share of a language's clean documents that may score below its mark, and the part of the way from chance to it that is asked for.
LOW_SHARE, LOW_PART = 0.005, 0.9
#: Steps between 0 and 1 by which scores are counted before those of one step are ranked.
SCORE_STEPS = 4096
#: Distinct words whose sums a worker keeps.
CACHE_WORDS = 400_000
#: Words that run through the network at once.
SLICE = 2048
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights: per direction ``w`` (256 x 3H, input), ``u`` (H x 3H, state), ``b`` (3H); ``out`` (2H x classes), ``bias``."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"w{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
            p[f"u{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            p[f"b{d}"] = np.zeros(3 * HIDDEN)
        p["out"] = rng.normal(0, 0.3, (2 * HIDDEN, len(langs)))
        p["bias"] = np.zeros(len(langs))
        return Network(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def _pass(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each byte in reading order; x: words x bytes in that order."""
        w, u, b = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        h, out, tape = np.zeros((len(x), HIDDEN), np.float32), [], []
        for t in range(x.shape[1]):
            fed, own = w[x[:, t]] + b, h @ u
            zr = _sigmoid(fed[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(fed[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            if keep:
                tape.append((h, z, r, n, own[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out.append(h)
        return np.stack(out, 1), tape

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distribution over languages at every byte; x: words of one length, words x bytes."""
        both = np.concatenate([self._pass("f", x, False)[0], self._pass("b", x[:, ::-1], False)[0][:, ::-1]], 2)
        return _softmax(both @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross-entropy over all positions, and its gradients, by back-propagation through time."""
        states = {"f": self._pass("f", x, True), "b": self._pass("b", x[:, ::-1], True)}
        both = np.concatenate([states["f"][0], states["b"][0][:, ::-1]], 2)
        prob = _softmax(both @ self.p["out"] + self.p["bias"])
        each = (weight / (weight.sum() * x.shape[1]))[:, None, None].astype(np.float32)
        loss = float(-(each * target[:, None, :] * np.log(prob + 1e-9)).sum())
        slope = each * (prob - target[:, None, :])
        g = {"out": np.einsum("nth,ntc->hc", both, slope), "bias": slope.sum((0, 1))}
        back = slope @ self.p["out"].T
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, ::-1, HIDDEN:])):
            seen, u, tape = x if d == "f" else x[:, ::-1], self.p[f"u{d}"], states[d][1]
            gw, gu = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u)
            carry = np.zeros((len(x), HIDDEN), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, n, own = tape[t]
                dh = part[:, t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * own * r * (1 - r)
                fed = np.concatenate([dz, dr, dn], 1)
                state = np.concatenate([dz, dr, dn * r], 1)
                np.add.at(gw, seen[:, t], fed)
                gu += h.T @ state
                carry = dh * z + state @ u.T
            g[f"w{d}"], g[f"u{d}"], g[f"b{d}"] = gw, gu, gw.sum(0)
        return loss, g


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(langs: list[str], words: list[bytes], counts: np.ndarray, steps: int = STEPS, seed: int = 3) -> Network:
    """Trains on distinct words; counts: words x languages, how often each language has the word."""
    net, rng = Network.fresh(langs, seed), np.random.default_rng(seed)
    share = counts / np.maximum(counts.sum(0), 1)
    target = (share / share.sum(1, keepdims=True)).astype(np.float32)
    weight = np.sqrt(counts.sum(1)).astype(np.float32)
    sizes = np.array([len(w) for w in words])
    groups = [(np.flatnonzero(sizes == n), n) for n in np.unique(sizes)]
    data = [np.frombuffer(b"".join(words[i] for i in g), np.uint8).reshape(len(g), n) for g, n in groups]
    mass = np.array([weight[g].sum() * n for g, n in groups])
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        k = rng.choice(len(groups), p=mass / mass.sum())
        g = groups[k][0]
        pick = rng.integers(0, len(g), min(BATCH, 4 * len(g))) if len(g) > BATCH else np.arange(len(g))
        _, grad = net.gradients(data[k][pick], target[g[pick]], weight[g[pick]])
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in grad.values()))))
        for name, v in grad.items():
            v = v / norm
            first[name] = 0.9 * first[name] + 0.1 * v
            second[name] = 0.99 * second[name] + 0.01 * v * v
            net.p[name] = (net.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# ---- words of texts -------------------------------------------------------


def spans(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, document and hash of every span of at most SPAN bytes of words that hold a letter."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
    has = letters[w.end] > letters[w.start]
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[has]
    start, end, code = w.start[has], w.end[has], w.hash[has]
    pieces = (end - start + SPAN - 1) // SPAN
    if len(pieces) and pieces.max() > 1:
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        split = np.repeat(pieces > 1, pieces)
        start, whole, doc, code = np.repeat(start, pieces) + k * SPAN, np.repeat(end, pieces), np.repeat(doc, pieces), np.repeat(code, pieces)
        end = np.minimum(start + SPAN, whole)
        code = np.where(split, W.mix(code + k.astype(np.uint64), 9), code)
    return start, end, doc, code


class Reader:
    """Sums of a network's position distributions over texts, with a cache of words."""

    def __init__(self, net: Network):
        self.net, self.classes = net, len(net.langs)
        self.known, self.sums = np.zeros(0, np.uint64), np.zeros((0, self.classes), np.float32)

    def _word_sums(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), self.classes), np.float32)
        sizes = end - start
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for k in range(0, len(rows), SLICE):
                part = rows[k : k + SLICE]
                out[part] = self.net.positions(data[start[part][:, None] + np.arange(n)]).sum(1)
        return out

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum over positions of each language's probability, and the number of positions."""
        total, count = np.zeros((len(texts), self.classes)), np.zeros(len(texts), np.int64)
        for w in W.words(texts, lower=True):
            start, end, doc, code = spans(w)
            if not len(start):
                continue
            distinct, one, back = np.unique(code, return_index=True, return_inverse=True)
            place = np.searchsorted(self.known, distinct)
            found = np.zeros(len(distinct), bool)
            inside = place < len(self.known)
            found[inside] = self.known[place[inside]] == distinct[inside]
            sums = np.zeros((len(distinct), self.classes), np.float32)
            sums[found] = self.sums[place[found]]
            new = np.flatnonzero(~found)
            if len(new):
                sums[new] = self._word_sums(w.data, start[one[new]], end[one[new]])
                if len(self.known) + len(new) > CACHE_WORDS:
                    self.known, self.sums = np.zeros(0, np.uint64), np.zeros((0, self.classes), np.float32)
                keys, values = np.concatenate([self.known, distinct[new]]), np.concatenate([self.sums, sums[new]])
                order = np.argsort(keys, kind="stable")
                self.known, self.sums = keys[order], values[order]
            n = w.rows.stop - w.rows.start
            for c in range(self.classes):
                total[w.rows, c] += np.bincount(doc, sums[back, c], n)
            count[w.rows] += np.bincount(doc, end - start, n).astype(np.int64)
        return total, count


_READERS: dict[str, Reader] = {}


def _reader(shared, name: str) -> Reader:
    """The worker's reader of a broadcast network; a worker keeps one."""
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = Reader(shared.value)
    return _READERS[name]


# ---- jobs ------------------------------------------------------------------


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _chosen(rows: DataFrame, most: int) -> DataFrame:
    """``key``, ``lang`` and rank ``_n`` of the first ``most`` keys of each language in the order of a hash.

    Each language's count gives a hash value below which lie some more rows than wanted; only those are ranked, so that no
    task ranks a language.
    """
    keys = settled(rows.select("key", "lang").distinct(), "language-keys")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    shares = keys.groupBy("lang").agg(F.count("*").alias("_all")).select("lang", F.least(F.lit(1.0), F.lit(2.0 * most + 200) / F.col("_all")).alias("_share"))
    few = keys.join(F.broadcast(shares) if shares.count() <= BROADCAST_LANGS else shares, "lang").where(place < F.col("_share") * (1 << 40))
    order = Window.partitionBy("lang").orderBy(place, "key")
    return few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("key", "lang", "_n")


def _once(rows: DataFrame) -> DataFrame:
    """``key``, ``lang`` and ``text``: the least text of rows that share a key and a language; only texts of such rows are shuffled."""
    repeated = settled(rows.groupBy("key", "lang").count().where("count > 1").select("key", "lang"), "language-repeated")
    if repeated.isEmpty():
        return rows
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("key", "lang")]
    alone = rows.alias("a").join(repeated.alias("b"), same, "left_anti").select("key", "lang", "text")
    return alone.unionByName(rows.alias("a").join(repeated.alias("b"), same, "left_semi").groupBy("key", "lang").agg(F.min("text").alias("text")))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on the words of all labelled rows given; None where nothing is labelled."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of some texts by language, with their numbers."""
        for b in batches:
            coded = b.column(1).dictionary_encode()
            own = coded.indices.to_numpy()
            for w in W.words(b.column(0), lower=True):
                start, end, doc, code = spans(w)
                raw, of = w.data.tobytes(), own[w.rows][doc]
                for k in np.unique(of):
                    here = np.flatnonzero(of == k)
                    _, one, n = np.unique(code[here], return_index=True, return_counts=True)
                    found = [raw[a:z] for a, z in zip(start[here[one]].tolist(), end[here[one]].tolist(), strict=True)]
                    langs = pa.array([coded.dictionary[int(k)].as_py()] * len(n), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), langs, pa.array(n.astype(np.int64))], ["word", "lang", "n"])

    words = _once(rows).select("text", "lang").mapInArrow(cut, "word binary, lang string, n long")
    counted = settled(words.groupBy("word", "lang").agg(F.sum("n").alias("count")), "language-words")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not langs:
        return None
    most = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    listed = counted.withColumn("_n", F.row_number().over(most)).where(F.col("_n") <= max(1, TRAIN_WORDS // len(langs))).select("word").distinct()
    top = counted.join(F.broadcast(listed), "word").groupBy("word").agg(F.collect_list(F.struct("lang", "count")).alias("by")).orderBy("word").collect()
    counts = np.zeros((len(top), len(langs)))
    at = {v: k for k, v in enumerate(langs)}
    for k, r in enumerate(top):
        for x in r["by"]:
            counts[k, at[x["lang"]]] = x["count"]
    return fit(langs, [bytes(r["word"]) for r in top], counts)


def samples(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """All labelled rows, one of those that share a key and a language; ``check`` marks some third of each language's, by a hash of
    the key, to be kept from training.  Each language's least key is trained on."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL")
    least = settled(rows.groupBy("lang").agg(F.min("key").alias("_least")), "language-least")
    one = _once(rows).join(F.broadcast(least) if least.count() <= BROADCAST_LANGS else least, "lang")
    check = (F.pmod(F.xxhash64("key"), F.lit(3)) == 0) & (F.col("key") != F.col("_least"))
    return one.select(F.col("key").alias(key), F.col("text").alias(text), F.col("lang").alias(lang), check.alias("check"))


def _low(scores: DataFrame) -> dict[str, float]:
    """Per language of all ``lang``, ``score`` the score at ``LOW_SHARE`` of them, as numpy's lower quantile: counted by steps, then ranked within one step."""
    placed = scores.withColumn("step", F.floor(F.col("score") * SCORE_STEPS))
    steps, wanted = {}, []
    for r in placed.groupBy("lang", "step").count().collect():
        steps.setdefault(r.lang, []).append((r.step, r["count"]))
    for name, parts in steps.items():
        rank = int(LOW_SHARE * (sum(n for _, n in parts) - 1))
        for step, n in sorted(parts):
            if rank < n:
                wanted.append((name, step, rank))
                break
            rank -= n
    if not wanted:
        return {}
    at = scores.sparkSession.createDataFrame(wanted, "lang string, step long, rank long")
    same = placed.join(F.broadcast(at), ["lang", "step"]).groupBy("lang", "rank", "score").count()
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("score"))
    found = same.withColumn("upto", upto).where("upto > rank").groupBy("lang").agg(F.min("score").alias("score"))
    return {r.lang: r.score for r in found.collect()}


def least_scores(checked: DataFrame, net: Network | None, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """Per language the score below which a document is in none of the languages, from labelled rows that were not trained on.

    Of the way from chance (1 / languages) to the score that all but ``LOW_SHARE`` of a language's rightly predicted rows
    reach, ``LOW_PART`` must be gone.  A language without such rows takes the least of the others, or chance where none has any.
    With one language every score is 1 and nothing is told apart.
    """
    if net is None:
        return {}
    chance = 1 / len(net.langs)
    right = predict(checked.select(text, lang), net, text).where(F.col("lang_pred") == F.col(lang)).select(F.col("lang_pred").alias("lang"), "score")
    out = {v: chance + LOW_PART * (x - chance) for v, x in _low(settled(right, "language-scores")).items()}
    rest = min(out.values(), default=chance)
    return {v: out.get(v, rest) for v in net.langs}


def stands_out(least: dict[str, float], added: tuple[str, str] = ("lang_pred", "score")) -> Column:
    """Whether a predicted row reaches the mark of its language."""
    lang, score, mark = F.col(added[0]), F.col(added[1]), F.lit(0.0)
    for name, value in least.items():
        mark = F.when(lang == name, F.lit(value)).otherwise(mark)
    return (lang != "und") & (score >= mark)


def predict(docs: DataFrame, net: Network | None, text: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows with the predicted language and its score behind their columns, under the names in ``added`` (which replace
    any of that name); nothing is shuffled."""
    docs = docs.drop(*added)
    if net is None:
        return docs.withColumns({added[0]: F.lit("und"), added[1]: F.lit(0.0)})
    shared, name, at = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared, name)
        langs = np.array([*net_langs, "und"], object)
        for b in batches:
            texts = b.column(at)
            total, count = reader.documents(texts)
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            known = letter & (count > 0)
            best = np.where(known, total.argmax(1), len(net_langs))
            score = np.where(known, np.clip(total.max(1) / np.maximum(count, 1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs[best], pa.string()), pa.array(score)], [*b.schema.names, *added])

    net_langs = list(net.langs)
    schema = docs.withColumns({added[0]: F.lit("").cast("string"), added[1]: F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)


def op10_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
