"""Chunking of documents and hybrid retrieval."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from convoy.functions import text

VECTOR_SHARE, WORD_SHARE = 0.7, 0.3
#: Questions that are broadcast at once (some 3 KB each), and words whose hashes a worker keeps.
QUESTION_BLOCK, KNOWN_WORDS = 2000, 100_000
#: Chunks that are scored at once, and their words up to which they are (one chunk at least).
CHUNK_ROWS, CHUNK_WORDS = 256, 200_000


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """Sections of markdown documents: ``tenant_id``, ``source``, ``text`` in; id, section, title and text out.

    What stands before the first second-level heading is the overview; sections without text are left out.
    """
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#[ \t]+(.+)$", 1), F.lit("")), F.col("source"))
    parts = docs.select("tenant_id", "source", title.alias("doc_title"), F.posexplode(F.split(F.col("text"), r"(?m)^##\s+")).alias("pos", "part"))
    heading = F.trim(F.get(F.split("part", "\n", 2), F.lit(0)))
    body = F.regexp_replace(F.coalesce(F.get(F.split("part", "\n", 2), F.lit(1)), F.lit("")), r"^\s+|\s+$", "")
    intro = F.regexp_replace("part", r"^\s+|\s+$", "")
    first = F.col("pos") == 0
    rows = parts.select("*", F.when(first, "Overview").otherwise(heading).alias("section"), F.when(first, intro).otherwise(body).alias("body")).where("body <> ''")
    slug = F.regexp_replace(F.lower("section"), r"\s+", "-")
    return rows.select(
        "tenant_id", F.concat("source", F.lit("#"), F.when(first, "overview").otherwise(slug)).alias("chunk_id"), "source", "section", "doc_title",
        F.when(first, F.col("body")).otherwise(F.concat(F.lit("# "), "doc_title", F.lit("\n## "), "section", F.lit("\n"), "body")).alias("text"),
    )


def word_counts(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """A row per key and distinct word ``t`` with its number ``n``."""
    return df.select(*keys, F.explode(text.tokens(F.col(body))).alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("n"))


def vectors_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse unit vectors of hashed words from their counts: a row per key and bucket with its ``weight``."""
    buckets = counts.groupBy(*keys, text.embedding_bucket(F.col("t")).alias("bucket")).agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return buckets.withColumn("weight", F.col("n") / norm).drop("n")


def word_vectors(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    return vectors_of(word_counts(df, keys, body), keys)


def retrieve(chunks: DataFrame, question: str, tenant: str, top: int = 3) -> DataFrame:
    """The tenant's best chunks for one question: 0.7 of the cosine and 0.3 of the share of its words that a chunk has.

    The question is a literal, so this is one pass over the tenant's chunks.
    """
    ask = F.lit(question)
    asked = F.array_distinct(text.tokens(ask))
    row = chunks.where(F.col("tenant_id") == tenant)
    vector = text.dot(text.embedding(ask), F.col("embedding") if "embedding" in chunks.columns else text.embedding(F.col("text")))
    shared = F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, text.tokens(F.col("text")))) / F.nullif(F.size(asked), F.lit(0)))
    return row.withColumn("score", VECTOR_SHARE * vector + WORD_SHARE * shared).orderBy(F.desc("score"), "chunk_id").limit(top)


@dataclass
class _Questions:
    """Questions of one tenant: unit vectors (dims x questions), their words' hashes (sorted), which have which word, and their numbers of words."""

    ids: list
    vectors: np.ndarray
    words: np.ndarray
    has: np.ndarray
    sizes: np.ndarray


def _word_hash(words: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[:8]) for w in words], np.uint64)


def _dense(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors over hashed buckets, one of each of ``n`` rows: the bucket is that of ``embedding_bucket``."""
    out = np.zeros((n, text.EMBED_DIMS))
    np.add.at(out, (rows, ((hashes >> np.uint64(48)) % np.uint64(text.EMBED_DIMS)).astype(np.int64)), 1)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _question_block(rows: list) -> dict[str, _Questions]:
    out = {}
    for tenant in sorted({r.tenant_id for r in rows}):
        own = [r for r in rows if r.tenant_id == tenant]
        hashes = [_word_hash(r.words) for r in own]
        at = np.repeat(np.arange(len(own)), [len(h) for h in hashes]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        words, back = np.unique(flat, return_inverse=True)
        has = np.zeros((len(words), len(own)))
        has[back, at] = 1
        out[tenant] = _Questions([r.question_id for r in own], _dense(at, flat, len(own)).T, words, has, np.maximum(has.sum(0), 1))
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded rows and words, so that what is made of a slice does not grow with the batch."""
    upto = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(upto, upto[start] + CHUNK_WORDS, "right")) - 1
        end = min(max(end, start + 1), start + CHUNK_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _best(shared, top: int, schema: pa.Schema):
    """Per task and tenant, the best chunks of every question so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, _Questions] = shared.value
        best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # rounded scores, scores, ids: some rows x questions
        known: dict[str, int] = {}
        for b in (piece for whole in batches for piece in _pieces(whole)):
            tenants = np.array(b.column(0).to_pylist(), object)
            for tenant, q in asked.items():
                part = b.filter(pa.array(tenants == tenant))
                if not part.num_rows:
                    continue
                coded = part.column(2).flatten().dictionary_encode()
                fresh = [w for w in coded.dictionary.to_pylist() if w not in known]
                if len(known) + len(fresh) > KNOWN_WORDS:
                    known.clear()
                    fresh = coded.dictionary.to_pylist()
                known.update(zip(fresh, _word_hash(fresh).tolist(), strict=True))
                hashes = np.array([known[w] for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
                rows = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                cosine = _dense(rows, hashes, part.num_rows) @ q.vectors
                place = np.minimum(np.searchsorted(q.words, hashes), max(len(q.words) - 1, 0))
                hit = q.words[place] == hashes if len(q.words) else np.zeros(len(hashes), bool)
                held = np.zeros((part.num_rows, len(q.words)))
                held[rows[hit], place[hit]] = 1
                score = VECTOR_SHARE * cosine + WORD_SHARE * (held @ q.has) / q.sizes
                rounded = np.where(cosine > 0, np.floor(score * 1e9 + 0.5), -np.inf)  # without a common bucket, a chunk is not found
                own = np.array(part.column(1).to_pylist(), object)
                ids = np.broadcast_to(own[:, None], rounded.shape)
                before = best.get(tenant)
                old = np.zeros((0, len(q.ids)), object) if before is None else before[2]
                place = np.unique(np.concatenate([old.ravel(), own]), return_inverse=True)[1]
                order = np.concatenate([place[: old.size].reshape(old.shape), np.broadcast_to(place[old.size :, None], rounded.shape)])
                if before is not None:
                    rounded, score, ids = (np.concatenate(x) for x in zip(before, (rounded, score, ids), strict=True))
                first = np.lexsort((order, -rounded), axis=0)[:top]
                best[tenant] = tuple(np.take_along_axis(x, first, 0) for x in (rounded, score, ids))
        for tenant, (rounded, score, ids) in best.items():
            i, j = np.nonzero(rounded > -np.inf)
            if len(i):
                columns = ([tenant] * len(i), [asked[tenant].ids[k] for k in j], ids[i, j].tolist(), score[i, j], rounded[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def retrieve_many(chunks: DataFrame, questions: DataFrame, top: int = 3) -> DataFrame:
    """The best chunks of every question of a table, and their rank; a chunk that has no hashed word of a question is not found.

    chunks: ``tenant_id``, ``chunk_id``, ``text``; questions: ``tenant_id``, ``question_id``, ``text``.  Questions are broadcast in
    blocks; each task keeps the best chunks of every question of its tenant, so chunks are neither paired nor shuffled.
    """
    spark = chunks.sparkSession
    asked = questions.where("tenant_id IS NOT NULL").select("tenant_id", "question_id", text.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    number = max(1, -(-asked.count() // QUESTION_BLOCK))
    held = chunks.where("tenant_id IS NOT NULL").select("tenant_id", "chunk_id", text.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    schema = T.StructType([asked.schema["tenant_id"], asked.schema["question_id"], held.schema["chunk_id"], T.StructField("score", T.DoubleType()), T.StructField("order", T.DoubleType())])
    found = None
    for k in range(number):
        rows = asked.where(F.pmod(F.xxhash64("tenant_id", "question_id"), F.lit(number)) == k) if number > 1 else asked
        part = held.mapInArrow(_best(spark.sparkContext.broadcast(_question_block(rows.collect())), top, to_arrow_schema(schema)), schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("tenant_id", "question_id").orderBy(F.desc("order"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("order")


def answer(found: DataFrame, answer_text: Column) -> DataFrame:
    """Citations of the chunks retrieved for one question, which are a few rows, beside the guarded answer."""
    context = found.agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("_context"))
    reason = text.output_reason(answer_text, F.col("_context"))
    return found.crossJoin(F.broadcast(context)).select(
        "source", "section", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("score"), text.snippet(F.col("text")).alias("snippet"),
        F.when(reason.isNull(), text.redact(answer_text)).otherwise(F.concat(F.lit("Answer withheld: "), reason)).alias("answer"),
    )
