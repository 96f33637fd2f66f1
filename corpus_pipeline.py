"""The corpus pipeline: documents in, token-id files and their read-back rows out.

Each stage takes all documents that its predecessor kept, as they were written,
and returns documents with their columns; the last returns the rows of the files.
Stages that go to Python set the session's batches themselves, as each may be the first to run.
ORACLE_SQL is None: no SQL trains the language network or runs the tokenizer's
library.  tests/llm compares every stage with a brute-force version instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import contamination, jaccard_join, language_id, mixing, token_files
from convoy.llm.shared import settled, small_batches, table

#: Ids to drop up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that score less in their language than its held-out documents do."""
    small_batches(spark)
    labelled = language_id.samples(docs)
    net = language_id.train(labelled.where("NOT check"))
    least = language_id.least_scores(labelled.where("check"), net)
    own = tuple(f"{name}_{uuid.uuid4().hex}" for name in ("lang_pred", "score"))  # names that the documents do not have
    return language_id.predict(docs, net, added=own).where(language_id.stands_out(least, own)).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each similarity component."""
    small_batches(spark)
    others = settled(jaccard_join.similar_components(docs).where("component_id <> doc_id").select("doc_id").distinct(), "similar")
    few = others.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(others) if few else others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each source as many tokens as the target weights give it, each document once at most; a token is estimated as four
    bytes, as exact counts would need a Python worker in a stage that is to run in the JVM alone."""
    chosen = mixing.mix(docs, "doc_id", "text", mixing.tree(), [mixing.DOMAINS, mixing.LANGUAGES, {}], mixing.SHARE, 1, mixing.SEED, added=("_epoch", "_counted"))
    return chosen.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' ids to indexed files and returns what the files hold."""
    small_batches(spark)
    return token_files.encode_documents(docs)


STAGES = [
    ("language id", identify_language),
    ("n-gram Jaccard join", drop_similar),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix_sources),
    ("token-id files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
