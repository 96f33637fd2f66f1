"""What the operators of this folder have in common: tables, the shared folder, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch sent to Python; texts of some kilobytes make batches of some megabytes.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Tasks that share the rows of one key in a ``split_join``.
SPLIT = 16


#: What ``small_batches`` sets: the reader's rows, and the rows and bytes of a batch for Python.
SETTINGS = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
_BEFORE = "convoy.before."


def small_batches(spark: SparkSession) -> None:
    """From here on, until ``usual_batches``, the session hands Python batches of bounded rows and bytes, and reads Parquet in batches as small."""
    for name, value in zip(SETTINGS, (BATCH_ROWS, BATCH_ROWS, BATCH_BYTES), strict=True):
        if spark.conf.get(_BEFORE + name, None) is None:
            spark.conf.set(_BEFORE + name, spark.conf.get(name))
        spark.conf.set(name, str(value))


def usual_batches(spark: SparkSession) -> None:
    """Puts back what ``small_batches`` has changed."""
    for name in SETTINGS:
        if (before := spark.conf.get(_BEFORE + name, None)) is not None:
            spark.conf.set(name, before)
            spark.conf.unset(_BEFORE + name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, for a session of small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where the session leaves it unset,
    a folder of our own; that only on a single machine, as a cluster's machines share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="convoy-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back, so that a lost executor
    costs no more than the files' reader."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_join(many: DataFrame, few: DataFrame, key: str, part: str = "doc") -> DataFrame:
    """Join of rows of which a key may have very many, and rows of which it has few: the former are split by ``part`` over SPLIT
    tasks, the latter repeated for each."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("_split")
    own = F.pmod(F.xxhash64(part), F.lit(SPLIT)).cast("int")
    return many.withColumn("_split", own).join(few.select("*", spread), [key, "_split"]).drop("_split")
