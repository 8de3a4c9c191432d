"""What the training-data operators share: scratch tables and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of texts that go to a Python worker at once; Spark's default of 64 MB costs several times that in buffers of either side.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the bytes of an Arrow batch for the session where they are Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session. Where it is unset and all runs on one
    machine (tests, a notebook) a temporary folder is set for it; a cluster must
    name one.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wavefold-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet under ``folder`` and read again, which cuts its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    jvm = spark._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def light(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, counted first; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(columns: list[str], prefix: str) -> str:
    """``prefix`` with as many underscores before it as no column of ``columns`` begins with."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(prefix.lower()) for c in taken):
        prefix = "_" + prefix
    return prefix
