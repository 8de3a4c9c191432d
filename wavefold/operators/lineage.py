"""Iterative jobs: cutting lineage, following chains, positions in an order."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set and all runs on one machine, a temporary folder is; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wavefold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def follow(nodes: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """(key, at) of all that is reached from ``roots`` (key, at) by the steps of ``nodes`` (key, at, to; one a node).

    The steps double each round, so there are as many rounds as the logarithm of
    the longest chain, each a join that is spread over all nodes.
    """
    reached, jump, count = roots.select(*key, "at"), cut(nodes.filter("to is not null").select(*key, "at", "to")), -1
    while True:
        reached = cut(reached.unionByName(reached.join(jump, [*key, "at"]).select(*key, F.col("to").alias("at"))).distinct())
        if (now := reached.count()) == count:
            return reached
        further = jump.select(*key, F.col("at").alias("to"), F.col("to").alias("_to"))
        count, jump = now, cut(jump.join(further, [*key, "to"]).select(*key, "at", F.col("_to").alias("to")))


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt out by ranges of an order, written, with the number of each row's range as _range."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, *order: Column, name: str, weight: Column | None = None, kind: str = "long") -> DataFrame:
    """``df`` with the position of each row (from 0) in a total order, found without a task that sees all rows.

    Rows are dealt out by ranges of the order and counted inside of each range; the
    rows of the ranges before it (one number a range) are added. With ``weight``
    the position is the sum of the weights before, as ``kind``.
    """
    one = F.lit(1) if weight is None else weight
    d = _ranged(df, *order)
    ranges = d.groupBy("_range").agg(F.sum(one).alias("_n"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(_before(Window.orderBy("_range"))), F.lit(0)).alias("_before_range"))  # one row a range
    d = d.withColumn("_in_range", F.coalesce(F.sum(one).over(_before(Window.partitionBy("_range").orderBy(*order))), F.lit(0))).join(ranges, "_range")
    return d.select(*df.columns, (F.col("_before_range") + F.col("_in_range")).cast(kind).alias(name))


def carried(df: DataFrame, *order: Column, value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null at or before each row of a total order, range by range as in ``numbered``."""
    d = _ranged(df, *order)
    ends = d.filter(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ranges = d.select("_range").distinct().join(ends, "_range", "left")
    ranges = ranges.select("_range", F.last("_end", ignorenulls=True).over(_before(Window.orderBy("_range"))).alias("_before_range"))  # one row a range
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_in_range", inside).join(ranges, "_range")
    return d.select(*df.columns, F.coalesce("_in_range", "_before_range").alias(name))
