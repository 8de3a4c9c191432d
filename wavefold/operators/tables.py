"""Joins, counts and set operations on manifests, splits, predictions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefold.operators.evaluate import percentiles
from wavefold.operators.lineage import numbered


def header_detail(headers: DataFrame, details: DataFrame, key: str, detail_key: str) -> DataFrame:
    """Each header with its detail rows: one equality join instead of a query a header."""
    return headers.join(details, headers[key] == details[detail_key])


def members(df: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, the others); a null key is not listed."""
    keys = listed.select(key)
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def with_features(manifest: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """The manifest's rows with their features, joined by key."""
    return manifest.join(features, key)


def without_features(manifest: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """The manifest's rows that have none; an empty table says that the join of ``with_features`` is whole."""
    return manifest.join(features.select(key), key, "left_anti")


def keyed_predictions(predictions: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Predictions with the columns of their clip, joined by key (not by position), and is_correct."""
    return predictions.join(manifest, key).withColumn("is_correct", F.col("true_id") == F.col("pred_id"))


def label_conflicts(df: DataFrame, label_id: str = "label_id", label: str = "label") -> DataFrame:
    """Each label id with its least name and whether it has several."""
    return df.groupBy(label_id).agg(F.min(label).alias(label), (F.countDistinct(label) > 1).alias("conflict"))


def label_map(df: DataFrame, label_id: str = "label_id", label: str = "label") -> DataFrame:
    return df.select(label_id, label).dropna().dropDuplicates()


def parameter_grid(df: DataFrame, **values: list) -> DataFrame:
    """Each row with all combinations of the given values."""
    for name, each in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in each])))
    return df


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """The points of a grid that have no output yet."""
    return grid.join(done, grid.columns, "left_anti")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Rows by values of ``column``, 0 where none occurred."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def split_summary(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def length_profile(df: DataFrame, key: str) -> DataFrame:
    """Least, most, whole median and mean of the rows of a key."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    median = percentiles(n.withColumn("all", F.lit(0)), "all", "n", (0.5,)).select(F.col("p")[0].cast("long").alias("median"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean")).crossJoin(F.broadcast(median))  # one row each


def clip_report(segments: DataFrame, key: str, sample_rate: int) -> DataFrame:
    """Number, least, most and mean length in ms of the segments of each recording."""
    ms = (F.col("end") - F.col("start")) / float(sample_rate) * 1000
    return segments.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("least_ms"), F.max(ms).alias("most_ms"), F.avg(ms).alias("mean_ms"))


def align_union(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def class_coverage(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, covers): whether a group has every label of the table."""
    total = df.agg(F.countDistinct(label).alias("_all"))
    return df.groupBy(group).agg(F.countDistinct(label).alias("_n")).crossJoin(F.broadcast(total)).select(group, (F.col("_n") == F.col("_all")).alias("covers"))  # one row


def name_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of both tables (side both) and of the first alone (side left), each once."""
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows with their position from 1 in a total order, found range by range."""
    return numbered(df, *order, name=name).withColumn(name, F.col(name) + 1)


def best_runs(runs: DataFrame, n: int, *, first: str = "test_acc", then: str = "val_acc", key: str = "run") -> DataFrame:
    return runs.orderBy(F.desc(first), F.desc(then), key).limit(n)
