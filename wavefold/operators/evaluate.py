"""Evaluation of predictions and latency: accuracy, confusion, percentiles, agreement, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_list(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("cls"))


def accuracy(df: DataFrame, n_classes: int, voice_denominator: bool = False, pred: str = "pred_id") -> DataFrame:
    """total, correct, accuracy in percent; predictions out of range count as class 0.

    Rows with a true class out of range are left out, or with
    ``voice_denominator`` only from the correct ones.
    """
    valid = F.col("true_id").between(0, n_classes - 1)
    p = F.when(F.col(pred).between(0, n_classes - 1), F.col(pred)).otherwise(0)
    right = F.sum((valid & (p == F.col("true_id"))).cast("int"))
    total = F.count(F.lit(1)) if voice_denominator else F.sum(valid.cast("int"))
    return df.agg(total.alias("total"), F.coalesce(right, F.lit(0)).alias("correct")).withColumn("accuracy", 100.0 * F.col("correct") / F.greatest("total", F.lit(1)))


def confusion(df: DataFrame, n_classes: int, pred: str = "pred_id") -> DataFrame:
    """true_id, pred_id, n over all pairs of classes, 0 where none occurred."""
    valid = df.filter(F.col("true_id").between(0, n_classes - 1)).select("true_id", F.when(F.col(pred).between(0, n_classes - 1), F.col(pred)).otherwise(0).alias("pred_id"))
    counts = valid.groupBy("true_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))
    c = class_list(df, n_classes)
    grid = c.select(F.col("cls").alias("true_id")).crossJoin(c.select(F.col("cls").alias("pred_id")))  # n_classes squared
    return grid.join(counts, ["true_id", "pred_id"], "left").select("true_id", "pred_id", F.coalesce("n", F.lit(0)).alias("n"))


def per_class_accuracy(cm: DataFrame) -> DataFrame:
    """true_id, ok, total, pct (0 where a class is empty)."""
    g = cm.groupBy("true_id").agg(F.sum(F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("total"))
    return g.withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("ok") / F.col("total")).otherwise(0.0))


def percentiles(df: DataFrame, group: str, value: str, at: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(group, p): exact percentiles with linear interpolation, one array a group; null values count nothing.

    A mergeable quantile sketch brackets each percentile: its ranks are off by 1 / accuracy of the group at most,
    and the brackets reach twice as far. A second pass counts how many values lie between the brackets
    and how often each value inside of one occurs, and only these, a few thousandths of the
    different values, are sorted. Groups of up to ``accuracy`` rows are sorted as they are.
    """
    d = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    reach = 2 / accuracy
    bounds = [min(1.0, max(0.0, q + side)) for q in at for side in (-reach, reach)]
    sketch = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", bounds, accuracy).alias("_b"))
    sketch = sketch.select(F.col("_g").alias("_of"), "_n", "_b")
    d = d.join(sketch, F.col("_g").eqNullSafe(F.col("_of")))
    inside = F.col("_n") <= accuracy
    for k in range(len(at)):
        inside = inside | F.col("_v").between(F.col("_b")[2 * k], F.col("_b")[2 * k + 1])
    # A value between brackets stands behind the end of the bracket before it, in one class with its like.
    ends = [F.when(F.col("_v") > F.col("_b")[2 * k + 1], F.col("_b")[2 * k + 1]) for k in range(len(at))]
    before = F.greatest(F.lit(float("-inf")), *ends)
    c = d.groupBy("_g", F.when(inside, F.col("_v")).otherwise(before).alias("_x"), (~inside).alias("_out")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    c = c.withColumn("_last", F.sum("_c").over(Window.partitionBy("_g").orderBy("_x", "_out")) - 1)
    asked = [F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("x")) for k, q in enumerate(at)]
    e = c.filter("not _out").select("_g", "_x", "_last", "_c", F.explode(F.array(*asked)).alias("a"))
    low, share = F.floor("a.x"), F.col("a.x") - F.floor("a.x")
    holds = lambda rank: (rank <= F.col("_last")) & (rank > F.col("_last") - F.col("_c"))
    weight = F.when(holds(low), 1 - share).otherwise(0.0) + F.when(holds(F.ceil("a.x")), share).otherwise(0.0)
    e = e.withColumn("_w", weight).filter(holds(low) | holds(F.ceil("a.x"))).groupBy("_g", F.col("a.k").alias("k")).agg(F.sum(F.col("_x") * F.col("_w")).alias("p"))
    return e.groupBy("_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("p")).select(F.col("_g").alias(group), "p")


def latency_summary(df: DataFrame, phase: str, value: str) -> DataFrame:
    """Mean, p50, p90, p99 (linear interpolation) and maximum of each phase."""
    g = df.groupBy(phase).agg(F.avg(value).alias("mean"), F.max(value).alias("most"))
    p = percentiles(df, phase, value, (0.5, 0.9, 0.99)).withColumnRenamed(phase, "_phase")
    j = g.join(p, F.col(phase).eqNullSafe(F.col("_phase")), "left")
    return j.select(phase, "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "most")


def energy(summary: DataFrame, watts: float) -> DataFrame:
    return summary.withColumn("energy_mj", F.col("mean") * watts)


def rail_power(readings: DataFrame, value: str) -> DataFrame:
    """Sum of readings in microwatts as watts; what is not a number is skipped."""
    return readings.agg((F.coalesce(F.sum(F.col(value).try_cast("double")), F.lit(0.0)) * 1e-6).alias("watts"))


def class_weights(df: DataFrame, label: str, classes: DataFrame, power: float = 1.0) -> DataFrame:
    """cls, n, weight: (total / max(n, 1)) ^ power over its mean, over all classes."""
    n = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    d = classes.join(n, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a class
    raw = F.pow(F.sum("n").over(every) / F.greatest("n", F.lit(1)), power)
    return d.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.avg("_w").over(every)).drop("_w")


def sample_weights(df: DataFrame, weights: DataFrame, boosts: DataFrame, reviewed: Column, source_weight: float = 2.5, old_weight: float = 1.25) -> DataFrame:
    """Rows with weight: class weight x source weights x class boost. The two tables have one row a class."""
    d = df.join(weights.select(F.col("cls").alias("label_id"), F.col("weight").alias("_cw")), "label_id")
    d = d.join(boosts.select("label", "boost"), "label", "left")
    source = F.when(reviewed, source_weight).otherwise(1.0) * F.when(F.col("source") == "old", old_weight).otherwise(1.0)
    return d.withColumn("weight", F.col("_cw") * source * F.coalesce("boost", F.lit(1.0))).drop("_cw", "boost")


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """bin, n over [min, max] in equal widths, the last bin closed; empty bins are 0."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    n = df.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, a: str = "pred_id", b: str = "q88_pred_id") -> DataFrame:
    """By true class: rows, rows where both predictions agree, and the accuracy of each."""
    mean = lambda c: 100.0 * F.avg(c.cast("int"))
    return df.groupBy("true_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(a) == F.col(b)).cast("int")).alias("agree"), mean(F.col(a) == F.col("true_id")).alias("accuracy_a"), mean(F.col(b) == F.col("true_id")).alias("accuracy_b"),
    )


def first_of_each(df: DataFrame, label: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order))).filter("_r = 1").drop("_r")


def motion_score(df: DataFrame, key: str) -> DataFrame:
    """Mean gyroscope norm plus half the mean accelerometer norm."""
    norm = lambda *c: F.sqrt(sum(F.col(x) * F.col(x) for x in c))
    return df.groupBy(key).agg((F.avg(norm("gyro_x", "gyro_y", "gyro_z")) + 0.5 * F.avg(norm("acc_x", "acc_y", "acc_z"))).alias("motion_score"))


def voice_score(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sqrt(F.avg(F.col("v") * F.col("v")) + 1e-12).alias("voice_score"))


def focal_loss(df: DataFrame, p: str = "p", weight: str | None = None, gamma: float = 1.5) -> DataFrame:
    """Weighted mean of (1 - p)^gamma * -log p over rows with the probability of the true class."""
    q = F.greatest(F.col(p), F.lit(1e-12))
    loss = F.pow(1 - q, gamma) * -F.log(q)
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(loss * w) / F.sum(w)).alias("loss"))
