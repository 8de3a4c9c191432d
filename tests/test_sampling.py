"""Laws of the hashed samplers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.operators import lineage, sampling


def beta_cdf(alpha: float, at: np.ndarray) -> np.ndarray:
    """The Beta(alpha, alpha) distribution by the midpoint rule, after a substitution that takes its poles away."""
    u = (np.arange(400_000) + 0.5) / 400_000 * np.pi / 2
    density = (np.sin(u) * np.cos(u)) ** (2 * alpha - 1)  # x = sin(u) ** 2
    total = np.cumsum(density)
    return np.interp(np.arcsin(np.sqrt(at)), u, total / total[-1])


@pytest.mark.parametrize("alpha", [0.2, 0.7, 1.0, 2.0, 9.0])
def test_beta_has_its_law(spark, alpha):
    n = 20_000
    x = np.sort([r[0] for r in spark.range(n).select(sampling.beta(alpha, 7, F.col("id"))).collect()])
    want = beta_cdf(alpha, x)
    assert max(np.abs(want - np.arange(n) / n).max(), np.abs(want - np.arange(1, n + 1) / n).max()) < 1.63 / n**0.5  # Kolmogorov and Smirnov, 1 %
    assert abs(np.mean(x < 0.25) - beta_cdf(alpha, np.array([0.25]))[0]) < 0.012


def test_weighted_draws_follow_the_weights(spark):
    d = spark.range(400).select("id", F.when(F.col("id") == 5, 300.0).when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("id") % 7 + 0.5).alias("w"))
    got = sampling.weighted_resample(d, "id", "w", factor=50).groupBy("id").agg(F.count("*").alias("n")).collect()
    w = {r["id"]: r["w"] for r in d.collect() if r["w"] > 0}
    n, total = 50 * len(w), sum(w.values())
    assert sum(r["n"] for r in got) == n and {r["id"] for r in got} <= set(w)
    chi = sum((r["n"] - n * w[r["id"]] / total) ** 2 / (n * w[r["id"]] / total) for r in got) + sum(n * v / total for k, v in w.items() if k not in {r["id"] for r in got})
    assert chi < len(w) + 4 * (2 * len(w)) ** 0.5


def test_many_draws_of_uneven_weights(spark):
    """A million rows at weights 1 to a million: every draw is looked up, in the shares of the weights."""
    n = 1_000_000
    d = spark.range(n).select("id", (F.col("id") + 1).cast("double").alias("w"))
    r = sampling.weighted_resample(d, "id", "w", factor=1).agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.avg((F.col("id") >= n // 2).cast("int")).alias("upper")).first()
    assert r["n"] == r["d"] == n and abs(r["upper"] - 0.75) < 0.002


@pytest.mark.parametrize("n", [0, 1, 500])
def test_last_value_is_carried_over_ranges(spark, n):
    d = spark.range(n).select("id", F.when(F.col("id") % 97 == 3, F.col("id")).alias("v")).repartition(4)
    got = {r["id"]: r["at"] for r in lineage.carried(d, F.col("id"), value="v", name="at").collect()}
    assert got == {i: (i - 3) // 97 * 97 + 3 if i >= 3 else None for i in range(n)}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    """Ties, one value, groups below and above the accuracy, a null group and null values, against numpy."""
    from wavefold.operators import evaluate

    rng = np.random.default_rng(3)
    groups = {"ties": np.repeat([1.0, 5.0, 5.5], [400, 5, 300]), "one": np.full(500, 2.5), "few": np.array([3.0, -1.0]), "wide": rng.normal(size=3000) * 1e6, None: rng.integers(0, 50, 999).astype(float)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("wide", None), ("empty", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(6)
    at = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {r["g"]: r["p"] for r in evaluate.percentiles(d, "g", "v", at, accuracy).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, at), rel=1e-12)
