from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.operators import clean, features, sampling
from wavefold.schemas import AXES, SAMPLE_SCHEMA, require_columns


def window(spark, rows):
    """rows: (measurement, sequence, label_id, label, gyro_x)."""
    return spark.createDataFrame([(m, s, i, lab, float(g), 0.0, 0.0, 1.0, 1.0, 1.0) for m, s, i, lab, g in rows], SAMPLE_SCHEMA)


def test_drop_reasons_in_order(spark):
    rows = [(1, i, 0, "Raise", 9) for i in range(9)]  # too short
    rows += [(2, i, 0, "Raise", 9) for i in range(301)]  # too long
    rows += [(3, i, 0, "Raise" if i else "Chop", 9) for i in range(60)]  # mixed
    rows += [(4, 7, 0, "Raise", 9) for _ in range(60)]  # repeated sequence
    rows += [(5, i, 0, "Raise", 9 if 10 <= i < 49 else 0) for i in range(80)]  # 39 active
    rows += [(6, i, 0, "Raise", 5.0 if 10 <= i < 50 else 0) for i in range(80)]  # 40 active, exactly at the threshold
    rows += [(7, i, 0, "Raise", 0) for i in range(60)]  # no motion: whole window
    got = {r["measurement_id"]: r["reason"] for r in clean.drop_reasons(window(spark, rows)).collect()}
    assert got == {1: "too_short", 2: "too_long_raw", 3: "mixed_label", 4: "bad_seq", 5: "trim_too_short", 6: None, 7: None}


def test_trim_keeps_silent_windows(spark):
    d = window(spark, [(1, i, 0, "Raise", 6 if i in (3, 7) else 0) for i in range(10)] + [(2, i, 0, "Raise", 0) for i in range(4)])
    got = clean.trim_idle(d).groupBy("measurement_id").agg(F.min("sequence_id"), F.max("sequence_id")).collect()
    assert {tuple(r) for r in got} == {(1, 3, 7), (2, 0, 3)}


@pytest.mark.parametrize("n", [1, 2, 39, 40, 41, 59, 60, 61, 120, 299])
def test_resample_matches_bin_copy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, s int, v double")
    got = [r["v"] for r in features.resample_spectral(d, "k", "s", ("v",), 60).orderBy("m").collect()]
    if n == 60:
        want = x
    else:
        spec, out = np.fft.fft(x), np.zeros(60, complex)
        kp = min(n, 60)
        h = kp // 2
        if kp % 2 == 0:
            out[:h], out[-h:] = spec[:h], spec[-h:]
            out[h] = spec[h % n]
        else:
            out[: h + 1] = spec[: h + 1]
            if h:
                out[-h:] = spec[-h:]
        want = np.fft.ifft(out).real * 60 / n
    assert np.allclose(got, want, atol=1e-9)


def test_zscore_is_standard_on_train(spark):
    d = spark.range(200).select((F.col("id") % 4).alias("channel"), F.pow(F.col("id"), 1.3).alias("v"))
    z = features.apply_stats(d, features.fit_stats(d)).groupBy("channel").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in z.collect())


def test_q88_edges(spark):
    d = spark.createDataFrame([(float(v),) for v in (-128, -128.5, 127.99609375, 200, 0.5 / 256, -0.5 / 256, 1.5 / 256)], "v double")
    words = [r[0] for r in d.select(features.pack_q88(F.col("v"))).collect()]
    assert words == [0x8000, 0x8000, 0x7FFF, 0x7FFF, 0, 0, 2]


def test_splits_are_disjoint_and_cover(spark):
    d = spark.range(500).select("id", (F.col("id") % 7).alias("label"))
    s = sampling.stratified_split(d, "id", "label")
    assert s.count() == 500 and s.select("id").distinct().count() == 500
    assert {r["split"] for r in s.select("split").distinct().collect()} == {"train", "val", "test"}


def test_weighted_resample_follows_weights(spark):
    d = spark.range(200).select("id", F.when(F.col("id") < 100, 3.0).otherwise(1.0).alias("w"))
    draws = sampling.weighted_resample(d, "id", "w", 20)
    assert draws.count() == 4000
    heavy = draws.filter("id < 100").count() / 4000
    assert abs(heavy - 0.75) < 0.04


def test_required_columns(spark):
    with pytest.raises(ValueError, match="acc_z"):
        require_columns(spark.range(1).selectExpr("id as measurement_id"), ("measurement_id", "acc_z"))


def test_natural_order(spark):
    d = spark.createDataFrame([("clip_10.wav",), ("clip_2.wav",), ("Clip_1.wav",)], "p string")
    assert [r[0] for r in d.orderBy(clean.natural_key(F.col("p"))).collect()] == ["Clip_1.wav", "clip_2.wav", "clip_10.wav"]


def test_append_continues_ids(spark):
    base = spark.createDataFrame([(4, 0), (9, 0)], "measurement_id long, sequence_id int")
    new = spark.createDataFrame([(0, 0), (0, 1), (5, 0)], "measurement_id long, sequence_id int")
    assert sorted(r[0] for r in clean.append_measurements(base, new).collect()) == [4, 9, 10, 10, 11]


def test_balanced_merge_reports_shortage(spark):
    d = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "id long, label string")
    kept, short = clean.balanced_merge(d, d.filter("id < 3"), 2, 1)
    assert kept.groupBy("label", "origin").count().count() == 3
    assert [(r["label"], r["origin"], r["found"]) for r in short.collect()] == [("b", "new", 1)]


assert AXES
