from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wavefold import plans
from wavefold.functions import scalar
from wavefold.operators import mfcc, signal


def clip(spark, values, key=1):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "clip_id long, n int, v double")


def test_short_clip_is_one_padded_frame(spark):
    r = signal.frame_rms(clip(spark, [3.0, 4.0]), "clip_id", 4, 2).collect()
    assert [(x["frame"], round(x["rms"], 6)) for x in r] == [(0, 2.5)]


def test_frames_match_strides(spark):
    got = signal.frames(clip(spark, range(23)), "clip_id", 8, 3).groupBy("frame").agg(F.sort_array(F.collect_list("n")).alias("x")).collect()
    assert {r["frame"]: r["x"] for r in got} == {f: list(range(3 * f, 3 * f + 8)) for f in range(6)}


def test_silence_stays(spark):
    assert signal.trim_silence(clip(spark, [0.0] * 30), "clip_id", 5, 2, 1).count() == 30
    burst = [0.0] * 20 + [0.9] * 10 + [0.0] * 20
    n = signal.trim_silence(clip(spark, burst), "clip_id", 5, 5, 2).count()
    assert n == 14


def test_loudness_keeps_peak(spark):
    v = [0.001] * 99 + [0.5]
    peak = signal.normalize_loudness(clip(spark, v), "clip_id").agg(F.max("v")).collect()[0][0]
    assert abs(peak - 10 ** (-1 / 20)) < 1e-9
    assert signal.normalize_loudness(clip(spark, [0.0, 0.0]), "clip_id").agg(F.max("v")).collect()[0][0] == 0


def test_bisection_reaches_target(spark):
    v = np.abs(np.sin(np.arange(400) / 30)) + 0.01
    d = clip(spark, v)
    s = spark.createDataFrame([(1, 0, 400)], "clip_id long, start int, end int")
    out = signal.fit_segment_count(s, d, "clip_id", 100, 4).orderBy("start").collect()
    assert len(out) == 4 and out[0]["start"] == 0 and out[-1]["end"] == 400
    assert all(a["end"] == b["start"] for a, b in zip(out, out[1:], strict=False))


def test_dct_is_orthonormal(spark):
    m = np.zeros((8, 8))
    for r in scalar.dct_matrix(spark, 8).collect():
        m[r["k"], r["mel"]] = r["w"]
    assert np.allclose(m @ m.T, np.eye(8))


def test_mfcc_engines_agree(spark):
    cfg = mfcc.MfccConfig(sample_rate=200, win=20, hop=8, n_fft=32, n_mels=8, n_mfcc=8, frames=8)
    rng = np.random.default_rng(1)
    clips = {1: rng.normal(size=77), 2: rng.normal(size=30), 3: rng.normal(size=140), 4: rng.normal(size=1)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()], "clip_id long, samples array<double>")
    long = rows.select("clip_id", F.posexplode("samples").alias("n", "v"))
    a = {r["clip_id"]: np.array(r["mfcc"]).reshape(8, 8) for r in mfcc.mfcc(rows, cfg).collect()}
    b = {k: np.zeros((8, 8)) for k in clips}
    for r in mfcc.mfcc_long(long, cfg).collect():
        b[r["clip_id"]][r["coef"], r["frame"]] = r["v"]
    for k in clips:
        assert np.allclose(a[k], b[k], atol=1e-6), k


def test_ema_of_long_clips(spark):
    rng = np.random.default_rng(4)
    for alpha, n in ((0.05, 50_000), (0.9, 3000), (1.0, 50), (1e-5, 5000)):
        v = rng.normal(size=n) + 3
        want, e = np.zeros(n), v[0]
        for i in range(n):
            e = (1 - alpha) * e + alpha * v[i] if i else e
            want[i] = e
        got = np.array([r["ema"] for r in signal.ema_baseline(clip(spark, v), "clip_id", alpha).orderBy("n").collect()])
        assert len(got) == n and np.allclose(got, want, rtol=1e-9, atol=1e-12), alpha


def plain_splits(v, rate, scale):
    """The search over silence settings, one by one."""
    found = []
    for ms in signal.SILENCES_MS:
        m, step = max(1, round(ms * rate / 1000)), max(1, round(5 * rate / 1000))
        for delta in signal.DELTAS_DB:
            t = np.sqrt(np.mean(v * v)) * 10 ** (delta * scale / 20)
            starts = [i for i in range(len(v) - m + 1) if (i % step == 0 or i == len(v) - m) and np.sqrt(np.mean(v[i : i + m] ** 2)) <= t]
            quiet = []
            for i in starts:
                if quiet and i <= quiet[-1][1]:
                    quiet[-1][1] = i + m
                else:
                    quiet.append([i, i + m])
            cuts = [0, *[x for q in quiet for x in q], len(v)]
            spans = [(a * 1000 / rate, b * 1000 / rate) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            merged = []
            for a, b in [x for x in spans if x[1] - x[0] >= 220]:
                if merged and a - merged[-1][1] <= 55:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            if merged:
                d, n = [b - a for a, b in merged], len(merged)
                score = (0 if 9 <= n <= 11 else 10_000 + abs(n - 10) * 2_000) + 6 * sum(max(0, 240 - x) for x in d) + 2 * sum(max(0, x - 2200) for x in d) + max(d) - min(d)
                found.append(((score, abs(n - 10), max(d) - min(d), ms, -delta), (ms, delta * scale, n, score)))
    return min(found)[1]


def test_split_search_over_all_settings(spark):
    rng, rate = np.random.default_rng(6), 1000
    clips = {}
    for k in range(3):
        level = np.concatenate([x for _ in range(10 - k) for x in (np.full(rng.integers(250, 500), 1.0), np.full(rng.integers(70, 300), 10 ** (-rng.uniform(8, 25) / 20)))])
        clips[k] = rng.normal(size=len(level)) * level
    d = spark.createDataFrame([(k, i, float(x)) for k, v in clips.items() for i, x in enumerate(v)], "clip_id long, n int, v double")
    got = {r["clip_id"]: r for r in signal.best_splits(d, "clip_id", rate).collect()}
    for k, v in clips.items():
        ms, delta, n, score = plain_splits(v, rate, 1.0)
        r = got[k]
        assert (r["min_silence_ms"], r["delta_db"], r["n"]) == (ms, delta, n) and abs(r["score"] - score) < 1e-6


def test_segment_grid_is_whole(spark):
    assert signal.segment_grid(spark).distinct().count() == 455
    burst = np.where((np.arange(6000) // 600) % 2 == 0, 1.0, 10 ** (-30.5 / 20))
    best = signal.plan_segments(clip(spark, burst), "clip_id", None, 50, 25, 1000, 5).collect()[0]
    assert best["n"] == 5 and best["threshold_db"] == -30.0


def test_decibels_of_any_number(spark, duck, same, tmp_path):
    """Zero, numbers close to it and below it as the SQL has them."""
    values = [0.0, -0.0, 1e-8, 9.9e-9, 1e-9, 5e-324, -1e-9, -5.0, float("-inf"), float("inf"), 1.0, 1e-7, 327.53, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = plans.QUERIES["h05_decibels"](spark, str(tmp_path))
    same(got, duck.sql(f"with events as (from '{tmp_path}/events.parquet/*.parquet') {plans.ORACLES['h05_decibels']}"))
    assert {r["db"] for r in got.filter("event_id in (4, 5)").collect()} == {-180.0, -6466.124307}
    floor = spark.createDataFrame([(1e-9,), (-5.0,)], "x double").select(signal.amplitude_to_db(F.col("x")).alias("db"))
    assert [r["db"] for r in floor.collect()] == [float("-inf")] * 2  # of levels, as before
