"""Queries of waveform operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefold.functions import scalar
from wavefold.operators import signal, tables
from wavefold.plans.registry import query, rounded
from wavefold.sources import driver_tables as T

_C = "WITH " + T.CLIPS_SQL + ", len AS (SELECT clip_id, count(*) AS total FROM clips GROUP BY 1)"
L, H = 10, 5
_FR = f", fr AS (SELECT clip_id, f AS frame, sqrt(sum(v * v) / {L}) AS rms FROM clips JOIN len USING (clip_id), range(0, 200) g(f) WHERE n >= f * {H} AND n < f * {H} + {L} AND f <= greatest((total - {L}) // {H}, 0) GROUP BY ALL)"
_TR = _FR + f", b AS (SELECT clip_id, greatest(min(frame) * {H} - 3, 0) AS a, max(frame) * {H} + {L} + 3 AS b FROM (SELECT *, max(rms) OVER (PARTITION BY clip_id) AS peak FROM fr) WHERE rms >= greatest(peak * 10 ** (-3.0 / 20), 10 ** (-45.0 / 20)) GROUP BY clip_id), tr AS (SELECT clip_id, n - coalesce(a, 0) AS n, v FROM clips LEFT JOIN b USING (clip_id) WHERE a IS NULL OR (n >= a AND n < b))"
_NORM = """nm AS (SELECT clip_id, n, CASE WHEN rms <= 1e-8 THEN v ELSE greatest(-1.0, least(1.0, v * least(10 ** (-12.0 / 20) / rms, 10 ** (-1.0 / 20) / peak))) END AS v
  FROM (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY clip_id)) AS rms, max(abs(v)) OVER (PARTITION BY clip_id) AS peak FROM {t}))"""


@query("w08_frames", _C + f" SELECT clip_id, f AS frame, n FROM clips JOIN len USING (clip_id), range(0, 200) g(f) WHERE n >= f * {H} AND n < f * {H} + {L} AND f <= greatest((total - {L}) // {H}, 0)")
def w08(spark, d):
    return signal.frames(T.clips(spark, d), "clip_id", L, H).select("clip_id", "frame", "n")


@query("w09_frame_rms", _C + _FR + " SELECT clip_id, frame, round(rms, 6) AS rms FROM fr")
def w09(spark, d):
    return rounded(signal.frame_rms(T.clips(spark, d), "clip_id", L, H), "rms", digits=6)


@query("w10_trim_silence", _C + _TR + " SELECT clip_id, n, round(v, 6) + 0.0 AS v FROM tr")
def w10(spark, d):
    return rounded(signal.trim_silence(T.clips(spark, d), "clip_id", L, H, 3, -3.0), "v", digits=6)


@query("a09_signal_stats", _C + " SELECT clip_id, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(sqrt(avg(v * v)), 6) AS rms, round(max(abs(v)), 6) AS peak FROM clips GROUP BY clip_id")
def a09(spark, d):
    return rounded(signal.signal_stats(T.clips(spark, d), "clip_id"), "low", "high", "mean", "std", "rms", "peak", digits=6)


@query("a10_levels_db", _C + " SELECT clip_id, round(20 * log10(sqrt(avg(v * v))), 6) AS rms_db, round(20 * log10(max(abs(v))), 6) AS peak_db FROM clips GROUP BY clip_id")
def a10(spark, d):
    s = signal.signal_stats(T.clips(spark, d), "clip_id")
    return rounded(s.select("clip_id", signal.amplitude_to_db(F.col("rms")).alias("rms_db"), signal.amplitude_to_db(F.col("peak")).alias("peak_db")), "rms_db", "peak_db", digits=6)


@query("h15_normalize_loudness", _C + ", " + _NORM.replace("{t}", "clips") + " SELECT clip_id, n, round(v, 6) + 0.0 AS v FROM nm")
def h15(spark, d):
    return rounded(signal.normalize_loudness(T.clips(spark, d), "clip_id", -12.0, -1.0), "v", digits=6)


@query(
    "m20_clean_report",
    _C + _TR + ", " + _NORM.replace("{t}", "tr") + """, a AS (SELECT clip_id, count(*) AS n1, sqrt(avg(v * v)) AS r1 FROM nm GROUP BY 1), z AS (SELECT clip_id, count(*) AS n0, sqrt(avg(v * v)) AS r0 FROM clips GROUP BY 1)
    SELECT clip_id, n0 * 1000.0 / 50 AS before_ms, n1 * 1000.0 / 50 AS after_ms, (n0 - n1) * 1000.0 / 50 AS trim_ms, round(20 * log10(r1) - 20 * log10(r0), 4) + 0.0 AS gain_db FROM z JOIN a USING (clip_id)""",
)
def m20(spark, d):
    c = T.clips(spark, d)
    after = signal.normalize_loudness(signal.trim_silence(c, "clip_id", L, H, 3, -3.0), "clip_id", -12.0, -1.0)
    r = signal.clean_report(c, after, "clip_id", 50)
    return rounded(r.withColumns({x: F.col(x).cast("double") for x in ("before_ms", "after_ms", "trim_ms")}), "gain_db")


@query("a19_cleanup_means", _C + _TR + " SELECT count(*) AS clips, round(avg(n0), 4) AS before, round(avg(n1), 4) AS after FROM (SELECT clip_id, count(*) AS n0 FROM clips GROUP BY 1) JOIN (SELECT clip_id, count(*) AS n1 FROM tr GROUP BY 1) USING (clip_id)")
def a19(spark, d):
    c = T.clips(spark, d)
    r = signal.clean_report(c, signal.trim_silence(c, "clip_id", L, H, 3, -3.0), "clip_id", 1000)
    return rounded(r.agg(F.count(F.lit(1)).alias("clips"), F.avg("before_ms").alias("before"), F.avg("after_ms").alias("after")), "before", "after")


@query("w15_pre_emphasis", _C + " SELECT clip_id, n, round(v - 0.97 * coalesce(lag(v) OVER (PARTITION BY clip_id ORDER BY n), 0), 6) + 0.0 AS v FROM clips")
def w15(spark, d):
    return rounded(signal.pre_emphasis(T.clips(spark, d), "clip_id"), "v", digits=6)


@query(
    "w11_merge_spans",
    """WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + CAST(value * 60000 AS BIGINT) AS b FROM events),
    m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS island FROM m)
    SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, island""",
)
def w11(spark, d):
    e = T.table(spark, d, "events")
    a = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    s = e.select("user_id", a.alias("a"), (a + F.round(F.col("value") * 60000).cast("long")).alias("b"))
    return signal.merge_spans(s, "user_id", 600000)


_GRID = ", grid AS (SELECT t AS threshold_db, g AS gap_s, p AS pad_s FROM (VALUES (-1.0::DOUBLE), (-2.0), (-4.0)) a(t), (VALUES (0.04::DOUBLE), (0.12), (0.2)) b(g), (VALUES (0.0::DOUBLE), (0.1)) c(p))"
_SEG = f""", act AS (SELECT clip_id, threshold_db, gap_s, pad_s, frame, total FROM (SELECT *, max(rms) OVER (PARTITION BY clip_id) AS peak FROM fr) JOIN len USING (clip_id), grid WHERE peak > 1e-8 AND rms >= peak * 10 ** (threshold_db / 20)),
  nw AS (SELECT *, CASE WHEN lag(frame * {H} + {L}) OVER w IS NULL OR frame * {H} - lag(frame * {H} + {L}) OVER w > round(gap_s * 50) THEN 1 ELSE 0 END AS new FROM act WINDOW w AS (PARTITION BY clip_id, threshold_db, gap_s, pad_s ORDER BY frame)),
  isl AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, threshold_db, gap_s, pad_s ORDER BY frame) AS island FROM nw),
  seg AS (SELECT clip_id, threshold_db, gap_s, pad_s, greatest(min(frame) * {H} - round(pad_s * 50), 0) AS s, least(max(frame) * {H} + {L} + round(pad_s * 50), any_value(total)) AS e FROM isl GROUP BY clip_id, threshold_db, gap_s, pad_s, island),
  ok AS (SELECT *, (e - s) / 50.0::DOUBLE AS dur FROM seg WHERE e - s >= 18),
  pl AS (SELECT clip_id, threshold_db, gap_s, pad_s, count(*) AS n, count(*) FILTER (dur > 2.5) AS long, count(*) FILTER (dur < 0.6) AS short, max(dur) AS longest FROM ok GROUP BY ALL)"""


def _grid(spark):
    arr = lambda *x: F.explode(F.array(*[F.lit(v) for v in x]))
    return spark.range(1).select(arr(-1.0, -2.0, -4.0).alias("threshold_db")).withColumn("gap_s", arr(0.04, 0.12, 0.2)).withColumn("pad_s", arr(0.0, 0.1))


@query("w12_segment_plans", _C + _FR + _GRID + _SEG + " SELECT clip_id, threshold_db, gap_s, pad_s, n, longest FROM pl QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY long, short, CASE WHEN n >= 3 THEN 0 ELSE 1 END, abs(n - 3), longest, abs(threshold_db + 2), abs(gap_s - 0.12), pad_s, threshold_db, gap_s) = 1")
def w12(spark, d):
    return signal.plan_segments(T.clips(spark, d), "clip_id", _grid(spark), L, H, 50, 3, (-2.0, 0.12))


_ALL = ", grid AS (SELECT t AS threshold_db, g AS gap_s, p AS pad_s FROM (SELECT unnest([%s]) AS t), (SELECT unnest([%s]) AS g), (SELECT unnest([%s]) AS p))" % tuple(
    ", ".join(f"{x!r}::DOUBLE" for x in values) for values in ([x / 16 for x in signal.THRESHOLDS_DB], signal.GAPS_S, signal.PADS_S)
)


@query("w12_all_plans", _C + _FR + _ALL + _SEG + " SELECT clip_id, threshold_db, gap_s, pad_s, n, longest FROM pl QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY long, short, CASE WHEN n >= 3 THEN 0 ELSE 1 END, abs(n - 3), longest, abs(threshold_db + 2), abs(gap_s - 0.12), pad_s, threshold_db, gap_s) = 1")
def w12_all(spark, d):
    """All 455 plans, thresholds scaled to the clips' levels (-32 dB to -2 dB)."""
    return signal.plan_segments(T.clips(spark, d), "clip_id", signal.segment_grid(spark, 1 / 16), L, H, 50, 3, (-2.0, 0.12))


def _one_plan(spark, d):
    c = T.clips(spark, d)
    total = c.groupBy("clip_id").agg(F.count(F.lit(1)).alias("total"))
    rms = signal.frame_rms(c, "clip_id", L, H).join(total, "clip_id")
    return signal.detect_segments(rms, ["clip_id"], L, H, F.lit(-2.0), F.lit(6), F.lit(5), 18)


@query("w11_segments", _C + _FR + _GRID + _SEG + " SELECT clip_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM ok WHERE threshold_db = -2 AND gap_s = 0.12 AND pad_s = 0.1")
def w11_segments(spark, d):
    return _one_plan(spark, d).select("clip_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "w14_top_segments",
    _C + _FR + _GRID + _SEG + """, sc AS (SELECT o.clip_id, o.s, o.e, sum(abs(v)) / 50 AS score FROM ok o JOIN clips c ON c.clip_id = o.clip_id AND c.n >= o.s AND c.n < o.e WHERE threshold_db = -2 AND gap_s = 0.12 AND pad_s = 0.1 GROUP BY ALL),
    top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, s) <= 2)
    SELECT clip_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY s) AS INTEGER) AS segment FROM top""",
)
def w14(spark, d):
    s = signal.score_segments(_one_plan(spark, d), T.clips(spark, d), "clip_id", 50)
    t = signal.top_segments(s, "clip_id", 2).select("clip_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score", "segment")
    return rounded(t, "score")


@query("w14_bisected_segments")
def w14_bisect(spark, d):
    return signal.split_longest(_one_plan(spark, d), T.clips(spark, d), "clip_id", 20, 3)


@query(
    "a20_clip_report",
    _C + _FR + _GRID + _SEG + " SELECT clip_id, count(*) AS n, min(dur) * 1000 AS least_ms, max(dur) * 1000 AS most_ms, round(avg(dur) * 1000, 4) AS mean_ms FROM ok WHERE threshold_db = -2 AND gap_s = 0.12 AND pad_s = 0.1 GROUP BY clip_id",
)
def a20(spark, d):
    return rounded(tables.clip_report(_one_plan(spark, d), "clip_id", 50), "mean_ms")


@query(
    "w13_split_scores",
    """WITH s AS (SELECT l_orderkey AS clip, l_returnflag AS plan, l_quantity * 10 AS a, l_quantity * 10 + l_discount * 20000 AS b FROM lineitem),
    g AS (SELECT clip, plan, count(*) AS n, sum(greatest(240 - (b - a), 0)) AS short, sum(greatest(b - a - 2200, 0)) AS long, max(b - a) - min(b - a) AS spread FROM s GROUP BY ALL)
    SELECT clip, plan, n, round(CASE WHEN n BETWEEN 9 AND 11 THEN 0 ELSE 10000 + abs(n - 10) * 2000 END + short * 6 + long * 2 + spread, 3) AS score FROM g QUALIFY row_number() OVER (PARTITION BY clip ORDER BY CASE WHEN n BETWEEN 9 AND 11 THEN 0 ELSE 10000 + abs(n - 10) * 2000 END + short * 6 + long * 2 + spread, abs(n - 10), spread, plan) = 1""",
)
def w13(spark, d):
    from pyspark.sql import Window

    s = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_returnflag").alias("plan"), (F.col("l_quantity") * 10).alias("a"), (F.col("l_quantity") * 10 + F.col("l_discount") * 20000).alias("b"))
    p = signal.plan_splits(s, ["clip", "plan"])
    best = p.withColumn("_r", F.row_number().over(Window.partitionBy("clip").orderBy("score", F.abs(F.col("n") - 10), F.col("most") - F.col("least"), "plan"))).filter("_r = 1")
    return rounded(best.select("clip", "plan", "n", "score"), "score", digits=3)


@query("w13_split_plans")
def w13_plans(spark, d):
    """All 140 silence settings, levels scaled to the clips' (-6 dB to -0.75 dB)."""
    return rounded(signal.best_splits(T.clips(spark, d), "clip_id", 50, 1 / 8), "score", digits=3)


@query(
    "w16_focus",
    _C + _FR + f""", lv AS (SELECT clip_id, count(*) AS total, sqrt(avg(v * v)) AS level FROM clips GROUP BY 1),
    wt AS (SELECT fr.clip_id, frame * {H} + {L // 2} AS c, greatest(rms - greatest(level * 10 ** (-3.0 / 20), 10 ** (-45.0 / 20)), 0) AS w FROM fr JOIN lv USING (clip_id)),
    ce AS (SELECT clip_id, CASE WHEN sum(w) > 0 THEN round_even(sum(c * w) / greatest(sum(w), 1e-8), 0) ELSE (SELECT floor(total / 2) FROM lv WHERE lv.clip_id = wt.clip_id) END AS centre FROM wt GROUP BY clip_id)
    SELECT ce.clip_id, CAST(i AS BIGINT) AS n, round(coalesce(v, 0), 6) + 0.0 AS v FROM ce JOIN lv USING (clip_id), range(40) g(i) LEFT JOIN clips ON clips.clip_id = ce.clip_id AND clips.n = centre - 20 + i WHERE total > 40
    UNION ALL SELECT clip_id, n, round(v, 6) + 0.0 FROM clips JOIN lv USING (clip_id) WHERE total <= 40""",
)
def w16(spark, d):
    return rounded(signal.focus(T.clips(spark, d), "clip_id", 20, L, H, -3.0), "v", digits=6)


@query(
    "w17_ema",
    "WITH RECURSIVE " + T.CLIPS_SQL + ", e(clip_id, n, ema) AS (SELECT clip_id, n, v FROM clips WHERE n = 0 UNION ALL SELECT c.clip_id, c.n, 0.95 * e.ema + 0.05 * c.v FROM e JOIN clips c ON c.clip_id = e.clip_id AND c.n = e.n + 1) SELECT clip_id, n, round(ema + 1.2345678e-9, 6) + 0.0 AS ema FROM e",
)
def w17(spark, d):
    e = signal.ema_baseline(T.clips(spark, d), "clip_id")
    return rounded(e.select("clip_id", "n", (F.col("ema") + 1.2345678e-9).alias("ema")), "ema", digits=6)  # the offset keeps values off rounding ties


@query("w20_decimate", _C + " SELECT DISTINCT clip_id, n, round(v, 6) + 0.0 AS v FROM (SELECT clip_id, CAST(floor(i * ((total - 1) / 29) + 1e-9) AS INTEGER) AS n FROM len, range(30) g(i)) JOIN clips USING (clip_id, n)")
def w20(spark, d):
    return rounded(signal.decimate(T.clips(spark, d), "clip_id", 30), "v", digits=6)


@query("h16_effects", _C + ", e AS (SELECT clip_id, n, v FROM clips UNION ALL SELECT clip_id, n + 3, v * 0.5 FROM clips UNION ALL SELECT clip_id, n + 7, v * 0.25 FROM clips), s AS (SELECT clip_id, n, sum(v) AS v, count(*) OVER (PARTITION BY clip_id) AS t FROM e GROUP BY clip_id, n) SELECT clip_id, n, round(tanh(1.5 * v * least(1, n / 5, (t - 1 - n) / 5)), 6) + 0.0 AS v FROM s")
def h16(spark, d):
    e = signal.fade(signal.echo(T.clips(spark, d), "clip_id", [(3, 0.5), (7, 0.25)]), "clip_id", 5)
    return rounded(e.select("clip_id", "n", signal.distort(F.col("v"), 1.5).alias("v")), "v", digits=6)


@query("h04_windowed", _C + " SELECT clip_id, n, round(v * (0.5 - 0.5 * cos(2 * pi() * (n % 16) / 15)), 6) + 0.0 AS v FROM clips")
def h04(spark, d):
    c = T.clips(spark, d)
    return rounded(c.select("clip_id", "n", (F.col("v") * scalar.hann(F.col("n") % 16, 16)).alias("v")), "v", digits=6)


@query("h03_dct", "WITH " + T.FEATURES_SQL + " SELECT clip_id, frame, CAST(k AS BIGINT) AS k, round(sum(v * cos(pi() / 8 * (channel + 0.5) * k) * sqrt(2.0 / 8) * CASE WHEN k = 0 THEN 1 / sqrt(2.0) ELSE 1 END), 4) + 0.0 AS v FROM features, range(8) g(k) GROUP BY ALL")
def h03(spark, d):
    f = T.features(spark, d)
    m = scalar.dct_matrix(spark, 8)
    return rounded(f.join(F.broadcast(m), f["channel"] == m["mel"]).groupBy("clip_id", "frame", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v")), "v")


@query(
    "h02_mel_energies",
    "WITH " + T.FEATURES_SQL + """, p AS (SELECT i, 700 * (10 ** (i * (2595 * log10(1 + 8000 / 700.0) / 11) / 2595) - 1) AS hz FROM range(12) g(i)),
    b AS (SELECT i, hz, floor(127 * hz / 16000) AS bin FROM p),
    t AS (SELECT i AS mel, bin AS b0, lead(bin) OVER w AS x1, lead(bin, 2) OVER w AS x2, hz, lead(hz, 2) OVER w AS hz2 FROM b WINDOW w AS (ORDER BY i)),
    u AS (SELECT mel, b0, greatest(x1, b0 + 1) AS b1, greatest(x2, greatest(x1, b0 + 1) + 1) AS b2, hz2 - hz AS width FROM t WHERE hz2 IS NOT NULL),
    k AS (SELECT mel, bin, CASE WHEN bin < b1 THEN (bin - b0) / (b1 - b0) ELSE (b2 - bin) / (b2 - b1) END * 2 / width AS w FROM u, range(64) r(bin) WHERE bin >= b0 AND bin < b2)
    SELECT clip_id, mel, round(sum(f.v * f.v * k.w), 8) AS energy FROM features AS f JOIN k ON k.bin = f.channel * 8 + f.frame GROUP BY clip_id, mel""",
)
def h02(spark, d):
    f = T.features(spark, d).select("clip_id", (F.col("channel") * 8 + F.col("frame")).cast("long").alias("bin"), F.col("v"))
    m = scalar.mel_filterbank(spark, 10, 126, 16000)
    return f.join(F.broadcast(m), "bin").groupBy("clip_id", "mel").agg(F.round(F.sum(F.col("v") * F.col("v") * F.col("w")), 8).alias("energy"))


@query("m21_segment_job")
def m21(spark, d):
    grid = signal.segment_grid(spark, 1 / 16)
    return rounded(signal.segment_recordings(T.clips(spark, d), "clip_id", grid, L, H, 50, 3, prefer=(-2.0, 0.12), least=18, shortest=20), "score")
