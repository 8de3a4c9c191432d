"""Queries of features, sampling and evaluation (M, A07-A22, H, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefold.functions import scalar
from wavefold.operators import clean, evaluate, features, review, sampling, tables
from wavefold.plans.cleaning import _AX, _S, _TRIM
from wavefold.plans.registry import query, rounded
from wavefold.sources import driver_tables as T

_F = "WITH " + T.FEATURES_SQL
_P = "WITH " + T.PREDICTIONS_SQL
_KERNEL = """CASE WHEN c = {m} THEN CASE WHEN n = m THEN 1.0 ELSE 0.0 END ELSE (
  CASE WHEN abs(sin(pi() * (m / {m}.0 - n / c))) < 1e-12 THEN 2.0 * (CASE WHEN least(c, {m}) % 2 = 0 THEN least(c, {m}) // 2 - 1 ELSE least(c, {m}) // 2 END) + 1
       ELSE sin(pi() * (2 * (CASE WHEN least(c, {m}) % 2 = 0 THEN least(c, {m}) // 2 - 1 ELSE least(c, {m}) // 2 END) + 1) * (m / {m}.0 - n / c)) / sin(pi() * (m / {m}.0 - n / c)) END
  + CASE WHEN least(c, {m}) % 2 = 0 AND c > {m} THEN cos(2 * pi() * (least(c, {m}) // 2) * (m / {m}.0 - n / c))
         WHEN least(c, {m}) % 2 = 0 AND c < {m} THEN 2 * cos(pi() * n) * cos(pi() * c * m / {m}.0) ELSE 0 END) / c END""".replace("{m}", "60")
_FLAG = (
    _S + ", " + _TRIM
    + ", band AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY measurement_id) AS c FROM trimmed WINDOW w AS (PARTITION BY measurement_id ORDER BY sequence_id) QUALIFY count(*) OVER (PARTITION BY measurement_id) BETWEEN 40 AND 300)"
    + ", based AS (SELECT measurement_id, n, c, " + ", ".join(f"{a} - avg({a}) FILTER (n < 5) OVER (PARTITION BY measurement_id) AS {a}" for a in _AX) + " FROM band)"
    + ", sampled AS (SELECT measurement_id, m, " + ", ".join(f"sum({a} * k) AS {a}" for a in _AX) + f" FROM (SELECT *, {_KERNEL} AS k FROM based, range(60) g(m)) GROUP BY measurement_id, m)"
)


def cleaned(spark, d):
    t = clean.length_band(clean.trim_idle(clean.length_band(T.samples(spark, d), "measurement_id", 15, 300)), "measurement_id", 40, 300)
    return clean.remove_baseline(t)


def resampled(spark, d):
    return features.resample_spectral(cleaned(spark, d))


def _stats_sql(table: str, key: str, cols) -> str:
    n = len(cols)
    total, square = " + ".join(f"sum({c})" for c in cols), " + ".join(f"sum({c} * {c})" for c in cols)
    low, high = ", ".join(f"min({c})" for c in cols), ", ".join(f"max({c})" for c in cols)
    return f"""SELECT {key}, count(*) AS samples, {n} AS channels, round(least({low}), 4) + 0.0 AS low, round(greatest({high}), 4) + 0.0 AS high, round(({total}) / (count(*) * {n}), 4) + 0.0 AS mean,
      round(sqrt(greatest(({square}) / (count(*) * {n}) - (({total}) / (count(*) * {n})) ** 2, 0)), 4) + 0.0 AS std FROM {table} GROUP BY {key}"""


@query("flagship_windows", _FLAG + " " + _stats_sql("sampled", "measurement_id", _AX))
def flagship(spark, d):
    return rounded(features.window_stats(resampled(spark, d), "measurement_id", _AX), "low", "high", "mean", "std")


@query("m01_resample_spectral", _FLAG + " SELECT measurement_id, CAST(m AS INTEGER) AS m, " + ", ".join(f"round({a}, 4) + 0.0 AS {a}" for a in _AX) + " FROM sampled")
def m01(spark, d):
    return rounded(resampled(spark, d), *_AX)


@query("a08_window_stats", _S + " " + _stats_sql("samples", "measurement_id", _AX))
def a08(spark, d):
    return rounded(features.window_stats(T.samples(spark, d), "measurement_id", _AX), "low", "high", "mean", "std")


@query(
    "m02_resample_linear",
    "WITH " + T.CLIPS_SQL + """, c AS (SELECT clip_id, n, v, coalesce(lead(v) OVER (PARTITION BY clip_id ORDER BY n), v) AS w, count(*) OVER (PARTITION BY clip_id) AS c FROM clips),
    g AS (SELECT DISTINCT clip_id, c, m, least(CAST(floor(m * (c - 1) / 59 + 1e-9) AS BIGINT), c - 1) AS n FROM c, range(60) t(m))
    SELECT clip_id, CAST(m AS INTEGER) AS m, round(v + (m * (c.c - 1) / 59 - c.n) * (w - v), 4) + 0.0 AS v FROM g JOIN c USING (clip_id, n)""",
)
def m02(spark, d):
    out = features.resample_linear(T.clips(spark, d), "clip_id", "n", ("v",), 60)
    return rounded(out.select("clip_id", F.col("m").cast("int").alias("m"), "v"), "v")


@query("a07_channel_stats", _F + " SELECT channel, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v) + 1e-6, 6) + 0.0 AS std FROM features WHERE clip_id % 5 <> 0 GROUP BY channel")
def a07(spark, d):
    return rounded(features.fit_stats(T.features(spark, d).filter("clip_id % 5 <> 0"), eps=1e-6), "mean", "std", digits=6)


@query("m03_zscore", _F + ", s AS (SELECT channel, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS std FROM features WHERE clip_id % 5 <> 0 GROUP BY channel) SELECT clip_id, channel, frame, round((v - mean) / std, 4) + 0.0 AS v FROM features JOIN s USING (channel)")
def m03(spark, d):
    f = T.features(spark, d)
    return rounded(features.apply_stats(f, features.fit_stats(f.filter("clip_id % 5 <> 0"))).select("clip_id", "channel", "frame", "v"), "v")


@query(
    "m04_quantise",
    _F + ", q AS (SELECT clip_id, channel, frame, v * 700 AS x FROM features), p AS (SELECT *, CAST(round_even(greatest(-128.0, least(127.99609375, x)) * 256, 0) AS INTEGER) & 65535 AS word FROM q) SELECT clip_id, channel, frame, word, (CASE WHEN word >= 32768 THEN word - 65536 ELSE word END) / 256 AS value, CAST(trunc(greatest(-128.0, least(127.99609375, x)) * 256) AS INTEGER) / 256 AS truncated FROM p",
)
def m04(spark, d):
    q = T.features(spark, d).withColumn("x", F.col("v") * 700)
    q = q.withColumn("word", features.pack_q88(F.col("x")))
    return q.select("clip_id", "channel", "frame", "word", features.unpack_q88(F.col("word")).alias("value"), features.truncate_q88(F.col("x")).alias("truncated"))


@query("h12_flatten", _F + " SELECT clip_id, array_to_string(list(CAST(round(v * 10000) AS BIGINT) ORDER BY frame, channel), ',') AS flat FROM features GROUP BY clip_id")
def h12(spark, d):
    f = features.flatten_time_major(T.features(spark, d), "clip_id")
    return f.select("clip_id", F.array_join(F.transform("flat", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("flat"))


@query("h13_fix_frames", _F + " SELECT f.clip_id, f.channel, CAST(g.m AS INTEGER) AS frame, round(coalesce(x.v, 0), 4) + 0.0 AS v FROM (SELECT DISTINCT clip_id, channel FROM features) f, range(5) g(m) LEFT JOIN features x ON x.clip_id = f.clip_id AND x.channel = f.channel AND x.frame = g.m + 1")
def h13(spark, d):
    return rounded(features.fix_frames(T.features(spark, d), "clip_id", target=5), "v")


@query("h14_cepstral_norm", _F + " SELECT clip_id, channel, frame, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-8), 4) + 0.0 AS v FROM features WINDOW w AS (PARTITION BY clip_id, channel)")
def h14(spark, d):
    return rounded(features.cepstral_norm(T.features(spark, d), "clip_id", var=True).select("clip_id", "channel", "frame", "v"), "v")


@query("w19_roll", _F + " SELECT clip_id, channel, CAST((frame + 3) % 8 AS INTEGER) AS frame, round(v, 4) + 0.0 AS v FROM features")
def w19(spark, d):
    from wavefold.operators import signal

    return rounded(signal.roll(T.features(spark, d), "frame", 3, 8).select("clip_id", "channel", "frame", "v"), "v")


@query(
    "m06_stratified_split",
    """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT vec_id, label, CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round((n - round(n * 0.2)) * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def m06(spark, d):
    return sampling.stratified_split(T.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("a04_split_summary", """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round((n - round(n * 0.2)) * 0.1) THEN 'val' ELSE 'train' END AS split, label, count(*) AS n FROM r GROUP BY ALL""")
def a04(spark, d):
    return tables.split_summary(m06(spark, d))


_HELD = "WITH " + T.MANIFEST_SQL + """, m AS (SELECT clip_id, label_id, source, source || '_' || (clip_id % 4) AS speaker FROM manifest), sp AS (SELECT speaker, max(CASE WHEN source = 'src1' THEN 1 ELSE 0 END) AS own FROM m GROUP BY speaker),
  rk AS (SELECT *, {test} AS is_test FROM sp), t AS (SELECT speaker, s AS seed FROM rk, range(42, 298) g(s) WHERE NOT is_test),
  u AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5('0:' || seed || ':' || speaker), speaker) AS r, count(*) OVER (PARTITION BY seed) AS n FROM t),
  v AS (SELECT speaker, seed, CASE WHEN r <= least(greatest(2, round(n * 0.2)), n - 1) THEN 'val' ELSE 'train' END AS split FROM u),
  c AS (SELECT seed, split, count(DISTINCT label_id) AS c FROM v JOIN m USING (speaker) GROUP BY ALL),
  best AS (SELECT min(seed) AS seed FROM (SELECT seed FROM c WHERE c = (SELECT count(DISTINCT label_id) FROM m) GROUP BY seed HAVING count(*) = 2)),
  ch AS (SELECT speaker, split FROM v WHERE seed = (SELECT seed FROM best) UNION ALL SELECT speaker, 'test' FROM rk WHERE is_test)
SELECT clip_id, speaker, split FROM m JOIN ch USING (speaker)"""


def _speakers(spark, d):
    return T.manifest(spark, d).select("clip_id", "label_id", "source", F.concat("source", F.lit("_"), (F.col("clip_id") % 4).cast("string")).alias("speaker"))


@query("m07_heldout_split", _HELD.replace("{test}", "own = 1 AND row_number() OVER (PARTITION BY own ORDER BY speaker) <= 2"))
def m07(spark, d):
    return sampling.heldout_split(_speakers(spark, d), "src1", test_speakers=2, speaker="speaker").select("clip_id", "speaker", "split")


@query("m08_speaker_split", _HELD.replace("{test}", "false"))
def m08(spark, d):
    return sampling.heldout_split(_speakers(spark, d), None, speaker="speaker").select("clip_id", "speaker", "split")


_U = lambda text: f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query(
    "m09_augment_windows",
    _S + f""", c AS (SELECT measurement_id AS id, copy, sequence_id, gyro_x, acc_x, count(*) OVER (PARTITION BY measurement_id, copy) AS n FROM samples, range(3) g(copy)),
    r AS (SELECT *, {_U("'42:' || id || ':' || copy || ':crop'")} AS crop, {_U("'42:' || id || ':' || copy || ':head'")} AS head, {_U("'42:' || id || ':' || copy || ':tail'")} AS tail, {_U("'42:' || id || ':' || copy || ':scale'")} AS scale,
      {_U("'42:' || id || ':' || copy || ':gyro_x'")} AS sg, {_U("'42:' || id || ':' || copy || ':acc_x'")} AS sa FROM c)
    SELECT id AS measurement_id, CAST(copy AS INTEGER) AS copy, sequence_id, round(CASE WHEN copy = 0 THEN gyro_x ELSE gyro_x * (0.8 + 0.4 * scale) + (sg - 0.5) * 0.04 END, 4) + 0.0 AS gyro_x,
      round(CASE WHEN copy = 0 THEN acc_x ELSE acc_x * (0.8 + 0.4 * scale) + (sa - 0.5) * 0.04 END, 4) + 0.0 AS acc_x FROM r
    WHERE copy = 0 OR crop >= 0.4 OR (sequence_id >= floor(head * 0.1 * n) AND sequence_id < n - floor(tail * 0.1 * n))""",
)
def m09(spark, d):
    return rounded(sampling.augment_windows(T.samples(spark, d), "measurement_id", "sequence_id", ("gyro_x", "acc_x"), jitter=0.0), "gyro_x", "acc_x")


def _N(text):
    """Standard normal number of a text in SQL, from two hashed uniforms."""
    return f"(sqrt(-2 * ln(greatest({_U(text + " || ':a'")}, 1e-12))) * cos(2 * pi() * {_U(text + " || ':b'")}))"


_COPY = "'42:' || id || ':' || copy || ':"


@query(
    "m09_augment_jitter",
    _S + f""", c AS (SELECT measurement_id AS id, copy, sequence_id, {", ".join(_AX)}, count(*) OVER (PARTITION BY measurement_id, copy) AS n FROM samples, range(3) g(copy))
    SELECT id AS measurement_id, CAST(copy AS INTEGER) AS copy, sequence_id, """
    + ", ".join(f"round(CASE WHEN copy = 0 THEN {x} ELSE {x} * (0.8 + 0.4 * {_U(_COPY + 'scale' + chr(39))}) + ({_U(_COPY + x + chr(39))} - 0.5) * 0.04 + 0.05 * {_N(_COPY + x + ':' + chr(39) + ' || sequence_id')} END, 4) + 0.0 AS {x}" for x in _AX)
    + f""" FROM c WHERE copy = 0 OR {_U(_COPY + "crop'")} >= 0.4 OR (sequence_id >= floor({_U(_COPY + "head'")} * 0.1 * n) AND sequence_id < n - floor({_U(_COPY + "tail'")} * 0.1 * n))""",
)
def m09_jitter(spark, d):
    return rounded(sampling.augment_windows(T.samples(spark, d), "measurement_id", "sequence_id", _AX), *_AX)


def _masked(name, at, width):
    size = f"floor({_U(_COPY + name + 'w' + chr(39))} * {width + 1})"
    start = f"floor({_U(_COPY + name + 's' + chr(39))} * (8 - {size} + 1))"
    return f"({at} >= {start} AND {at} < {start} + {size})"


@query(
    "m10_augment_features",
    _F + f""", c AS (SELECT clip_id AS id, copy, channel, frame, v, CAST((frame + CAST(floor({_U("'42:' || clip_id || ':' || copy || ':roll'")} * 9) AS INTEGER) - 4 + 8) % 8 AS INTEGER) AS f2 FROM features, range(2) g(copy))
    SELECT id AS clip_id, CAST(copy AS INTEGER) AS copy, channel, CASE WHEN copy = 0 THEN frame ELSE f2 END AS frame,
      round(CASE WHEN copy = 0 THEN v WHEN {_masked("t1", "f2", 8)} OR {_masked("t2", "f2", 8)} OR {_masked("f1", "channel", 5)} OR {_masked("f2", "channel", 5)} THEN 0
        ELSE v * (0.85 + 0.3 * {_U(_COPY + "gain'")}) * (1 + ({_U(_COPY + "tilt'")} - 0.5) * 0.1 * (channel / 7 - 0.5)) + 0.03 * {_N(_COPY + "' || channel || ':' || frame")} END, 4) + 0.0 AS v FROM c""",
)
def m10(spark, d):
    return rounded(sampling.augment_features(T.features(spark, d), "clip_id", 8, 8), "v")


@query(
    "m11_augment_clips",
    "WITH " + T.CLIPS_SQL + f""", c AS (SELECT clip_id AS id, copy, n, v, count(*) OVER (PARTITION BY clip_id, copy) AS t FROM clips, range(2) g(copy)),
    m AS (SELECT *, n + CASE WHEN copy = 0 THEN 0 ELSE CAST(floor({_U(_COPY + "shift'")} * 21) AS INTEGER) - 10 END AS place FROM c)
    SELECT id AS clip_id, CAST(copy AS INTEGER) AS copy, place AS n, round(CASE WHEN copy = 0 THEN v ELSE greatest(-1.0, least(1.0, v * (0.8 + 0.4 * {_U(_COPY + "gain'")}) + 0.005 * {_N(_COPY + "' || n")})) END, 4) + 0.0 AS v FROM m WHERE place >= 0 AND place < t""",
)
def m11(spark, d):
    return rounded(sampling.augment_clips(T.clips(spark, d), "clip_id"), "v")


@query(
    "m12_weighted_resample",
    f"""WITH w AS (SELECT vec_id, CAST(label + 1 AS DOUBLE) AS w, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 3) AS BIGINT) AS b FROM embeddings),
    k AS (SELECT vec_id, sum(w) OVER (ORDER BY b, vec_id) - w AS lo FROM w), d AS (SELECT vec_id || ':' || f AS draw FROM w, range(6) g(f)),
    x AS (SELECT draw, CAST('0x' || substr(md5('42:' || draw), 1, 13) AS BIGINT) / 4503599627370496.0 * (SELECT sum(w) FROM w) AS x FROM d)
    SELECT draw, vec_id FROM x ASOF JOIN k ON x.x >= k.lo""",
)
def m12(spark, d):
    w = T.table(spark, d, "embeddings").select("vec_id", (F.col("label") + 1).cast("double").alias("weight"))
    return sampling.weighted_resample(w, "vec_id", "weight")


@query(
    "m13_mixup",
    _F + f""", i AS (SELECT DISTINCT clip_id, md5('42:' || clip_id) AS k FROM features), o AS (SELECT clip_id, coalesce(lead(clip_id) OVER w, first_value(clip_id) OVER w) AS other
      FROM i WINDOW w AS (PARTITION BY substr(k, 1, 2) ORDER BY k, clip_id)),
    r AS (SELECT clip_id, s, t, {_N("'42:' || clip_id || ':' || s || ':' || t")} AS z, ln(greatest({_U("'42:' || clip_id || ':' || s || ':' || t || ':u'")}, 1e-12)) AS u, {_U("'42:' || clip_id || ':' || s || ':w'")} AS e
      FROM i, (VALUES ('x'), ('y')) q(s), range(1, 9) h(t)),
    c AS (SELECT *, (1 + z / sqrt(9 * (1.2 - 1 / 3.0))) ** 3 AS v FROM r),
    g AS (SELECT clip_id, s, (1.2 - 1 / 3.0) * arg_min(v, t) FILTER (v > 0 AND u < 0.5 * z * z + (1.2 - 1 / 3.0) * (1 - v + ln(greatest(v, 1e-300)))) * greatest(any_value(e), 1e-12) ** 5 AS g FROM c GROUP BY clip_id, s),
    l AS (SELECT o.clip_id, other, a.g / (a.g + b.g) AS lam FROM o JOIN g AS a ON a.clip_id = o.clip_id AND a.s = 'x' JOIN g AS b ON b.clip_id = o.clip_id AND b.s = 'y')
    SELECT f.clip_id, other, round(lam, 6) AS lam, f.channel, f.frame, round(lam * f.v + (1 - lam) * g.v, 4) + 0.0 AS v FROM features f JOIN l USING (clip_id) JOIN features g ON g.clip_id = other AND g.channel = f.channel AND g.frame = f.frame""",
)
def m13(spark, d):
    m = sampling.mixup(T.features(spark, d).select("clip_id", "channel", "frame", "v"), "clip_id")
    return rounded(m.withColumn("lam", F.round("lam", 6)), "v")


@query("s22_export_cases", "WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE label BETWEEN 0 AND 5 ORDER BY md5('42:' || vec_id), vec_id LIMIT 100) SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CAST(round_even(greatest(-128.0, least(127.99609375, CAST(x AS DOUBLE))) * 256, 0) AS INTEGER) & 65535), ' ') AS words FROM e")
def s22(spark, d):
    e = sampling.export_cases(T.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("flat")), "vec_id", "label", 6, 100)
    return e.select("vec_id", "label", F.array_join(F.transform("words", lambda x: x.cast("string")), " ").alias("words"))


@query("a11_class_weights", "WITH n AS (SELECT CAST(c AS INTEGER) AS cls, (SELECT count(*) FROM embeddings WHERE label = c) AS n FROM range(12) g(c)), w AS (SELECT *, (sum(n) OVER () / greatest(n, 1)) ** 0.5 AS w FROM n) SELECT cls, n, round(w / avg(w) OVER (), 6) + 0.0 AS weight FROM w")
def a11(spark, d):
    e = T.table(spark, d, "embeddings")
    return rounded(evaluate.class_weights(e, "label", evaluate.class_list(e, 12), 0.5), "weight", digits=6)


@query(
    "j07_sample_weights",
    "WITH " + T.MANIFEST_SQL + ", n AS (SELECT label_id, count(*) AS n FROM manifest GROUP BY 1), w AS (SELECT label_id, (SELECT sum(n) FROM n) / n AS w FROM n), c AS (SELECT label_id, w / (SELECT avg(w) FROM w) AS cw FROM w) SELECT clip_id, round(cw * CASE WHEN source = 'src3' THEN 2.5 ELSE 1 END * CASE WHEN label = 'q0' THEN 1.3 ELSE 1 END, 6) + 0.0 AS weight FROM manifest JOIN c USING (label_id)",
)
def j07(spark, d):
    m = T.manifest(spark, d)
    w = evaluate.class_weights(m, "label_id", m.select(F.col("label_id").alias("cls")).distinct())
    boosts = spark.range(1).select(F.lit("q0").alias("label"), F.lit(1.3).alias("boost"))
    return rounded(evaluate.sample_weights(m, w, boosts, F.col("source") == "src3").select("clip_id", "weight"), "weight", digits=6)


@query("a12_accuracy", _P + " SELECT kind, total, correct, 100.0 * correct / greatest(total, 1) AS accuracy FROM (SELECT 'gesture' AS kind, count(*) FILTER (true_id < 9) AS total, count(*) FILTER (true_id < 9 AND CASE WHEN pred_id < 9 THEN pred_id ELSE 0 END = true_id) AS correct FROM preds UNION ALL SELECT 'voice', count(*), count(*) FILTER (true_id < 9 AND CASE WHEN pred_id < 9 THEN pred_id ELSE 0 END = true_id) FROM preds)")
def a12(spark, d):
    p = T.predictions(spark, d)
    return evaluate.accuracy(p, 9).withColumn("kind", F.lit("gesture")).unionByName(evaluate.accuracy(p, 9, True).withColumn("kind", F.lit("voice")))


_CM = _P + ", c AS (SELECT true_id, CASE WHEN pred_id < 10 THEN pred_id ELSE 0 END AS pred_id FROM preds WHERE true_id < 10), cm AS (SELECT CAST(a AS INTEGER) AS true_id, CAST(b AS INTEGER) AS pred_id, (SELECT count(*) FROM c WHERE c.true_id = a AND c.pred_id = b) AS n FROM range(10) x(a), range(10) y(b))"


@query("a13_confusion", _CM + " SELECT * FROM cm")
def a13(spark, d):
    return evaluate.confusion(T.predictions(spark, d), 10)


@query("a14_per_class_accuracy", _CM + " SELECT true_id, CAST(sum(n) FILTER (true_id = pred_id) AS BIGINT) AS ok, CAST(sum(n) AS BIGINT) AS total, round(CASE WHEN sum(n) > 0 THEN 100.0 * sum(n) FILTER (true_id = pred_id) / sum(n) ELSE 0 END, 4) + 0.0 AS pct FROM cm GROUP BY true_id")
def a14(spark, d):
    return rounded(evaluate.per_class_accuracy(evaluate.confusion(T.predictions(spark, d), 10)), "pct")


_LAT = "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS most"


@query("a15_latency", _LAT + " FROM events GROUP BY event_type")
def a15(spark, d):
    return rounded(evaluate.latency_summary(T.table(spark, d, "events"), "event_type", "value"), "mean", "p50", "p90", "p99")


@query("a16_energy", _LAT + ", round(avg(value) * 4.2, 4) AS energy_mj FROM events GROUP BY event_type")
def a16(spark, d):
    return rounded(evaluate.energy(evaluate.latency_summary(T.table(spark, d, "events"), "event_type", "value"), 4.2), "mean", "p50", "p90", "p99", "energy_mj")


@query("a17_rail_power", "SELECT round(sum(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)) * 1e-6, 6) AS watts FROM events")
def a17(spark, d):
    e = T.table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("reading"))
    return rounded(evaluate.rail_power(e, "reading"), "watts", digits=6)


@query("a18_motion_score", _S + " SELECT measurement_id, round(avg(sqrt(gyro_x**2 + gyro_y**2 + gyro_z**2)) + 0.5 * avg(sqrt(acc_x**2 + acc_y**2 + acc_z**2)), 4) AS motion_score FROM samples GROUP BY 1")
def a18(spark, d):
    return rounded(evaluate.motion_score(T.samples(spark, d), "measurement_id"), "motion_score")


@query("a18_voice_score", "WITH " + T.CLIPS_SQL + " SELECT clip_id, round(sqrt(avg(v * v) + 1e-12), 6) AS voice_score FROM clips GROUP BY 1")
def a18v(spark, d):
    return rounded(evaluate.voice_score(T.clips(spark, d), "clip_id"), "voice_score", digits=6)


@query("a21_agreement", _P + " SELECT true_id, count(*) AS n, count(*) FILTER (pred_id = q88_pred_id) AS agree, round(100.0 * avg(CAST(pred_id = true_id AS INTEGER)), 4) AS accuracy_a, round(100.0 * avg(CAST(q88_pred_id = true_id AS INTEGER)), 4) AS accuracy_b FROM preds GROUP BY true_id")
def a21(spark, d):
    return rounded(evaluate.agreement(T.predictions(spark, d)), "accuracy_a", "accuracy_b")


@query("a22_smoke_set", _P + " SELECT true_id, min(clip_id) AS clip_id, arg_min(pred_id = true_id, clip_id) AS passed FROM preds GROUP BY true_id")
def a22(spark, d):
    return evaluate.first_of_each(T.predictions(spark, d), "true_id", "clip_id").select("true_id", "clip_id", (F.col("pred_id") == F.col("true_id")).alias("passed"))


_Z = "z AS (SELECT vec_id, CAST(c - 1 AS INTEGER) AS cls, CAST(embedding[c] AS DOUBLE) * 4 AS z FROM embeddings, range(1, 7) g(c)), e AS (SELECT *, exp(z - max(z) OVER w) AS e FROM z WINDOW w AS (PARTITION BY vec_id)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"


def _softmax(spark, d):
    e = T.table(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 6)).alias("cls", "x"))
    return scalar.softmax(e.select("vec_id", "label", "cls", (F.col("x").cast("double") * 4).alias("z")), "vec_id")


@query("h10_softmax", f"WITH {_Z} SELECT vec_id, arg_max(cls, p) AS pred_id, round(max(p), 6) AS confidence FROM p GROUP BY vec_id")
def h10(spark, d):
    return rounded(scalar.classify(_softmax(spark, d), "vec_id"), "confidence", digits=6)


@query("m19_focal_loss", f"WITH {_Z} SELECT round(sum((1 - q) ** 1.5 * -ln(q)) / count(*), 6) AS loss FROM (SELECT greatest(p, 1e-12) AS q FROM p JOIN embeddings USING (vec_id) WHERE cls = label)")
def m19(spark, d):
    return rounded(evaluate.focal_loss(_softmax(spark, d).filter("cls = label")), "loss", digits=6)


@query("h01_mel_scale", "SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (10 ** ((2595 * log10(1 + value / 700)) / 2595) - 1), 6) AS hz FROM events")
def h01(spark, d):
    e = T.table(spark, d, "events").withColumn("mel", scalar.hz_to_mel(F.col("value")))
    return rounded(e.select("event_id", "mel", scalar.mel_to_hz(F.col("mel")).alias("hz")), "mel", "hz", digits=6)


@query("h05_decibels", "SELECT event_id, round(10 ** (-value / 20 / 20), 6) AS amplitude, round(20 * log10(value), 6) + 0.0 AS db FROM events")
def h05(spark, d):
    from wavefold.operators import signal

    e = T.table(spark, d, "events")
    return rounded(e.select("event_id", signal.db_to_amplitude(-F.col("value") / 20).alias("amplitude"), signal.amplitude_to_db(F.col("value"), None).alias("db")), "amplitude", "db", digits=6)


_URL = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)"


@query("h06_device_topics", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'dev' || user_id END AS device FROM events")
def h06(spark, d):
    e = T.table(spark, d, "events")
    third = F.element_at(F.array(F.lit("sensor"), F.lit("viz"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    topic = F.concat(F.lit("esp32/dev"), F.col("user_id").cast("string"), F.lit("/"), third, F.lit("/imu"))
    return e.select("event_id", scalar.device_of_topic(topic).alias("device"))


@query("h07_suffixes", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.ogg' ELSE '.wav' END AS suffix FROM documents")
def h07(spark, d):
    k = F.col("doc_id") % 3
    return T.table(spark, d, "documents").select("doc_id", scalar.resolve_suffix(F.when(k == 0, "mp3"), F.when(k == 1, F.concat(F.lit("take."), "source", F.lit(".ogg"))).otherwise("")).alias("suffix"))


@query("h08_path_safe", f"SELECT page_id, trim(regexp_replace(u, '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS safe FROM {_URL}")
def h08(spark, d):
    return T.table(spark, d, "pages").select("page_id", scalar.path_safe(F.regexp_replace("url", "^[a-z]+://", "")).alias("safe"))


@query("h09_decode_payloads", "SELECT conv_id, turn, octet_length(encode(text)) AS n_hex, md5(text) AS hex_md5, octet_length(encode(text)) AS n_base64 FROM conversations WHERE text IS NOT NULL")
def h09(spark, d):
    c = T.table(spark, d, "conversations").filter("text is not null")
    raw = F.encode("text", "UTF-8")
    a, b = scalar.decode_payload(F.hex(raw), F.lit("hex")), scalar.decode_payload(F.base64(raw), F.lit("base64"))
    return c.select("conv_id", "turn", F.octet_length(a).cast("long").alias("n_hex"), F.md5(a).alias("hex_md5"), F.octet_length(b).cast("long").alias("n_base64"))


@query("j01_header_detail", "SELECT o_orderkey, o_orderstatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j01(spark, d):
    o, li = T.table(spark, d, "orders"), T.table(spark, d, "lineitem")
    j = tables.header_detail(o, li, "o_orderkey", "l_orderkey")
    return rounded(j.groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), "total", digits=2)


@query("j02_split_members", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS member FROM documents")
def j02(spark, d):
    doc, lab = T.table(spark, d, "documents").select("doc_id"), T.table(spark, d, "labels").select("doc_id")
    inside, outside = tables.members(doc, lab, "doc_id")
    return inside.withColumn("member", F.lit(True)).unionByName(outside.withColumn("member", F.lit(False)))


@query("j03_manifest_features", "WITH " + T.MANIFEST_SQL + " SELECT clip_id, path, n_chars FROM manifest JOIN documents ON doc_id = clip_id")
def j03(spark, d):
    return tables.with_features(T.manifest(spark, d), T.table(spark, d, "documents").select(F.col("doc_id").alias("clip_id"), "n_chars"), "clip_id").select("clip_id", "path", "n_chars")


@query("j04_keyed_predictions", _P + " SELECT clip_id, true_id, pred_id, q88_pred_id, label, true_id = pred_id AS is_correct FROM preds JOIN embeddings ON vec_id = clip_id")
def j04(spark, d):
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), "label")
    return tables.keyed_predictions(T.predictions(spark, d), e, "clip_id")


@query("j06_apply_stats", _F + ", s AS (SELECT channel, avg(v) AS mean, stddev_pop(v) + 1e-6 AS std FROM features GROUP BY channel) SELECT clip_id, round(sum((v - mean) / std), 4) + 0.0 AS total FROM features JOIN s USING (channel) GROUP BY clip_id")
def j06(spark, d):
    f = T.features(spark, d)
    return rounded(features.apply_stats(f, features.fit_stats(f, eps=1e-6)).groupBy("clip_id").agg(F.sum("v").alias("total")), "total")


@query(
    "j08_reviews",
    """WITH p AS (SELECT event_id AS sample_id, event_type AS predicted_label FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id - event_id % 4 AS sample_id, ts AS reviewed_at, value < 30 AS is_correct, CASE WHEN value < 80 THEN 'click' WHEN value < 90 THEN 'unknown' END AS correct_label FROM events),
    f AS (SELECT * FROM r WHERE is_correct OR correct_label = 'click' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY reviewed_at) = 1)
    SELECT sample_id, predicted_label, CASE WHEN is_correct IS NULL THEN 'pending' WHEN is_correct THEN 'correct' ELSE 'corrected' END AS status, CASE WHEN is_correct = false THEN correct_label ELSE predicted_label END AS final_label FROM p LEFT JOIN f USING (sample_id)""",
)
def j08(spark, d):
    e = T.table(spark, d, "events")
    p = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("predicted_label"))
    r = e.select((F.col("event_id") - F.col("event_id") % 4).alias("sample_id"), F.col("ts").alias("reviewed_at"), (F.col("value") < 30).alias("is_correct"), F.when(F.col("value") < 80, "click").when(F.col("value") < 90, "unknown").alias("correct_label"))
    return review.apply_reviews(p, r, e.select(F.col("event_type").alias("label")))[0]


@query("j09_deletions", _P + " SELECT clip_id, true_id, clip_id % 10 = 3 AS deleted FROM preds")
def j09(spark, d):
    p = T.predictions(spark, d).select("true_id", F.col("clip_id").cast("string").alias("path"))
    kept, log = review.delete_clips(p, p.filter("path % 10 = 3").select("path"))
    both = kept.withColumn("deleted", F.lit(False)).unionByName(log.withColumn("deleted", F.lit(True)))
    return both.select(F.col("path").cast("long").alias("clip_id"), "true_id", "deleted")


@query("j10_parameter_grid", "SELECT p_brand AS voice, rate, pitch FROM (SELECT DISTINCT p_brand FROM part), (VALUES (-10), (0), (10)) r(rate), (VALUES (0), (5)) p(pitch) WHERE NOT (p_brand = 'Brand#1' AND rate = 0)")
def j10(spark, d):
    v = T.table(spark, d, "part").select(F.col("p_brand").alias("voice")).distinct()
    grid = tables.parameter_grid(v, rate=[-10, 0, 10], pitch=[0, 5])
    return tables.pending(grid, grid.filter("voice = 'Brand#1' and rate = 0"))


@query("s21_latest_state", "SELECT event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY event_type")
def s21(spark, d):
    return review.latest_state(T.table(spark, d, "events").select("event_type", "event_id", "value", "ts"), "event_type", "ts").select("event_type", "event_id", "value")

