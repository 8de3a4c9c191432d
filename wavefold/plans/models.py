"""Queries of cepstral features, scoring, training and motion segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefold.operators import evaluate, features, mfcc, motion, sampling, score
from wavefold.plans.registry import query, rounded
from wavefold.schemas import AXES
from wavefold.sources import driver_tables as T

CFG = mfcc.MfccConfig(sample_rate=200, win=20, hop=8, n_fft=32, n_mels=8, n_mfcc=8, frames=8)


@query("m05_mfcc")
def m05(spark, d):
    c = T.clips(spark, d).groupBy("clip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("samples"))
    return mfcc.mfcc(c, CFG)


@query("m05_voice_features")
def m05_voice(spark, d):
    """The whole job on clips: trim, loudness, focus, features."""
    return mfcc.voice_features(T.clips(spark, d), CFG, trim_db=-3.0, frame_s=0.08, hop_s=0.04, pad_s=0.015, half_s=0.1)


@query("m05_mfcc_long")
def m05_long(spark, d):
    return mfcc.mfcc_long(T.clips(spark, d), CFG)


def _net(spark):
    """A fixed small network: weights from a cosine rule over their index."""
    shapes = {"conv1.weight": [4, 8, 3], "conv1.bias": [4], "conv2.weight": [6, 4, 3], "conv2.bias": [6], "fc.weight": [10, 6], "fc.bias": [10]}
    out = None
    for n, (name, shape) in enumerate(shapes.items()):
        size = 1
        for s in shape:
            size *= s
        row = spark.range(1).select(F.lit(name).alias("layer"), F.array(*[F.lit(s) for s in shape]).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.cos(i * 1.7 + n) / 2).alias("values"))
        out = row if out is None else out.unionByName(row)
    return out


def _windows(spark, d):
    f = features.flatten_time_major(T.features(spark, d), "clip_id").withColumnRenamed("clip_id", "id")
    return f.join(T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("true_id")), "id")


def _net_sql(x: str) -> str:
    """The network over rows x (id, q, c, t, v), q apart: z (id, q, cls, z)."""
    return f"""x AS ({x}),
    a1 AS (SELECT id, q, o, y.t, greatest(sum(v * cos(((o * 8 + c) * 3 + x.t - y.t + 1) * 1.7) / 2) + any_value(cos(o * 1.7 + 1) / 2), 0) AS v
           FROM x, range(4) w(o), range(8) y(t) WHERE x.t - y.t BETWEEN -1 AND 1 GROUP BY id, q, o, y.t),
    p AS (SELECT id, q, o AS c, t // 2 AS t, max(v) AS v FROM a1 GROUP BY ALL),
    a2 AS (SELECT id, q, o, y.t, greatest(sum(v * cos(((o * 4 + c) * 3 + p.t - y.t + 1) * 1.7 + 2) / 2) + any_value(cos(o * 1.7 + 3) / 2), 0) AS v
           FROM p, range(6) w(o), range(4) y(t) WHERE p.t - y.t BETWEEN -1 AND 1 GROUP BY id, q, o, y.t),
    m AS (SELECT id, q, o, avg(v) AS v FROM a2 GROUP BY id, q, o),
    z AS (SELECT id, q, cls, sum(v * cos((cls * 6 + o) * 1.7 + 4) / 2) + any_value(cos(cls * 1.7 + 5) / 2) AS z FROM m, range(10) k(cls) GROUP BY id, q, cls)"""


@query(
    "m16_score",
    "WITH " + T.FEATURES_SQL + ", " + _net_sql("SELECT clip_id AS id, 0 AS q, channel AS c, frame AS t, v FROM features")
    + " SELECT id, CAST(arg_max(cls, z) AS INTEGER) AS pred_id, round(1 / sum(exp(z - most)), 6) AS confidence FROM (SELECT *, max(z) OVER (PARTITION BY id) AS most FROM z) GROUP BY id",
)
def m16(spark, d):
    return rounded(score.score(_windows(spark, d), _net(spark), 8), "confidence", digits=6)


@query(
    "m17_quantisation_report",
    "WITH " + T.FEATURES_SQL
    + ", "
    + _net_sql("SELECT clip_id AS id, q, channel AS c, frame AS t, CASE WHEN q = 0 THEN v ELSE round_even(greatest(-128.0, least(127.99609375, v)) * 256, 0) / 256 END AS v FROM features, range(2) g(q)")
    + """, r AS (SELECT id, arg_max(cls, z) FILTER (q = 0) AS a, arg_max(cls, z) FILTER (q = 1) AS b FROM z GROUP BY id)
    SELECT label AS true_id, count(*) AS n, CAST(sum(CAST(a = b AS INTEGER)) AS BIGINT) AS agree, round(100 * avg(CAST(a = label AS INTEGER)), 4) + 0.0 AS accuracy_a, round(100 * avg(CAST(b = label AS INTEGER)), 4) + 0.0 AS accuracy_b
    FROM r JOIN embeddings ON vec_id = id GROUP BY label""",
)
def m17(spark, d):
    return rounded(evaluate.agreement(score.quantisation_report(_windows(spark, d), _net(spark), 8)), "accuracy_a", "accuracy_b")


def _labelled(spark, d):
    e = sampling.stratified_split(T.table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "label", 0.2, 0.1)
    return e.select("vec_id", "label", "split", F.col("embedding").alias("flat"))


@query("m14_classifier")
def m14(spark, d):
    e = _labelled(spark, d)
    p = score.predict(score.fit_classifier(e.filter("split = 'train'"), 20), e)
    return p.select("vec_id", "split", F.col("label").alias("true_id"), "pred_id")


@query("m15_sweep")
def m15(spark, d):
    return score.sweep(_labelled(spark, d), {"reg": [0.01, 0.1], "max_iter": [10]}, 10)


@query(
    "w18_motion_segments",
    "WITH RECURSIVE " + T.SAMPLES_SQL + """, a(d, n, x, y, z) AS (
      SELECT measurement_id, sequence_id, acc_x, acc_y, acc_z FROM samples WHERE sequence_id = 0
      UNION ALL SELECT d, n + 1, 0.95 * x + 0.05 * acc_x, 0.95 * y + 0.05 * acc_y, 0.95 * z + 0.05 * acc_z FROM a JOIN samples ON measurement_id = d AND sequence_id = n + 1
    ), e AS (
      SELECT d, n, sqrt(gyro_x ** 2 + gyro_y ** 2 + gyro_z ** 2) + 0.5 * sqrt((acc_x - x) ** 2 + (acc_y - y) ** 2 + (acc_z - z) ** 2) AS e FROM a JOIN samples ON measurement_id = d AND sequence_id = n
    ), l AS (SELECT d, avg(e) + (stddev_pop(e) + 1e-6) AS high, avg(e) + 0.5 * (stddev_pop(e) + 1e-6) AS low FROM e WHERE n < 10 GROUP BY d HAVING count(*) = 10
    ), m(d, n, above, below, first, len, done) AS (
      SELECT d, 9, 0, 0, -1, 0, 0 FROM l
      UNION ALL
      SELECT d, n, CASE WHEN first < 0 AND NOT opens THEN up ELSE 0 END, CASE WHEN first >= 0 AND NOT ends THEN down ELSE 0 END,
             CASE WHEN first < 0 THEN CASE WHEN opens THEN n ELSE -1 END WHEN ends THEN -2 - first ELSE first END,
             CASE WHEN first < 0 THEN 1 ELSE len + 1 END, CASE WHEN first >= 0 AND ends AND len + 1 >= 2 THEN 1 ELSE 0 END
      FROM (SELECT m.d, e.n, greatest(m.first, -1) AS first, m.len, CASE WHEN e > high THEN above + 1 ELSE 0 END AS up, CASE WHEN e < low THEN below + 1 ELSE 0 END AS down,
                   CASE WHEN e > high THEN above + 1 ELSE 0 END >= 2 AS opens, m.len + 1 >= 20 OR CASE WHEN e < low THEN below + 1 ELSE 0 END >= 3 AS ends
            FROM m JOIN e ON e.d = m.d AND e.n = m.n + 1 JOIN l ON l.d = m.d)
    )
    SELECT CAST(d AS VARCHAR) AS device, CAST(-2 - first AS BIGINT) AS first, CAST(len AS BIGINT) AS samples FROM m WHERE done = 1""",
)
def w18(spark, d):
    return motion.segment_motion(motion_samples(spark, d), motion.MotionConfig(rate=10, start_z=1.0, end_z=0.5, start_count=2, end_count=3))


def motion_samples(spark, d):
    """Samples of devices: device, seq, gx .. az."""
    s = T.samples(spark, d)
    names = dict(zip(AXES, ("gx", "gy", "gz", "ax", "ay", "az"), strict=True))
    return s.select(F.col("measurement_id").cast("string").alias("device"), F.col("sequence_id").alias("seq"), *[F.col(a).alias(b) for a, b in names.items()])
