"""Queries of the cleaning operators (P, W01-W07, A01-A06, U, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefold.operators import clean, evaluate, tables
from wavefold.plans.registry import query, rounded
from wavefold.sources import driver_tables as T

_S = "WITH " + T.SAMPLES_SQL
_MAG = "sqrt(gyro_x*gyro_x + gyro_y*gyro_y + gyro_z*gyro_z)"
_TRIM = f"""trimmed AS (SELECT * EXCLUDE (a, b) FROM (SELECT *, min(CASE WHEN {_MAG} >= 5.0 THEN sequence_id END) OVER (PARTITION BY measurement_id) AS a,
  max(CASE WHEN {_MAG} >= 5.0 THEN sequence_id END) OVER (PARTITION BY measurement_id) AS b FROM samples) WHERE a IS NULL OR sequence_id BETWEEN a AND b)"""
_R6 = ", ".join(f"round({c}, 4) AS {c}" for c in ("gyro_x", "gyro_y", "gyro_z", "acc_x", "acc_y", "acc_z"))
_AX = ("gyro_x", "gyro_y", "gyro_z", "acc_x", "acc_y", "acc_z")


@query("w01_sequence_ids", _S + f" SELECT measurement_id, sequence_id, label_id, label, {_R6} FROM samples")
def w01(spark, d):
    return rounded(clean.renumber(T.samples(spark, d)), *_AX)


@query("p01_label_tokens", "SELECT p_partkey, regexp_replace(translate(lower(trim(p_name)), ' -', '__'), '^\\d+_?', '') AS token, regexp_replace(translate(lower(trim(p_brand)), ' -', '__'), '^\\d+_?', '') AS brand FROM part")
def p01(spark, d):
    return T.table(spark, d, "part").select("p_partkey", clean.norm_label(F.col("p_name")).alias("token"), clean.norm_label(F.col("p_brand")).alias("brand"))


@query(
    "p02_alias_labels",
    """WITH aliases(map_name, alias, canonical) AS (VALUES ('size', 'small_ring', 'Ring'), ('size', 'red_widget', 'Widget'), ('size', 'blue_gear', 'Gear'), ('other', 'small_ring', 'Small'))
    SELECT p_partkey, canonical FROM (SELECT p_partkey, translate(lower(trim(p_name)), ' -', '__') AS t FROM part) JOIN aliases ON t = alias AND map_name = 'size'""",
)
def p02(spark, d):
    rows = F.array(*[F.struct(F.lit(m).alias("map_name"), F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for m, a, c in (("size", "small_ring", "Ring"), ("size", "red_widget", "Widget"), ("size", "blue_gear", "Gear"), ("other", "small_ring", "Small"))])
    aliases = spark.range(1).select(F.inline(rows))
    parts = T.table(spark, d, "part").select("p_partkey", clean.norm_label(F.col("p_name")).alias("token"))
    return clean.map_labels(parts, aliases, "size").select("p_partkey", "canonical")


@query("p03_length_band", _S + " SELECT measurement_id, sequence_id FROM samples QUALIFY count(*) OVER (PARTITION BY measurement_id) BETWEEN 55 AND 70")
def p03(spark, d):
    return clean.length_band(T.samples(spark, d), "measurement_id", 55, 70).select("measurement_id", "sequence_id")


@query("p04_trim_idle", _S + ", " + _TRIM + " SELECT measurement_id, sequence_id FROM trimmed")
def p04(spark, d):
    return clean.trim_idle(T.samples(spark, d)).select("measurement_id", "sequence_id")


@query("p05_trimmed_band", _S + ", " + _TRIM + " SELECT measurement_id, count(*) AS n FROM trimmed GROUP BY ALL HAVING count(*) BETWEEN 40 AND 300")
def p05(spark, d):
    t = clean.length_band(clean.trim_idle(T.samples(spark, d)), "measurement_id", 40, 300)
    return t.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"))


_REASONS = f"""reasons AS (SELECT measurement_id, n, CASE WHEN labels <> 1 THEN 'mixed_label' WHEN seqs <> n OR different <> n THEN 'bad_seq' WHEN n < 10 THEN 'too_short' WHEN n > 300 THEN 'too_long_raw'
  WHEN kept < 60 THEN 'trim_too_short' WHEN kept > 300 THEN 'trim_too_long' END AS reason FROM (
  SELECT measurement_id, count(*) AS n, count(DISTINCT label) AS labels, count(sequence_id) AS seqs, count(DISTINCT sequence_id) AS different,
  coalesce(max(sequence_id) FILTER ({_MAG} >= 5.0) - min(sequence_id) FILTER ({_MAG} >= 5.0) + 1, count(*)) AS kept FROM samples GROUP BY measurement_id))"""


@query("p06_drop_reasons", _S + ", " + _REASONS + " SELECT measurement_id, n, reason FROM reasons")
def p06(spark, d):
    return clean.drop_reasons(T.samples(spark, d), trimmed=(60, 300))


@query("p06_drop_report", _S + ", " + _REASONS + " SELECT r.reason, (SELECT count(*) FROM reasons q WHERE q.reason = r.reason) AS n_windows FROM (VALUES ('mixed_label'), ('bad_seq'), ('too_short'), ('too_long_raw'), ('trim_too_short'), ('trim_too_long')) r(reason)")
def p06_report(spark, d):
    return clean.drop_report(clean.drop_reasons(T.samples(spark, d), trimmed=(60, 300)))


@query("p07_strict_windows", "SELECT l_orderkey AS id, min(l_returnflag) AS label FROM lineitem GROUP BY 1 HAVING count(*) = 4 AND count(DISTINCT l_linenumber) = 4 AND min(l_returnflag) = max(l_returnflag) AND min(l_returnflag) IN ('A', 'N', 'R')")
def p07(spark, d):
    return clean.strict_windows(T.windows(spark, d), "id", "sequence_id", "label", 4, ("A", "N", "R"))


@query("p08_valid_labels", "SELECT vec_id, label FROM embeddings WHERE label BETWEEN 0 AND 5 ORDER BY vec_id LIMIT 40")
def p08(spark, d):
    return clean.valid_labels(T.table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 6, 40)


@query("p09_misclassified", "WITH " + T.PREDICTIONS_SQL + ", p AS (SELECT clip_id, CASE WHEN true_id = pred_id THEN ' True' ELSE 'false' END AS is_correct, CASE WHEN clip_id % 3 = 0 THEN '' ELSE '/data/' || clip_id || '.wav' END AS path FROM preds) SELECT clip_id, path FROM p WHERE lower(trim(is_correct)) NOT IN ('1', 'true', 'yes') AND trim(path) <> '' AND starts_with(path, '/data/')")
def p09(spark, d):
    from wavefold.operators import review

    p = T.predictions(spark, d).select("clip_id", F.when(F.col("true_id") == F.col("pred_id"), " True").otherwise("false").alias("is_correct"), F.when(F.col("clip_id") % 3 == 0, "").otherwise(F.concat(F.lit("/data/"), F.col("clip_id").cast("string"), F.lit(".wav"))).alias("path"))
    return review.misclassified(p, "/data").select("clip_id", "path")


@query("w02_measurement_numbers", "WITH b AS (SELECT DISTINCT source AS file, lang AS block FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY file, block) - 1 + 100 AS measurement_id FROM b) SELECT doc_id, measurement_id FROM documents JOIN n ON file = source AND block = lang")
def w02(spark, d):
    b = T.table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.col("lang").alias("block"))
    return clean.number_measurements(b, 100).select("doc_id", "measurement_id")


_BASE = ", ".join(f"round({c} - avg({c}) FILTER (sequence_id < 5) OVER (PARTITION BY measurement_id), 4) + 0.0 AS {c}" for c in _AX)


@query("w03_baseline", _S + f" SELECT measurement_id, sequence_id, {_BASE} FROM samples")
def w03(spark, d):
    return rounded(clean.remove_baseline(T.samples(spark, d)), *_AX).select("measurement_id", "sequence_id", *_AX)


@query(
    "w04_speakers",
    "WITH " + T.MANIFEST_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY speaker_id, clip_id) - 1 AS ordinal FROM manifest)
    SELECT clip_id, 'speaker_' || lpad(CAST(ordinal // 5 + 1 AS VARCHAR), 3, '0') AS speaker_local_id, source || '_speaker_' || lpad(CAST(ordinal // 5 + 1 AS VARCHAR), 3, '0') AS speaker_id, CAST(ordinal % 5 + 1 AS INTEGER) AS utterance_id FROM o""",
)
def w04(spark, d):
    m = T.manifest(spark, d).drop("speaker_id").withColumn("folder", F.lit(None).cast("string"))
    return clean.speaker_ids(m).select("clip_id", "speaker_local_id", "speaker_id", "utterance_id")


@query("w05_natural_order", "SELECT doc_id, row_number() OVER (ORDER BY source[1:3], CAST(source[4:] AS INTEGER), doc_id) AS position FROM documents")
def w05(spark, d):
    p = T.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    keyed = p.select("doc_id", clean.natural_key(F.col("path")).alias("k"))
    return tables.positions(keyed, F.col("k")).select("doc_id", "position")


@query(
    "w06_balanced_merge",
    """WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS label, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'new' ELSE 'old' END AS origin FROM orders)
    SELECT id, label, origin FROM b QUALIFY row_number() OVER (PARTITION BY label, origin ORDER BY id) <= CASE WHEN origin = 'new' THEN 50 ELSE 30 END""",
)
def w06(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), "o_orderdate")
    cut = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    return clean.balanced_merge(o.filter(cut).drop("o_orderdate"), o.filter(~cut).drop("o_orderdate"), 50, 30)[0].select("id", "label", "origin")


@query("w07_next_index", "SELECT source AS label, max(doc_id) + 1 AS next_index FROM documents GROUP BY source")
def w07(spark, d):
    n = T.table(spark, d, "documents").select(F.col("source").alias("label"), F.concat(F.lit("take_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return clean.next_index(n)


@query("a01_manifest_counts", "SELECT coalesce(source, 'combined') AS source, measurements, rows FROM (SELECT event_type AS source, count(DISTINCT user_id) AS measurements, count(*) AS rows FROM events GROUP BY ROLLUP (event_type))")
def a01(spark, d):
    return clean.manifest_counts(T.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("measurement_id")))


@query("a02_value_counts", _S + " SELECT label, count(*) AS n FROM samples GROUP BY label ORDER BY label")
def a02(spark, d):
    return tables.value_counts(T.samples(spark, d), "label")


@query("a03_crosstab", "WITH " + T.MANIFEST_SQL + " SELECT source, count(*) FILTER (label = 'q0') AS q0, count(*) FILTER (label = 'q1') AS q1 FROM manifest GROUP BY source")
def a03(spark, d):
    return tables.crosstab(T.manifest(spark, d), "source", "label", ["q0", "q1"])


@query("a05_length_profile", "SELECT min(n) AS least, max(n) AS most, CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS median, round(avg(n), 4) AS mean FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def a05(spark, d):
    return tables.length_profile(T.table(spark, d, "events"), "user_id").withColumn("mean", F.round("mean", 4))


@query(
    "a06_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin FROM events, e)
    SELECT CAST(g.bin AS INTEGER) AS bin, count(b.bin) AS n FROM range(40) g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin""",
)
def a06(spark, d):
    return evaluate.histogram(T.table(spark, d, "events"), "value")


@query("u01_union", _S + " SELECT measurement_id, sequence_id, label, NULL AS source FROM samples WHERE label_id < 3 UNION ALL SELECT measurement_id, sequence_id, label, 'reviewed' FROM samples WHERE label_id >= 3")
def u01(spark, d):
    s = T.samples(spark, d).select("measurement_id", "sequence_id", "label", "label_id")
    return tables.align_union(s.filter("label_id < 3"), s.filter("label_id >= 3").withColumn("source", F.lit("reviewed"))).select("measurement_id", "sequence_id", "label", "source")


@query("u02_class_coverage", "WITH " + T.MANIFEST_SQL + " SELECT source, count(DISTINCT label) = (SELECT count(DISTINCT label) FROM manifest) AS covers FROM manifest GROUP BY source")
def u02(spark, d):
    return tables.class_coverage(T.manifest(spark, d), "source", "label")


@query("u03_set_operations", "SELECT user_id, 'both' AS side FROM (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150) UNION ALL SELECT user_id, 'left' FROM (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150 EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def u03(spark, d):
    e = T.table(spark, d, "events").filter("value > 150")
    a, b = e.filter("event_type = 'error'").select("user_id"), e.filter("event_type = 'purchase'").select("user_id")
    return tables.name_sides(a, b)


@query("u04_label_map", _S + " SELECT DISTINCT label_id, label FROM samples WHERE label IS NOT NULL")
def u04(spark, d):
    return tables.label_map(T.samples(spark, d))


@query("o01_stable_sort", "WITH " + T.MANIFEST_SQL + " SELECT clip_id, row_number() OVER (ORDER BY label_id, source, speaker_id, clip_id) AS position FROM manifest")
def o01(spark, d):
    m = T.manifest(spark, d).select("clip_id", "label_id", "source", "speaker_id")
    return tables.positions(m, *[F.col(c) for c in ("label_id", "source", "speaker_id", "clip_id")]).select("clip_id", "position")


@query("o02_page", "SELECT doc_id, source, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def o02(spark, d):
    from wavefold.operators import review

    return review.page(T.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 50)


@query("o03_best_runs", "SELECT l_orderkey AS run, round(avg(l_discount), 4) AS test_acc, round(avg(l_tax), 4) AS val_acc FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def o03(spark, d):
    g = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(F.avg("l_discount"), 4).alias("test_acc"), F.round(F.avg("l_tax"), 4).alias("val_acc"))
    return tables.best_runs(g, 20)


@query("o04_newest_artefact", "SELECT event_type AS kind, arg_max('run_' || user_id || '/model.h', {'m': ts, 'p': 'run_' || user_id || '/model.h'}) AS newest FROM events GROUP BY event_type")
def o04(spark, d):
    files = T.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("/model.h")).alias("path"), F.col("ts").alias("modified"))
    return clean.newest_artefact(files, "kind")


@query("j05_label_conflicts", _S + " SELECT label_id, min(label) AS label, count(DISTINCT label) > 1 AS conflict FROM samples GROUP BY label_id")
def j05(spark, d):
    return tables.label_conflicts(T.samples(spark, d))


@query("p13_column_contract", "SELECT unnest(['acc_x', 'acc_y']) AS missing, rows FROM (SELECT count(*) AS rows FROM events)")
def p13(spark, d):
    from wavefold.schemas import SAMPLE_COLUMNS, require_columns

    s = T.samples(spark, d)
    require_columns(s, SAMPLE_COLUMNS)
    less = s.drop("acc_x", "acc_y")
    missing = sorted(set(SAMPLE_COLUMNS) - set(less.columns))
    return less.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.lit(m) for m in missing])).alias("missing"), "rows")

