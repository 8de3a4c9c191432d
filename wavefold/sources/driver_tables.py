"""Views of the driver's tables as recordings: events as samples and clips, lineitem as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefold.schemas import LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sample table: a user is a measurement, its events in time order the samples."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("user_id", F.lit(6)) + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("measurement_id"), (F.row_number().over(order) - 1).alias("sequence_id"),
        F.pmod("user_id", F.lit(6)).cast("int").alias("label_id"), label.alias("label"),
        (F.col("value") / 20).alias("gyro_x"), (F.pmod("event_id", F.lit(7)) / 4).alias("gyro_y"), (F.pmod("event_id", F.lit(3)) / 8).alias("gyro_z"),
        (F.col("value") / 100).alias("acc_x"), (F.pmod("event_id", F.lit(5)) / 2).alias("acc_y"), F.lit(9.75).alias("acc_z"),
    )


SAMPLES_SQL = """samples AS (
  SELECT user_id AS measurement_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS sequence_id,
         CAST(user_id % 6 AS INTEGER) AS label_id, ['Raise', 'Shake', 'Chop', 'Stir', 'Swing', 'Punch'][user_id % 6 + 1] AS label,
         value / 20 AS gyro_x, (event_id % 7) / 4 AS gyro_y, (event_id % 3) / 8 AS gyro_z, value / 100 AS acc_x, (event_id % 5) / 2 AS acc_y, CAST(9.75 AS DOUBLE) AS acc_z
  FROM events)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as waveforms: clip_id, n, v with v = value / 500 and alternating sign."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("clip_id"), n.alias("n"), (F.col("value") / 500 * F.when(F.pmod("event_id", F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))


CLIPS_SQL = """clips AS (
  SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS n,
         value / 500 * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS v FROM events)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as windows: id (order), seq from 0 over all columns, label (return flag), four channels."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    return li.select(F.col("l_orderkey").alias("id"), (F.row_number().over(order) - 1).alias("seq"), F.col("l_linenumber").alias("sequence_id"), F.col("l_returnflag").alias("label"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


WINDOWS_SQL = """windows AS (
  SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS INTEGER) AS seq,
         l_linenumber AS sequence_id, l_returnflag AS label, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form: clip_id, label, channel (0..7), frame (0..7), v."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), "label", F.posexplode("embedding").alias("p", "x"))
    return e.select("clip_id", "label", F.floor(F.col("p") / 8).cast("int").alias("channel"), (F.col("p") % 8).cast("int").alias("frame"), F.col("x").cast("double").alias("v"))


FEATURES_SQL = """features AS (
  SELECT vec_id AS clip_id, label, CAST((p - 1) // 8 AS INTEGER) AS channel, CAST((p - 1) % 8 AS INTEGER) AS frame, CAST(embedding[p] AS DOUBLE) AS v
  FROM embeddings, unnest(range(1, 65)) AS t(p))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and documents as a clip manifest: path (doc_id), label, source."""
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    d = doc.select("doc_id", "source", "lang")
    return lab.join(d, "doc_id").select(F.col("doc_id").alias("clip_id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/clip_"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), F.col("quality").alias("label_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"), "source", F.col("lang").alias("speaker_id"))


MANIFEST_SQL = """manifest AS (
  SELECT doc_id AS clip_id, '/' || source || '/' || lang || '/clip_' || doc_id || '.wav' AS path, quality AS label_id, 'q' || quality AS label, source, lang AS speaker_id
  FROM labels JOIN documents USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as predictions: true_id is the label, pred_id and q88_pred_id follow from two components."""
    e = table(spark, sf_dir, "embeddings")
    shift = F.when(F.element_at("embedding", 1) > 0.1, 1).otherwise(0)
    other = F.when(F.element_at("embedding", 2) > 0.15, 1).otherwise(0)
    return e.select(F.col("vec_id").alias("clip_id"), F.col("label").alias("true_id"), F.pmod(F.col("label") + shift, F.lit(11)).alias("pred_id"), F.pmod(F.col("label") + shift + other, F.lit(11)).alias("q88_pred_id"))


PREDICTIONS_SQL = """preds AS (
  SELECT vec_id AS clip_id, label AS true_id, (label + CASE WHEN embedding[1] > 0.1 THEN 1 ELSE 0 END) % 11 AS pred_id,
         (label + CASE WHEN embedding[1] > 0.1 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0.15 THEN 1 ELSE 0 END) % 11 AS q88_pred_id FROM embeddings)"""
