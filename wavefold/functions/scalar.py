"""Scalar functions: mel scale, windows, topics, names, payloads, softmax, hashed randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def mel_filterbank(spark: SparkSession, n_mels: int = 40, n_fft: int = 512, sample_rate: int = 16000, low: float = 0.0, high: float | None = None) -> DataFrame:
    """(mel, bin, w): triangles between mel points, each at least a bin wide, with area 2 / (width in Hz)."""
    top = float(high or sample_rate / 2)
    m0, m1 = 2595 * math.log10(1 + low / 700), 2595 * math.log10(1 + top / 700)
    p = spark.range(n_mels + 2).select(F.col("id").alias("i"), mel_to_hz(F.lit(m0) + F.col("id") * ((m1 - m0) / (n_mels + 1))).alias("hz"))
    p = p.select("i", "hz", F.floor((n_fft + 1) * F.col("hz") / sample_rate).alias("bin"))
    w = Window.orderBy("i")  # n_mels + 2 rows
    t = p.select(F.col("i").alias("mel"), F.col("bin").alias("b0"), F.lead("bin").over(w).alias("b1"), F.lead("bin", 2).over(w).alias("b2"), "hz", F.lead("hz", 2).over(w).alias("hz2")).filter("hz2 is not null")
    t = t.withColumn("b1", F.greatest("b1", F.col("b0") + 1)).withColumn("b2", F.greatest("b2", F.col("b1") + 1))
    t = t.withColumn("bin", F.explode(F.sequence(F.col("b0"), F.col("b2") - 1))).filter(F.col("bin") <= n_fft // 2)
    up, down = (F.col("bin") - F.col("b0")) / (F.col("b1") - F.col("b0")), (F.col("b2") - F.col("bin")) / (F.col("b2") - F.col("b1"))
    return t.select("mel", "bin", (F.when(F.col("bin") < F.col("b1"), up).otherwise(down) * 2 / (F.col("hz2") - F.col("hz"))).alias("w"))


def dct_matrix(spark: SparkSession, n: int = 40) -> DataFrame:
    """(k, mel, w): orthonormal DCT-II."""
    g = spark.range(n * n).select(F.floor(F.col("id") / n).alias("k"), (F.col("id") % n).alias("mel"))
    w = F.cos(F.lit(math.pi / n) * (F.col("mel") + 0.5) * F.col("k")) * math.sqrt(2.0 / n)
    return g.select("k", "mel", (w * F.when(F.col("k") == 0, 1 / math.sqrt(2.0)).otherwise(1.0)).alias("w"))


def hann(n: Column, length: int) -> Column:
    return 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * n / (length - 1))


def device_of_topic(topic: Column) -> Column:
    """Second part of a topic of four or more parts whose third is sensor or viz, else null."""
    parts = F.filter(F.split(topic, "/"), lambda x: x != "")
    return F.when((F.size(parts) >= 4) & F.element_at(parts, 3).isin("sensor", "viz"), F.element_at(parts, 2))


def topic_matches(topic: Column, pattern: str) -> Column:
    """Topic filter with + for one level and # for the rest."""
    rx = "/".join("[^/]+" if p == "+" else ".*" if p == "#" else "\\Q" + p + "\\E" for p in pattern.split("/"))
    return topic.rlike(f"^{rx}$")


def normal_suffix(s: Column, default: str = ".wav") -> Column:
    t = F.trim(s)
    t = F.when(t == "", default).otherwise(t)
    return F.when(t.startswith("."), t).otherwise(F.concat(F.lit("."), t))


def resolve_suffix(explicit: Column, filename: Column, default: str = ".wav") -> Column:
    """Explicit suffix, else that of the file name, else the default."""
    own = F.nullif(F.regexp_extract(filename, r"[^/.](\.[^./]+)$", 1), F.lit(""))
    named = F.when(F.trim(filename) != "", F.coalesce(own, F.lit(default)))
    return F.coalesce(F.when(F.trim(explicit) != "", normal_suffix(explicit, default)), named, F.lit(default))


def path_safe(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))


def decode_payload(data: Column, kind: Column) -> Column:
    """Bytes of a hex or base64 text; null where it is not valid."""
    even = (F.length(data) % 2 == 0) & data.rlike("^[0-9A-Fa-f]*$")
    return F.when(kind == "hex", F.when(even, F.unhex(data))).otherwise(F.try_to_binary(data, F.lit("base64")))


def softmax(logits: DataFrame, key: str, cls: str = "cls", z: str = "z") -> DataFrame:
    """Rows with p: softmax over the classes of each key."""
    w = Window.partitionBy(key)
    e = F.exp(F.col(z) - F.max(z).over(w))
    return logits.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def classify(probabilities: DataFrame, key: str, cls: str = "cls") -> DataFrame:
    """key, pred_id (highest p, ties to the lowest class), confidence."""
    best = F.max(F.struct(F.col("p"), (-F.col(cls)).alias("c")))
    return probabilities.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.c")).alias("pred_id"), F.col("b.p").alias("confidence"))


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform number in 0..1 from md5 of seed and parts: the same in any run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def fine_uniform(seed: int, *parts: Column) -> Column:
    """As ``uniform``, of 52 bits: for lookups in more intervals than 32 bits tell apart."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def order_key(seed: int, *parts: Column) -> Column:
    """md5 of seed and parts, for a seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
