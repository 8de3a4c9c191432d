"""Splits, augmentation and resampling with hashed, engine-independent randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.functions.scalar import fine_uniform, order_key, uniform
from wavefold.operators.clean import valid_labels
from wavefold.operators.features import pack_q88
from wavefold.operators.lineage import carried, numbered


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal number by Box-Muller from two hashed uniforms."""
    a, b = uniform(seed, *parts, F.lit("a")), uniform(seed, *parts, F.lit("b"))
    return F.sqrt(-2 * F.log(F.greatest(a, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * b)


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with split: in each class the first round(test * n) in hash order are test, then round(val * rest) val."""
    w = Window.partitionBy(label)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(order_key(seed, F.col(key)), key))).withColumn("_n", F.count(F.lit(1)).over(w))
    n_test = F.round(F.col("_n") * test)
    n_val = F.round((F.col("_n") - n_test) * val)
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    return d.withColumn("split", split).drop("_r", "_n")


def heldout_split(df: DataFrame, source: str | None, test_speakers: int = 5, val_size: float = 0.2, min_val: int = 2, seed: int = 42, attempts: int = 256, speaker: str = "speaker_id", label: str = "label_id") -> DataFrame:
    """Rows with split, by speaker.

    The first speakers (sorted) of one source are test; of the rest, hashed orders
    for seeds seed, seed + 1, ... are compared in one query, and the first whose
    val and train speakers both cover all labels is taken. Without source only
    train and val are made. Rows of the result are empty if no seed does.
    """
    pairs = df.groupBy(speaker, label).agg(F.max((F.col("source") == source).cast("int") if source else F.lit(0)).alias("own"))
    speakers = pairs.groupBy(speaker).agg(F.max("own").alias("own"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(speaker))  # one row a speaker
    speakers = speakers.withColumn("_test", (F.col("own") == 1) & (rank <= test_speakers) if source else F.lit(False))
    rest = speakers.filter(~F.col("_test")).select(speaker)
    tries = rest.withColumn("seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + attempts - 1))))
    w = Window.partitionBy("seed")
    tries = tries.withColumn("_r", F.row_number().over(w.orderBy(order_key(0, F.col("seed"), F.col(speaker)), speaker))).withColumn("_n", F.count(F.lit(1)).over(w))
    n_val = F.least(F.greatest(F.lit(min_val), F.round(F.col("_n") * val_size)), F.col("_n") - 1)
    tries = tries.withColumn("split", F.when(F.col("_r") <= n_val, "val").otherwise("train")).select(speaker, "seed", "split")
    wanted = df.agg(F.countDistinct(label).alias("_all"))
    cover = tries.join(pairs.select(speaker, label), speaker).groupBy("seed", "split").agg(F.countDistinct(label).alias("_c")).crossJoin(F.broadcast(wanted))
    good = cover.filter("_c = _all").groupBy("seed").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").agg(F.min("seed").alias("seed"))
    chosen = tries.join(F.broadcast(good), "seed").select(speaker, "split").unionByName(speakers.filter("_test").select(speaker, F.lit("test").alias("split")))
    return df.join(chosen, speaker)


def copies(df: DataFrame, factor: int) -> DataFrame:
    """Each row ``factor`` times, numbered by copy; copy 0 is the original."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


def augment_windows(df: DataFrame, key: str, seq: str, channels: tuple[str, ...], factor: int = 3, seed: int = 42, jitter: float = 0.05) -> DataFrame:
    """(key, copy, seq, channels): copies scaled by 0.8..1.2, shifted by up to 0.02 a channel, jittered; 40 % are cropped by up to 10 % at each end.

    Cropped copies are shorter; resample_spectral brings them to length again.
    """
    d, n = copies(df, factor), F.count(F.lit(1)).over(Window.partitionBy(key))
    d = d.withColumn("_n", n / factor)
    k = (F.col(key), F.col("copy"))
    crop = uniform(seed, *k, F.lit("crop")) < 0.4
    head, tail = F.floor(uniform(seed, *k, F.lit("head")) * 0.1 * F.col("_n")), F.floor(uniform(seed, *k, F.lit("tail")) * 0.1 * F.col("_n"))
    inside = (F.col("copy") == 0) | ~crop | ((F.col(seq) >= head) & (F.col(seq) < F.col("_n") - tail))
    scale = 0.8 + 0.4 * uniform(seed, *k, F.lit("scale"))
    made = {c: F.col(c) * scale + (uniform(seed, *k, F.lit(c)) - 0.5) * 0.04 + (jitter * normal(seed, *k, F.lit(c), F.col(seq)) if jitter else F.lit(0.0)) for c in channels}
    return d.filter(inside).select(key, "copy", seq, *[F.when(F.col("copy") == 0, F.col(c)).otherwise(made[c]).alias(c) for c in channels])


def augment_features(df: DataFrame, key: str, frames: int, channels: int, factor: int = 2, seed: int = 42, noise: float = 0.03) -> DataFrame:
    """Copies of feature matrices: gain of 15 %, tilt over channels, roll by up to 4 frames, masks in time and channel, noise."""
    d = copies(df, factor)
    u = lambda name: uniform(seed, F.col(key), F.col("copy"), F.lit(name))
    gain = 0.85 + 0.3 * u("gain")
    tilt = 1 + (u("tilt") - 0.5) * 0.1 * (F.col("channel") / max(1, channels - 1) - 0.5)
    frame = F.pmod(F.col("frame") + F.floor(u("roll") * 9).cast("int") - 4, F.lit(frames))

    def masked(name: str, at: Column, total: int, width: int) -> Column:
        size = F.floor(u(name + "w") * (min(width, total) + 1))
        start = F.floor(u(name + "s") * (total - size + 1))
        return (at >= start) & (at < start + size)

    hidden = masked("t1", frame, frames, 8) | masked("t2", frame, frames, 8) | masked("f1", F.col("channel"), channels, 5) | masked("f2", F.col("channel"), channels, 5)
    v = F.when(hidden, 0.0).otherwise(F.col("v") * gain * tilt + (noise * normal(seed, F.col(key), F.col("copy"), F.col("channel"), F.col("frame")) if noise else F.lit(0.0)))
    return d.select(key, "copy", "channel", F.when(F.col("copy") == 0, F.col("frame")).otherwise(frame).alias("frame"), F.when(F.col("copy") == 0, F.col("v")).otherwise(v).alias("v"))


def augment_clips(df: DataFrame, key: str, factor: int = 2, seed: int = 42, noise: float = 0.005) -> DataFrame:
    """Copies of waveforms: gain 0.8..1.2, shift by up to 10 samples (zeros come in), noise, clamp to -1..1."""
    d, w = copies(df, factor), Window.partitionBy(key, "copy")
    u = lambda name: uniform(seed, F.col(key), F.col("copy"), F.lit(name))
    moved = F.col("n") + F.when(F.col("copy") == 0, 0).otherwise(F.floor(u("shift") * 21) - 10)
    total = F.count(F.lit(1)).over(w)
    v = F.col("v") * (0.8 + 0.4 * u("gain")) + (noise * normal(seed, F.col(key), F.col("copy"), F.col("n")) if noise else F.lit(0.0))
    d = d.withColumn("_t", total).withColumn("_m", moved)
    return d.filter("_m >= 0 and _m < _t").select(key, "copy", F.col("_m").cast("int").alias("n"), F.when(F.col("copy") == 0, F.col("v")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))).alias("v"))


def weighted_resample(df: DataFrame, key: str, weight: str, factor: int = 6, seed: int = 42, bits: int = 12) -> DataFrame:
    """(draw, key): n * factor draws with replacement, proportional to weight.

    In a hashed order (2^bits buckets, then key) each key owns an interval of the total
    weight. The beginnings of the intervals and the draws (hashed uniforms of 52 bits) are merged in one
    sort by ranges, and each draw gets the last interval begun. Work is linear but for the sorts, whatever the weights.
    """
    bucket = F.shiftright(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")
    d = df.select(key, F.col(weight).cast("double").alias("_w")).filter("_w > 0").withColumn("_b", bucket)
    keys = numbered(d, F.col("_b"), F.col(key), name="_at", weight=F.col("_w"), kind="double")
    total = d.agg(F.sum("_w").alias("_total"))
    # Draws are made by the keys themselves, so they are as many as n * factor and made in parallel.
    draws = d.select(key, F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("_f")).select(F.concat_ws(":", F.col(key).cast("string"), F.col("_f").cast("string")).alias("draw"))
    draws = draws.crossJoin(F.broadcast(total)).select("draw", (fine_uniform(seed, F.col("draw")) * F.col("_total")).alias("_at"))  # one row
    both = keys.select("_at", F.lit(0).alias("_kind"), F.col(key), F.lit(None).cast("string").alias("draw"))
    both = both.unionByName(draws.select("_at", F.lit(1).alias("_kind"), F.lit(None).cast(df.schema[key].dataType).alias(key), "draw"))
    hit = carried(both, F.col("_at"), F.col("_kind"), F.col(key), F.col("draw"), value=key, name="_key")
    return hit.filter(F.col("_kind") == 1).select("draw", F.col("_key").alias(key))


def gamma(shape: float, seed: int, *parts: Column, tries: int = 8) -> Column:
    """Gamma distributed number of unit scale from hashed uniforms, by Marsaglia and Tsang.

    A try is accepted with a probability of 0.95 or more; should all ``tries`` fail (below 10^-10), the mode is taken.
    """
    d = max(shape, shape + 1 if shape < 1 else shape) - 1 / 3
    z = lambda t: normal(seed, *parts, t)
    each = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda t: F.struct(z(t).alias("z"), F.log(F.greatest(uniform(seed, *parts, t, F.lit("u")), F.lit(1e-12))).alias("u")))
    each = F.transform(each, lambda x: F.struct(x["z"].alias("z"), x["u"].alias("u"), F.pow(1 + x["z"] / math.sqrt(9 * d), F.lit(3.0)).alias("v")))
    good = F.filter(each, lambda x: (x["v"] > 0) & (x["u"] < 0.5 * x["z"] * x["z"] + d - d * x["v"] + d * F.log(F.greatest(x["v"], F.lit(1e-300)))))
    g = d * F.coalesce(F.get(good, F.lit(0))["v"], F.lit(1.0))
    return g * F.pow(F.greatest(uniform(seed, *parts, F.lit("w")), F.lit(1e-12)), 1 / shape) if shape < 1 else g


def beta(alpha: float, seed: int, *parts: Column) -> Column:
    """Number of the symmetric Beta law: the share of one of two gamma numbers."""
    a, b = (gamma(alpha, seed, *parts, F.lit(name)) for name in "xy")
    return a / (a + b)


def mixup(df: DataFrame, key: str, alpha: float = 0.2, seed: int = 42, cells: tuple[str, ...] = ("channel", "frame")) -> DataFrame:
    """Each item mixed with its successor in a hashed order: lam * x + (1 - lam) * x', lam of Beta(alpha, alpha).

    The order runs inside 256 hash buckets, so no window holds all items.
    """
    ids = df.select(key).distinct().withColumn("_b", F.left(order_key(seed, F.col(key)), F.lit(2)))
    w = Window.partitionBy("_b").orderBy(order_key(seed, F.col(key)), key)
    first = F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ids = ids.withColumn("_other", F.coalesce(F.lead(key).over(w), first)).select(key, "_other", beta(alpha, seed, F.col(key)).alias("lam"))
    other = df.select(F.col(key).alias("_other"), *cells, F.col("v").alias("_v"))
    return df.join(ids, key).join(other, ["_other", *cells]).select(key, F.col("_other").alias("other"), "lam", *cells, (F.col("lam") * F.col("v") + (1 - F.col("lam")) * F.col("_v")).alias("v"))


def export_cases(df: DataFrame, key: str, label: str, n_classes: int, n: int = 300, seed: int = 42) -> DataFrame:
    """(key, label, words): ``n`` items of valid label in hashed order, without replacement, as 8.8 fixed-point words.

    ``df`` has ``flat``, the time-major values of each item (``features.flatten_time_major`` makes it of long rows).
    """
    chosen = valid_labels(df, label, key, n_classes).orderBy(order_key(seed, F.col(key)), key).limit(n)
    return chosen.select(key, label, F.transform("flat", lambda x: pack_q88(x.cast("double"))).alias("words"))
