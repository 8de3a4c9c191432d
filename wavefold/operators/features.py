"""Feature jobs on long rows: resampling, normalisation, quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.schemas import AXES


@lru_cache(maxsize=1024)
def resample_kernel(count: int, target: int) -> np.ndarray:
    """Weight of each of ``count`` samples (columns) in each of ``target`` outputs: the closed form of copying spectrum bins.

    With kp = min(count, target), h = floor(kp / 2) and H harmonics of both signs
    (h - 1 for even kp, h for odd), a Dirichlet kernel plus the single middle bin.
    """
    if count == target:
        return np.eye(count)
    kp = min(count, target)
    even, h = kp % 2 == 0, kp // 2
    harmonics = h - 1 if even else h
    m, n = np.arange(target)[:, None], np.arange(count)[None, :]
    d = m / target - n / count
    s = np.sin(np.pi * d)
    flat = np.abs(s) < 1e-12
    out = np.where(flat, 2.0 * harmonics + 1, np.sin(np.pi * (2 * harmonics + 1) * d) / np.where(flat, 1.0, s))
    if even:
        out = out + (np.cos(2 * np.pi * h * d) if count > target else 2 * np.cos(np.pi * n) * np.cos(np.pi * count * m / target))
    return out / count


def _resampled(key: str, channels: tuple[str, ...], target: int):
    def windows(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The windows that begin at ``starts``, those of one length by one product with its kernel."""
        columns = [t.column(c).combine_chunks() for c in channels]
        x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        some = np.stack([np.add.reduceat(c.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts) for c in columns], axis=1) > 0
        counts = np.diff(np.r_[starts, len(x)])
        out = np.empty((len(starts), target, len(channels)))
        for count in np.unique(counts).tolist():
            of = np.flatnonzero(counts == count)
            out[of] = np.einsum("mn,bnc->bmc", resample_kernel(count, target), x[starts[of][:, None] + np.arange(count)], optimize=True)
        keys = t.column(key).combine_chunks().take(pa.array(np.repeat(starts, target)))
        values = [pa.array(out[:, :, i].ravel(), mask=np.repeat(~some[:, i], target)) for i in range(len(channels))]
        return pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(target, dtype=np.int32), len(starts))), *values], names=[key, "m", *channels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            of = pc.fill_null(t.column(key).combine_chunks().dictionary_encode().indices, -1).to_numpy()
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            held = t.slice(int(starts[-1]))  # the last window may go on
            if len(starts) > 1:
                yield windows(t.slice(0, int(starts[-1])), starts[:-1])
        if held is not None:
            yield windows(held, np.zeros(1, np.int64))

    return run


def resample_spectral(df: DataFrame, key: str = "measurement_id", seq: str = "sequence_id", channels: tuple[str, ...] = AXES, target: int = 60) -> DataFrame:
    """key, m (0..target-1) and the channels of each window at ``target`` samples.

    Rows are sorted by window in one exchange and multiplied by the kernel of their window's length, a matrix that
    is made once a worker. A task holds one Arrow batch and the window that it ends in; null samples add nothing.
    """
    d = df.select(key, seq, *[F.col(c).cast("double").alias(c) for c in channels]).repartition(key).sortWithinPartitions(key, seq).drop(seq)
    name, kind = f"`{key}`", df.schema[key].dataType.simpleString()
    return d.mapInArrow(_resampled(key, channels, target), f"{name} {kind}, m int, " + ", ".join(f"`{c}` double" for c in channels))


def resample_linear(df: DataFrame, key: str, seq: str, channels: tuple[str, ...], target: int = 60) -> DataFrame:
    """As resample_spectral, by linear interpolation on a grid over [0, 1]; one sample is repeated."""
    w = Window.partitionBy(key).orderBy(seq)
    d = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(key)))
    d = d.select(key, "_n", "_c", *channels, *[F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"_next_{c}") for c in channels])
    # Output m lies at m * (count - 1) / (target - 1), between samples n and n + 1; each sample makes its own outputs.
    last = F.lit(target - 1)
    first = F.ceil(F.col("_n") * last / F.greatest(F.col("_c") - 1, F.lit(1)))
    end = F.when(F.col("_n") == F.col("_c") - 1, last).otherwise(F.ceil((F.col("_n") + 1) * last / F.greatest(F.col("_c") - 1, F.lit(1))) - 1)
    first = F.when(F.col("_c") == 1, F.lit(0).cast("long")).otherwise(first)
    d = d.withColumn("_a", first).withColumn("_b", end.cast("long")).filter("_a <= _b").withColumn("m", F.explode(F.sequence("_a", "_b")))
    f = F.col("m") * (F.col("_c") - 1) / last - F.col("_n")
    return d.select(key, "m", *[(F.col(c) + f * (F.col(f"_next_{c}") - F.col(c))).alias(c) for c in channels])


def fit_stats(df: DataFrame, channel: str = "channel", value: str = "v", eps: float = 0.0) -> DataFrame:
    """channel, mean, std (population, plus eps; 1 where the variance is 0 and eps is 0)."""
    std = F.stddev_pop(value)
    safe = F.when(std == 0, 1.0).otherwise(std) if eps == 0 else std + eps
    return df.groupBy(channel).agg(F.avg(value).alias("mean"), safe.alias("std"))


def apply_stats(df: DataFrame, stats: DataFrame, channel: str = "channel", value: str = "v") -> DataFrame:
    """Values less their channel's mean over its deviation; the statistics have one row a channel."""
    return df.join(stats, channel).withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def pack_q88(v: Column) -> Column:
    """Unsigned 16-bit word of signed 8.8 fixed point: half to even, saturated."""
    return F.rint(F.greatest(F.lit(-128.0), F.least(F.lit(127.99609375), v)) * 256).cast("int").bitwiseAND(F.lit(0xFFFF))


def unpack_q88(word: Column) -> Column:
    return F.when(word >= 0x8000, word - 0x10000).otherwise(word) / 256


def truncate_q88(v: Column) -> Column:
    """8.8 value with truncation toward zero and saturation."""
    return (F.greatest(F.lit(-128.0), F.least(F.lit(127.99609375), v)) * 256).cast("int") / 256


def fix_frames(df: DataFrame, key: str, frame: str = "frame", target: int = 50, keep: tuple[str, ...] = ("channel",), value: str = "v", left: bool = False) -> DataFrame:
    """Each clip at ``target`` frames: centre crop (or from the left), zeros behind."""
    count = F.max(F.col(frame)).over(Window.partitionBy(key)) + 1
    start = F.lit(0) if left else F.floor(F.greatest(count - target, F.lit(0)) / 2)
    d = df.withColumn("_f", F.col(frame) - start).filter((F.col("_f") >= 0) & (F.col("_f") < target))
    grid = df.select(key, *keep).distinct().withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
    return grid.join(d.select(key, *keep, "_f", value), [key, *keep, "_f"], "left").select(key, *keep, F.col("_f").cast("int").alias(frame), F.coalesce(value, F.lit(0.0)).alias(value))


def cepstral_norm(df: DataFrame, key: str, channel: str = "channel", value: str = "v", var: bool = False, eps: float = 1e-8) -> DataFrame:
    """Values less the mean of their clip and coefficient, optionally over its deviation."""
    w = Window.partitionBy(key, channel)
    v = F.col(value) - F.avg(value).over(w)
    return df.withColumn(value, v / F.greatest(F.stddev_pop(value).over(w), F.lit(eps)) if var else v)


def flatten_time_major(df: DataFrame, key: str, channel: str = "channel", frame: str = "frame", value: str = "v") -> DataFrame:
    """key and its values as one array ordered by frame, then channel."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(frame, channel, value))), lambda x: x[value]).alias("flat"))


def window_stats(df: DataFrame, key: str, channels: tuple[str, ...]) -> DataFrame:
    """Samples, channels, minimum, maximum, mean and population deviation over all cells of each window."""
    n, k = F.count(F.lit(1)), len(channels)
    total, square = sum(F.sum(c) for c in channels), sum(F.sum(F.col(c) * F.col(c)) for c in channels)
    mean = total / (n * k)
    return df.groupBy(key).agg(
        n.alias("samples"), F.lit(k).alias("channels"), F.least(*[F.min(c) for c in channels]).alias("low"), F.greatest(*[F.max(c) for c in channels]).alias("high"),
        mean.alias("mean"), F.sqrt(F.greatest(square / (n * k) - mean * mean, F.lit(0.0))).alias("std"),
    )
