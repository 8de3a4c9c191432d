"""Cepstral features of clips: an Arrow engine over clip rows, and the same in SQL form on long rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavefold.functions.scalar import dct_matrix, hann, mel_filterbank
from wavefold.operators import signal


@dataclass(frozen=True)
class MfccConfig:
    sample_rate: int = 16000
    win: int = 400
    hop: int = 320
    n_fft: int = 512
    n_mels: int = 40
    n_mfcc: int = 40
    frames: int = 50
    pre_emphasis: float = 0.97
    eps: float = 1e-8
    mean_norm: bool = True


def _tables(df: DataFrame, cfg: MfccConfig) -> tuple[np.ndarray, np.ndarray]:
    """Filterbank (mel x bin) and DCT (k x mel) from their table forms: fixed sizes, a few thousand cells."""
    fb, dct = np.zeros((cfg.n_mels, cfg.n_fft // 2 + 1)), np.zeros((cfg.n_mels, cfg.n_mels))
    for r in mel_filterbank(df.sparkSession, cfg.n_mels, cfg.n_fft, cfg.sample_rate).collect():
        fb[r["mel"], r["bin"]] = r["w"]
    for r in dct_matrix(df.sparkSession, cfg.n_mels).collect():
        dct[r["k"], r["mel"]] = r["w"]
    return fb, dct[: cfg.n_mfcc]


def clip_mfcc(v: np.ndarray, fb: np.ndarray, dct: np.ndarray, cfg: MfccConfig) -> np.ndarray:
    """(n_mfcc, frames) of one waveform."""
    v = np.r_[v[:1], v[1:] - cfg.pre_emphasis * v[:-1]] if cfg.pre_emphasis and len(v) else v
    pad = cfg.n_fft // 2
    v = np.pad(v, pad, mode="reflect" if len(v) > 1 else "edge" if len(v) else "constant")
    v = np.pad(v, (0, max(0, cfg.win - len(v))))
    n = 1 + (len(v) - cfg.win) // cfg.hop
    framed = np.lib.stride_tricks.sliding_window_view(v, cfg.win)[:: cfg.hop][:n] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(cfg.win) / (cfg.win - 1)))
    power = np.abs(np.fft.rfft(framed, cfg.n_fft)) ** 2
    c = dct @ np.log(fb @ power.T + cfg.eps)
    start = max(0, (n - cfg.frames) // 2)
    c = c[:, start : start + cfg.frames]
    c = np.pad(c, ((0, 0), (0, cfg.frames - c.shape[1])))
    return c - c.mean(axis=1, keepdims=True) if cfg.mean_norm else c


def mfcc(clips: DataFrame, cfg: MfccConfig = MfccConfig()) -> DataFrame:
    """(clip_id, mfcc: flat array of n_mfcc x frames, row by row) of rows (clip_id, samples)."""
    fb, dct = _tables(clips, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("samples")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            out = np.array([clip_mfcc(flat[a:z], fb, dct, cfg).ravel() for a, z in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else [])
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * cfg.n_mfcc * cfg.frames, out.ravel())
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), lists], names=["clip_id", "mfcc"])

    return clips.select("clip_id", "samples").mapInArrow(run, "clip_id long, mfcc array<double>")


def voice_front_end(df: DataFrame, cfg: MfccConfig, trim_db: float = -28.0, floor_db: float = -45.0, pad_s: float = 0.08, frame_s: float = 0.02, hop_s: float = 0.01, target_db: float = -18.0, peak_db: float = -1.0, half_s: float | None = 0.5) -> DataFrame:
    """Long rows (clip_id, n, v) as the features take them: silence trimmed, loudness set, a window around the loudest part."""
    length, hop, pad = (max(1, round(x * cfg.sample_rate)) for x in (frame_s, hop_s, pad_s))
    d = signal.trim_silence(df, "clip_id", length, hop, pad, trim_db, floor_db)
    d = d.withColumn("n", (F.row_number().over(Window.partitionBy("clip_id").orderBy("n")) - 1).cast("long"))
    d = signal.normalize_loudness(d, "clip_id", target_db, peak_db).select("clip_id", "n", "v")
    return d if half_s is None else signal.focus(d, "clip_id", round(half_s * cfg.sample_rate), length, hop, trim_db, floor_db)


def voice_features(df: DataFrame, cfg: MfccConfig = MfccConfig(), **front_end) -> DataFrame:
    """(clip_id, mfcc) of long rows (clip_id, n, v): the front end, then the cepstral features of each clip."""
    d = voice_front_end(df, cfg, **front_end)
    return mfcc(d.groupBy("clip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("samples")), cfg)


def mfcc_long(df: DataFrame, cfg: MfccConfig) -> DataFrame:
    """(clip_id, coef, frame, v) from long rows (clip_id, n, v), in native operations.

    The spectrum is a join with cosine and sine tables and two sums, so this form
    is for few or short clips; it states what the Arrow engine computes.
    """
    w = Window.partitionBy("clip_id")
    d = df.withColumn("v", F.col("v") - cfg.pre_emphasis * F.coalesce(F.lag("v").over(w.orderBy("n")), F.lit(0.0))) if cfg.pre_emphasis else df
    d = d.withColumn("_t", F.count(F.lit(1)).over(w))
    pad, spark = cfg.n_fft // 2, df.sparkSession
    # Reflection: sample i also stands at -i and at 2 (t - 1) - i, as often as the padding reaches.
    period = 2 * (F.col("_t") - 1)
    one = F.col("_t") == 1
    reach = F.when(one, F.lit(pad)).otherwise(F.lit(pad // 2 + 1))
    k = F.explode(F.sequence(-reach, reach))
    images = d.withColumn("_k", k).select(
        "clip_id", "v", "_t", F.explode(F.when(one, F.array(F.col("_k"))).otherwise(F.array_distinct(F.array(F.col("n") + F.col("_k") * period, -F.col("n") + F.col("_k") * period)))).alias("_n")
    )
    padded = images.filter((F.col("_n") >= -pad) & (F.col("_n") < F.col("_t") + pad)).select("clip_id", (F.col("_n") + pad).alias("n"), "v", (F.col("_t") + 2 * pad).alias("_t")).distinct()
    last = F.greatest(F.floor((F.col("_t") - cfg.win) / cfg.hop), F.lit(0))
    fr = padded.withColumn("_a", F.greatest(F.ceil((F.col("n") - cfg.win + 1) / cfg.hop), F.lit(0))).withColumn("_b", F.least(F.floor(F.col("n") / cfg.hop), last)).filter("_a <= _b")
    fr = fr.withColumn("frame", F.explode(F.sequence("_a", "_b"))).withColumn("i", F.col("n") - F.col("frame") * cfg.hop)
    fr = fr.select("clip_id", "frame", "i", (F.col("v") * hann(F.col("i"), cfg.win)).alias("v"))
    fb = mel_filterbank(spark, cfg.n_mels, cfg.n_fft, cfg.sample_rate)
    used = fb.select("bin").distinct()
    angle = F.lit(2 * math.pi / cfg.n_fft) * F.col("bin") * F.col("i")
    spec = fr.crossJoin(F.broadcast(used)).groupBy("clip_id", "frame", "bin").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    mel = spec.join(F.broadcast(fb), "bin").groupBy("clip_id", "frame", "mel").agg(F.sum((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.col("w")).alias("e"))
    frames = fr.select("clip_id", "frame").distinct().crossJoin(F.broadcast(fb.select("mel").distinct()))
    mel = frames.join(mel, ["clip_id", "frame", "mel"], "left").withColumn("l", F.log(F.coalesce("e", F.lit(0.0)) + cfg.eps))
    dct = dct_matrix(spark, cfg.n_mels).filter(F.col("k") < cfg.n_mfcc)
    c = mel.join(F.broadcast(dct), "mel").groupBy("clip_id", F.col("k").alias("channel"), "frame").agg(F.sum(F.col("l") * F.col("w")).alias("v"))
    from wavefold.operators.features import cepstral_norm, fix_frames

    c = fix_frames(c, "clip_id", target=cfg.frames)
    c = cepstral_norm(c, "clip_id") if cfg.mean_norm else c
    return c.select("clip_id", F.col("channel").alias("coef"), "frame", "v")
