"""Waveform operators on long rows (clip_id, n, v): framing, silence, loudness, segments, focus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefold.operators.lineage import cut


def db_to_amplitude(db: float | Column) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)


def amplitude_to_db(x: Column, silence: float | None = 1e-8) -> Column:
    """20 log10 of an amplitude; minus infinity up to ``silence``. With None, that of any number: minus infinity for zero, NaN below it."""
    db = 20 * F.log10(x)  # null up to zero
    if silence is None:
        return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(db)
    return F.when(x <= silence, F.lit(float("-inf"))).otherwise(db)


def frames(df: DataFrame, key: str, length: int, hop: int) -> DataFrame:
    """(key, frame, n, v): each sample in every frame that holds it; 1 + floor((N - L) / H) frames, at least one.

    Samples behind the last whole frame are in none; a short clip is one frame,
    whose missing samples count as zeros (they have no rows).
    """
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    last = F.greatest(F.floor((total - length) / hop), F.lit(0))
    first = F.greatest(F.ceil((F.col("n") - length + 1) / hop), F.lit(0))
    d = df.withColumn("_a", first).withColumn("_b", F.least(F.floor(F.col("n") / hop), last)).filter("_a <= _b")
    return d.select(key, F.explode(F.sequence("_a", "_b")).alias("frame"), "n", "v")


def frame_rms(df: DataFrame, key: str, length: int, hop: int) -> DataFrame:
    """(key, frame, rms); missing samples of a short clip's frame are zeros."""
    return frames(df, key, length, hop).groupBy(key, "frame").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / length).alias("rms"))


def silence_bounds(df: DataFrame, key: str, length: int, hop: int, pad: int, threshold_db: float = -28.0, floor_db: float = -45.0) -> DataFrame:
    """(key, a, b): the range from the first to the last active frame with padding; no row where nothing is active."""
    r = frame_rms(df, key, length, hop)
    peak = F.max("rms").over(Window.partitionBy(key))
    active = r.withColumn("_t", F.greatest(peak * db_to_amplitude(threshold_db), db_to_amplitude(floor_db))).filter("rms >= _t and _t > 0")
    return active.groupBy(key).agg((F.greatest(F.min("frame") * hop - pad, F.lit(0))).alias("a"), (F.max("frame") * hop + length + pad).alias("b"))


def trim_silence(df: DataFrame, key: str, length: int, hop: int, pad: int, threshold_db: float = -28.0, floor_db: float = -45.0) -> DataFrame:
    """Samples between the silence bounds, renumbered; clips without activity stay whole."""
    b = silence_bounds(df, key, length, hop, pad, threshold_db, floor_db)
    d = df.join(b, key, "left").filter(F.col("a").isNull() | ((F.col("n") >= F.col("a")) & (F.col("n") < F.col("b"))))
    return d.select(key, (F.col("n") - F.coalesce("a", F.lit(0))).alias("n"), "v")


def signal_stats(df: DataFrame, key: str) -> DataFrame:
    """Minimum, maximum, mean, deviation, rms and peak of each clip."""
    v = F.col("v")
    return df.groupBy(key).agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"),
    )


def normalize_loudness(df: DataFrame, key: str, target_db: float = -18.0, peak_db: float = -1.0, eps: float = 1e-8) -> DataFrame:
    """Each clip at the target rms, held below the peak limit and within -1..1; silent clips unchanged."""
    w = Window.partitionBy(key)
    rms, peak = F.sqrt(F.avg(F.col("v") * F.col("v")).over(w)), F.max(F.abs("v")).over(w)
    d = df.withColumn("_rms", rms).withColumn("_peak", peak)
    gain = db_to_amplitude(target_db) / F.col("_rms")
    limited = F.least(gain, db_to_amplitude(peak_db) / F.col("_peak"))
    v = F.when(F.col("_rms") <= eps, F.col("v")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") * limited)))
    return d.select(key, "n", v.alias("v"))


def clean_report(before: DataFrame, after: DataFrame, key: str, sample_rate: int) -> DataFrame:
    """For each clip: milliseconds before, after and trimmed, and the gain of its rms in dB."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("n0"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("r0"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("n1"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("r1"))
    ms = lambda c: F.col(c) * 1000.0 / sample_rate
    return b.join(a, key).select(key, ms("n0").alias("before_ms"), ms("n1").alias("after_ms"), (ms("n0") - ms("n1")).alias("trim_ms"), (amplitude_to_db(F.col("r1")) - amplitude_to_db(F.col("r0"))).alias("gain_db"))


def pre_emphasis(df: DataFrame, key: str, a: float = 0.97) -> DataFrame:
    before = F.lag("v").over(Window.partitionBy(key).orderBy("n"))
    return df.select(key, "n", (F.col("v") - a * F.coalesce(before, F.lit(0.0))).alias("v"))


def merge_spans(spans: DataFrame, key: str | list[str], gap: Column | int) -> DataFrame:
    """Gaps and islands: spans (a, b) that start within ``gap`` of the running end join."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("_new", F.when(reach.isNull() | (F.col("a") - reach > gap), 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(order))
    return d.groupBy(*keys, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def detect_segments(rms: DataFrame, key: list[str], length: int, hop: int, threshold_db: Column, gap: Column, pad: Column, least: int) -> DataFrame:
    """(key, start, end) of runs of active frames, padded, at least ``least`` samples.

    ``rms`` has key, frame, rms and total (samples of the clip); threshold_db, gap
    and pad are columns of it, so a grid of plans is one query.
    """
    peak = F.max("rms").over(Window.partitionBy(*key))
    active = rms.withColumn("_p", peak).filter((F.col("_p") > 1e-8) & (F.col("rms") >= F.col("_p") * db_to_amplitude(threshold_db)))
    order = Window.partitionBy(*key).orderBy("frame")
    end = F.lag(F.col("frame") * hop + length).over(order)
    d = active.withColumn("_new", F.when(end.isNull() | (F.col("frame") * hop - end > gap), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order)).withColumn("_pad", pad)
    g = d.groupBy(*key, "_island").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.first("total").alias("total"), F.first("_pad").alias("pad"))
    g = g.select(*key, F.greatest(F.col("f0") * hop - F.col("pad"), F.lit(0)).alias("start"), F.least(F.col("f1") * hop + length + F.col("pad"), F.col("total")).alias("end"))
    return g.filter(F.col("end") - F.col("start") >= least)


def score_segments(segments: DataFrame, df: DataFrame, key: str, sample_rate: int) -> DataFrame:
    """Segments with score = duration * mean absolute value of their samples.

    Running sums turn the range of samples into two equality joins.
    """
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.select(key, (F.col("n") + 1).alias("_at"), F.sum(F.abs("v")).over(order).alias("_s"))
    a = run.select(key, F.col("_at").alias("start"), F.col("_s").alias("_sa"))
    b = run.select(key, F.col("_at").alias("end"), F.col("_s").alias("_sb"))
    d = segments.join(b, [key, "end"], "left").join(a, [key, "start"], "left")
    return d.withColumn("score", (F.coalesce("_sb", F.lit(0.0)) - F.coalesce("_sa", F.lit(0.0))) / sample_rate).drop("_sa", "_sb")


#: The whole grids of the segment and split searches.
THRESHOLDS_DB = tuple(float(-x) for x in range(26, 39))
GAPS_S = (0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30)
PADS_S = (0.0, 0.05, 0.10, 0.15, 0.20)
SILENCES_MS = (60, 80, 100, 120, 140, 160, 180, 200, 220, 260, 300, 340, 380, 420)
DELTAS_DB = (-6.0, -8.0, -10.0, -12.0, -14.0, -16.0, -18.0, -20.0, -22.0, -24.0)


def segment_grid(spark: SparkSession, scale: float = 1.0) -> DataFrame:
    """All 13 x 7 x 5 plans (threshold_db, gap_s, pad_s); ``scale`` fits thresholds to clips of another range of levels."""
    each = lambda values: F.explode(F.array(*[F.lit(x) for x in values]))
    return spark.range(1).select(each([x * scale for x in THRESHOLDS_DB]).alias("threshold_db")).withColumn("gap_s", each(GAPS_S)).withColumn("pad_s", each(PADS_S))


def plan_segments(df: DataFrame, key: str, grid: DataFrame | None, length: int, hop: int, sample_rate: int, target: int, prefer: tuple[float, float] = (-32.0, 0.12)) -> DataFrame:
    """The best plan of each clip: its grid row and number of segments.

    ``grid`` has threshold_db, gap_s and pad_s (a few hundred rows, broadcast);
    None is the whole ``segment_grid``.
    Frame levels are computed once; plans are compared by a struct in the order:
    long segments, short segments, too few, distance to the target, longest,
    distance to the preferred threshold and gap, padding.
    """
    grid = segment_grid(df.sparkSession) if grid is None else grid
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    peak = F.max("rms").over(Window.partitionBy(key))
    rms = frame_rms(df, key, length, hop).withColumn("_p", peak).filter("_p > 1e-8").crossJoin(F.broadcast(grid.select("threshold_db").distinct()))
    # Active frames by threshold, islands by threshold and gap, padding on the islands alone: rows are multiplied as late as can be.
    active = rms.filter(F.col("rms") >= F.col("_p") * db_to_amplitude(F.col("threshold_db")))
    apart = F.col("frame") * hop - F.lag(F.col("frame") * hop + length).over(Window.partitionBy(key, "threshold_db").orderBy("frame"))
    active = active.select(key, "threshold_db", "frame", apart.alias("_apart")).join(F.broadcast(grid.select("threshold_db", "gap_s").distinct()), "threshold_db")
    new = F.when(F.col("_apart").isNull() | (F.col("_apart") > F.round(F.col("gap_s") * sample_rate)), 1).otherwise(0)
    active = active.withColumn("_island", F.sum(new).over(Window.partitionBy(key, "threshold_db", "gap_s").orderBy("frame")))
    island = active.groupBy(key, "threshold_db", "gap_s", "_island").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1")).join(total, key).join(F.broadcast(grid), ["threshold_db", "gap_s"])
    keys, pad = [key, "threshold_db", "gap_s", "pad_s"], F.round(F.col("pad_s") * sample_rate)
    seg = island.select(*keys, F.greatest(F.col("f0") * hop - pad, F.lit(0)).alias("start"), F.least(F.col("f1") * hop + length + pad, F.col("total")).alias("end"))
    seg = seg.filter(F.col("end") - F.col("start") >= round(0.35 * sample_rate))
    dur = (F.col("end") - F.col("start")) / sample_rate
    g = seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((dur > 2.5).cast("int")).alias("long"), F.sum((dur < 0.6).cast("int")).alias("short"), F.max(dur).alias("longest"))
    rank = F.struct("long", "short", F.when(F.col("n") >= target, 0).otherwise(1), F.abs(F.col("n") - target), "longest", F.abs(F.col("threshold_db") - prefer[0]), F.abs(F.col("gap_s") - prefer[1]), "pad_s", "threshold_db", "gap_s")
    best = g.groupBy(key).agg(F.min_by(F.struct("threshold_db", "gap_s", "pad_s", "n", "longest"), rank).alias("p"))
    return best.select(key, "p.*")


def plan_splits(spans: DataFrame, key: list[str], target: int = 10, low: int = 9, high: int = 11) -> DataFrame:
    """Score of each candidate split (less is better) from its spans in ms: count, short, long and spread penalties."""
    d = F.col("b") - F.col("a")
    g = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(240 - d, F.lit(0))).alias("short"), F.sum(F.greatest(d - 2200, F.lit(0))).alias("long"), F.min(d).alias("least"), F.max(d).alias("most"))
    penalty = F.when(F.col("n").between(low, high), 0).otherwise(10_000 + F.abs(F.col("n") - target) * 2_000)
    return g.withColumn("score", (penalty + F.col("short") * 6 + F.col("long") * 2 + F.col("most") - F.col("least")).cast("double"))


def split_spans(df: DataFrame, key: str, sample_rate: int, scale: float = 1.0, step_ms: int = 5, least_ms: int = 220, gap_ms: int = 55) -> DataFrame:
    """(key, min_silence_ms, delta_db, a, b): spans in ms of all 14 x 10 silence settings.

    A window of min_silence_ms whose rms is at most the clip's rms plus delta_db is
    silent. What lies between silences and lasts ``least_ms`` is a span; spans up
    to ``gap_ms`` apart join. ``scale`` fits delta_db to clips of another range of levels.
    """
    samples = lambda ms: max(1, round(ms * sample_rate / 1000))
    order, whole = Window.partitionBy(key).orderBy("n"), Window.partitionBy(key)
    v2 = F.col("v") * F.col("v")
    d = df.withColumn("_s", F.sum(v2).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_total", F.count(F.lit(1)).over(whole)).withColumn("_rms", F.sqrt(F.avg(v2).over(whole)))
    before = F.coalesce(F.lag("_s").over(order), F.lit(0.0))
    windows = F.array(*[F.struct(F.lit(ms).alias("min_silence_ms"), F.lit(samples(ms)).alias("_m"), (F.lead("_s", samples(ms) - 1).over(order) - before).alias("_w")) for ms in SILENCES_MS])
    d = d.select(key, "n", "_total", "_rms", windows.alias("_x")).withColumn("_x", F.explode("_x")).select(key, "n", "_total", "_rms", "_x.*")
    d = d.filter(F.col("_w").isNotNull() & ((F.col("n") % samples(step_ms) == 0) | (F.col("n") == F.col("_total") - F.col("_m"))))
    d = d.withColumn("delta_db", F.explode(F.array(*[F.lit(x * scale) for x in DELTAS_DB])))
    silent = d.filter(F.sqrt(F.greatest(F.col("_w"), F.lit(0.0)) / F.col("_m")) <= F.col("_rms") * db_to_amplitude(F.col("delta_db")))
    keys = [key, "min_silence_ms", "delta_db"]
    quiet = merge_spans(silent.select(*keys, F.col("n").cast("long").alias("a"), (F.col("n") + F.col("_m")).cast("long").alias("b")), keys, max(0, samples(step_ms) - samples(SILENCES_MS[0])))
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    end = total.withColumn("min_silence_ms", F.explode(F.array(*[F.lit(x) for x in SILENCES_MS]))).withColumn("delta_db", F.explode(F.array(*[F.lit(x * scale) for x in DELTAS_DB])))
    quiet = quiet.unionByName(end.select(*keys, "a", F.col("a").alias("b")))
    last = F.coalesce(F.lag("b").over(Window.partitionBy(*keys).orderBy("a", "b")), F.lit(0))
    ms = lambda c: c * 1000.0 / sample_rate
    spans = quiet.select(*keys, ms(last).alias("_a"), ms(F.col("a")).alias("_b")).select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b"))
    return merge_spans(spans.filter(F.col("b") - F.col("a") >= least_ms), keys, gap_ms)


def best_splits(df: DataFrame, key: str, sample_rate: int, scale: float = 1.0, target: int = 10, low: int = 9, high: int = 11) -> DataFrame:
    """The best of all silence settings for each clip: (key, min_silence_ms, delta_db, n, score); no row for clips without spans."""
    p = plan_splits(split_spans(df, key, sample_rate, scale), [key, "min_silence_ms", "delta_db"], target, low, high)
    rank = F.struct("score", F.abs(F.col("n") - target), F.col("most") - F.col("least"), "min_silence_ms", -F.col("delta_db"))
    return p.groupBy(key).agg(F.min_by(F.struct("min_silence_ms", "delta_db", "n", "score"), rank).alias("p")).select(key, "p.*")


def top_segments(segments: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` segments of highest score of each clip, in time order."""
    best = segments.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "start"))).filter(F.col("_r") <= n).drop("_r")
    return best.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("start")))


def split_longest(segments: DataFrame, df: DataFrame, key: str, sample_rate: int, target: int) -> DataFrame:
    """One round of bisection: in each clip with fewer than ``target`` segments the longest is cut.

    It is cut at its quietest sample within 0.15 s of the middle if both halves
    have 0.45 s, else in the middle; segments under 0.8 s stay whole.
    """
    half, window = round(0.45 * sample_rate), max(1, round(0.15 * sample_rate))
    w = Window.partitionBy(key)
    size = F.col("end") - F.col("start")
    d = segments.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(size), "start")))
    pick = (F.col("_n") < target) & (F.col("_r") == 1) & (size >= round(0.8 * sample_rate)) & (size >= 2 * half)
    mid = F.floor(size / 2)
    chosen = d.filter(pick).select(key, "start", "end", mid.alias("_mid"), (F.col("start") + F.greatest(mid - window, F.lit(1))).alias("_l"), (F.col("start") + F.least(mid + window, size - 1)).alias("_h"))
    near = chosen.join(df, key).filter((F.col("n") >= F.col("_l")) & (F.col("n") < F.col("_h")))
    cut = near.groupBy(key, "start", "end", "_mid").agg(F.min(F.struct(F.abs("v").alias("x"), "n")).alias("q"))
    at = F.col("q.n") - F.col("start")
    cut = cut.withColumn("_cut", F.col("start") + F.when((at < half) | (F.col("end") - F.col("q.n") < half), F.col("_mid")).otherwise(at))
    cut = cut.select(key, "start", "end", "_cut")
    j = segments.select(key, "start", "end").join(cut, [key, "start", "end"], "left")
    pieces = F.when(F.col("_cut").isNull(), F.array(F.struct("start", "end"))).otherwise(F.array(F.struct(F.col("start"), F.col("_cut").alias("end")), F.struct(F.col("_cut").alias("start"), F.col("end"))))
    return j.select(key, F.explode(pieces).alias("s")).select(key, "s.start", "s.end")


def fit_segment_count(segments: DataFrame, df: DataFrame, key: str, sample_rate: int, target: int) -> DataFrame:
    """Segments of each clip cut until there are ``target`` of them or none can be cut: at most target - 1 rounds.

    Each round is checkpointed, so lineage stays short.
    """
    now, count = segments.select(key, "start", "end"), -1
    for _ in range(target):
        found = now.count()
        if found == count:
            break
        count, now = found, cut(split_longest(now, df, key, sample_rate, target))
    return now


def segment_recordings(df: DataFrame, key: str, grid: DataFrame, length: int, hop: int, sample_rate: int, target: int, prefer: tuple[float, float] = (-32.0, 0.12), least: int = 1, shortest: int | None = None) -> DataFrame:
    """Long recordings (key, n, v) to ``target`` segments each, with their scores.

    The best plan of ``grid`` gives a recording its threshold, gap and padding; its segments (of ``least`` samples or more) are cut at
    their quietest places or merged and dropped until they are ``target``, scored, and the best are kept in their order.
    ``shortest`` is the sample rate that the least length of a cut follows, the recording's own by default.
    """
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    plan = plan_segments(df, key, grid, length, hop, sample_rate, target, prefer).select(key, "threshold_db", "gap_s", "pad_s")
    rms = frame_rms(df, key, length, hop).join(total, key).join(plan, key)
    samples = lambda c: F.round(F.col(c) * sample_rate)
    found = detect_segments(rms, [key], length, hop, F.col("threshold_db"), samples("gap_s"), samples("pad_s"), least)
    found = found.select(key, F.col("start").cast("long"), F.col("end").cast("long"))
    fitted = fit_segment_count(found, df, key, sample_rate if shortest is None else shortest, target)
    return top_segments(score_segments(fitted, df, key, sample_rate), key, target)


def focus(df: DataFrame, key: str, half: int, length: int, hop: int, threshold_db: float, floor_db: float = -45.0, eps: float = 1e-8) -> DataFrame:
    """A window of 2 * half samples around the energy-weighted centre; zeros outside, clips no longer than it unchanged."""
    w = Window.partitionBy(key)
    d = df.withColumn("_total", F.count(F.lit(1)).over(w)).withColumn("_rms", F.sqrt(F.avg(F.col("v") * F.col("v")).over(w)))
    whole = d.groupBy(key).agg(F.first("_total").alias("total"), F.first("_rms").alias("level"))
    r = frame_rms(df, key, length, hop).join(whole, key)
    weight = F.greatest(F.col("rms") - F.greatest(F.col("level") * db_to_amplitude(threshold_db), db_to_amplitude(floor_db)), F.lit(0.0))
    centre = F.when(F.sum(weight) > 0, F.rint(F.sum((F.col("frame") * hop + length // 2) * weight) / F.greatest(F.sum(weight), F.lit(eps)))).otherwise(F.floor(F.first("total") / 2))
    c = r.groupBy(key).agg(centre.cast("long").alias("centre"), F.first("total").alias("total"))
    long = c.filter(F.col("total") > 2 * half).select(key, (F.col("centre") - half).alias("_a"))
    grid = long.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))))
    cut = grid.withColumn("n", F.col("_a") + F.col("_i")).join(df, [key, "n"], "left").select(key, F.col("_i").cast("long").alias("n"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return cut.unionByName(df.join(long.select(key), key, "left_anti").select(key, F.col("n").cast("long").alias("n"), "v"))


def ema_baseline(df: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """(key, n, v, ema): the exponential moving average of v, see ``ema_columns``."""
    return ema_columns(df.select(key, "n", "v"), key, ("v",), alpha).withColumnRenamed("v_ema", "ema")


def ema_columns(df: DataFrame, key: str, columns: tuple[str, ...], alpha: float = 0.05) -> DataFrame:
    """Rows with <column>_ema: e = (1 - alpha) * e + alpha * v from the first sample (n = 0) on, for clips of any length.

    Inside a block, whose length keeps (1 - alpha)^-n below e^20, it is a running
    sum in closed form. A block starts from the decayed values at the ends of the
    75 blocks before it; what is older has weights below e^-1480, where doubles end.
    """
    q = 1 - alpha
    size = 1 if q <= 0 else 1 << 40 if q >= 1 else max(1, int(20 / -math.log(q)))
    power = lambda n: F.pow(F.lit(float(q)), n)
    d = df.withColumn("_b", F.floor(F.col("n") / size)).withColumn("_k", F.col("n") % size)
    inside = Window.partitionBy(key, "_b").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, c in enumerate(columns):
        x = F.col(c) * F.when(F.col("n") == 0, 1.0).otherwise(alpha)
        d = d.withColumn(f"_e{i}", x if size == 1 else power(F.col("_k")) * F.sum(x * power(-F.col("_k"))).over(inside))
    many = range(len(columns))
    last = d.groupBy(key, "_b").agg(F.max("_k").alias("_k"), *[F.max_by(f"_e{i}", "_k").alias(f"_l{i}") for i in many])
    last = last.select(key, "_b", *[(F.col(f"_l{i}") * power(size - 1 - F.col("_k"))).alias(f"_l{i}") for i in many])
    last = last.withColumn("_before", F.collect_list(F.struct("_b", *[f"_l{i}" for i in many])).over(Window.partitionBy(key).orderBy("_b").rangeBetween(-75, -1)))
    carry = lambda i: F.aggregate("_before", F.lit(0.0), lambda s, x: s + x[f"_l{i}"] * power((F.col("_b") - x["_b"] - 1) * size))
    last = last.select(key, "_b", *[carry(i).alias(f"_c{i}") for i in many])
    ema = [(F.col(f"_e{i}") + power(F.col("_k") + 1) * F.col(f"_c{i}")).alias(f"{c}_ema") for i, c in enumerate(columns)]
    return d.join(last, [key, "_b"]).select(*df.columns, *ema)


def roll(df: DataFrame, frame: str, shift: int, total: int) -> DataFrame:
    return df.withColumn(frame, F.pmod(F.col(frame) + shift, F.lit(total)))


def decimate(df: DataFrame, key: str, most: int = 1200) -> DataFrame:
    """At most ``most`` samples of each clip, at int(linspace(0, N - 1, most))."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    grid = total.filter(F.col("total") > most).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    grid = grid.select(key, F.floor(F.col("i") * ((F.col("total") - 1) / F.lit(float(most - 1))) + 1e-9).alias("n"))
    small = df.join(total.filter(F.col("total") <= most).select(key), key, "left_semi")
    return df.join(grid.distinct(), [key, "n"]).select(key, "n", "v").unionByName(small.select(key, "n", "v"))


def echo(df: DataFrame, key: str, delays: list[tuple[int, float]]) -> DataFrame:
    """A clip with delayed, scaled copies added; it grows by the longest delay."""
    copies = F.array(F.struct(F.lit(0).alias("d"), F.lit(1.0).alias("g")), *[F.struct(F.lit(d).alias("d"), F.lit(float(g)).alias("g")) for d, g in delays])
    return df.withColumn("c", F.explode(copies)).groupBy(key, (F.col("n") + F.col("c.d")).alias("n")).agg(F.sum(F.col("v") * F.col("c.g")).alias("v"))


def distort(v: Column, drive: float) -> Column:
    return F.tanh(v * drive)


def fade(df: DataFrame, key: str, samples: int) -> DataFrame:
    """Linear fade over the first and last ``samples`` samples."""
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    gain = F.least(F.lit(1.0), F.col("n") / samples, (total - 1 - F.col("n")) / samples)
    return df.withColumn("v", F.col("v") * gain)
