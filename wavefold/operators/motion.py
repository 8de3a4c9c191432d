"""Motion segmentation with two thresholds (hysteresis), as window expressions over a device's samples.

The energy of a sample is the gyroscope norm plus a share of the norm of what the
accelerometer departs from its moving average. The first second of a device gives
its two thresholds. A segment opens where several samples in a row are above the
upper one and closes where several in a row are below the lower one, or at the
longest length; it begins a pre-roll before the sample that opens it.

A device is cut into blocks of samples, so that one with most of the rows is spread over all tasks. The moving average is
an affine map and open or closed a small automaton: each block is summed up by its own end (decayed values, the
last event, the number of stretches that begin), the ends are composed over the blocks of a device, and the
blocks are then read again by themselves. A few samples before a block come with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.operators.lineage import cut, follow, numbered
from wavefold.operators.signal import ema_columns


@dataclass(frozen=True)
class MotionConfig:
    rate: int = 50
    alpha: float = 0.05
    beta: float = 0.5
    #: Samples in a row that open and close a segment.
    start_count: int = 3
    end_count: int = 8
    #: Seconds that give the thresholds, and how many deviations they lie above the mean.
    calibrate_s: float = 1.0
    start_z: float = 3.0
    end_z: float = 1.5
    most_s: float = 2.0
    least_s: float = 0.25
    pre_roll_s: float = 0.15
    #: Samples of a block.
    block: int = 4096

    @property
    def calibration(self) -> int:
        return max(1, round(self.calibrate_s * self.rate))

    @property
    def most(self) -> int:
        return round(self.most_s * self.rate)

    @property
    def least(self) -> int:
        return max(2, round(self.least_s * self.rate))

    @property
    def pre_roll(self) -> int:
        return int(self.pre_roll_s * self.rate)


def _norm(*columns: Column) -> Column:
    return F.sqrt(sum(c * c for c in columns))


def motion_energy(df: DataFrame, cfg: MotionConfig) -> DataFrame:
    """device, n (from 0 in order of seq), e of rows (device, seq, gx .. az)."""
    d = numbered(df.select("device", "seq", "gx", "gy", "gz", "ax", "ay", "az"), F.col("device"), F.col("seq"), name="_at")
    first = d.groupBy("device").agg(F.min("_at").alias("_first"))
    d = d.join(first, "device").select("device", (F.col("_at") - F.col("_first")).alias("n"), "gx", "gy", "gz", "ax", "ay", "az")
    d = ema_columns(d, "device", ("ax", "ay", "az"), cfg.alpha)
    moved = _norm(*[F.col(a) - F.col(f"{a}_ema") for a in ("ax", "ay", "az")])
    return d.select("device", "n", (_norm(F.col("gx"), F.col("gy"), F.col("gz")) + cfg.beta * moved).alias("e"))


def _events(df: DataFrame, cfg: MotionConfig) -> DataFrame:
    """device, block, n, last (of the device), opens and closes of the samples behind the calibration."""
    halo = max(cfg.start_count, cfg.end_count) - 1
    d = motion_energy(df, cfg)
    calm = d.filter(F.col("n") < cfg.calibration).groupBy("device").agg(F.avg("e").alias("_mean"), (F.stddev_pop("e") + 1e-6).alias("_sd"))
    ends = d.groupBy("device").agg(F.max("n").alias("last")).join(calm, "device")
    high, low = F.col("_mean") + cfg.start_z * F.col("_sd"), F.col("_mean") + cfg.end_z * F.col("_sd")
    blocks = ends.select("device", "last", high.alias("high"), low.alias("low"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / cfg.block))).alias("block"))
    # The samples before a block go with it.
    d = d.filter(F.col("n") >= cfg.calibration)
    own, later = F.floor(F.col("n") / cfg.block), F.floor((F.col("n") + halo) / cfg.block)
    d = d.withColumn("block", F.explode(F.sequence(own, later))).join(blocks, ["device", "block"])
    order = Window.partitionBy("device", "block").orderBy("n")

    def in_a_row(what: Column, count: int) -> Column:
        return (F.col("n") >= cfg.calibration + count - 1) & (F.min(what.cast("int")).over(order.rowsBetween(1 - count, 0)) == 1)

    d = d.withColumn("opens", in_a_row(F.col("e") > F.col("high"), cfg.start_count)).withColumn("closes", in_a_row(F.col("e") < F.col("low"), cfg.end_count))
    return d.filter(F.col("block") == own).select("device", "block", "n", "last", "opens", "closes")


def _before_blocks(ends: DataFrame, value: Column, name: str) -> DataFrame:
    """device, block and what the ends of the device's blocks before it come to."""
    over = Window.partitionBy("device").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    return ends.select("device", "block", value.over(over).alias(name))


def segment_motion(df: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """(device, first, samples) of the segments of each device's samples in order of seq.

    A device with fewer samples than the calibration takes has none; a segment
    that the data end in has no end and is not reported.
    """
    d, order = cut(_events(df, cfg)), Window.partitionBy("device", "block").orderBy("n")
    # A stretch begins where a sample opens and the last sample that could do either closed; it ends at the next that closes.
    state = F.when(F.col("opens"), 1).when(F.col("closes"), 0)
    ends = d.withColumn("s", state).filter("s is not null").groupBy("device", "block").agg(F.max_by("s", "n").alias("s"))
    ends = d.select("device", "block").distinct().join(ends, ["device", "block"], "left")
    d = d.join(_before_blocks(ends, F.last("s", ignorenulls=True), "came"), ["device", "block"])
    before = F.coalesce(F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("came"), F.lit(0))
    d = d.withColumn("begins", F.col("opens") & (before == 0))
    ends = d.groupBy("device", "block").agg(F.sum(F.col("begins").cast("int")).alias("s"))
    d = d.join(_before_blocks(ends, F.sum("s"), "begun"), ["device", "block"])
    d = d.withColumn("stretch", F.coalesce("begun", F.lit(0)) + F.sum(F.col("begins").cast("int")).over(order)).filter("stretch > 0")
    close = d.groupBy("device", "stretch").agg(F.min(F.when(F.col("begins"), F.col("n"))).alias("at"), F.min(F.when(F.col("closes"), F.col("n"))).alias("close"), F.max("last").alias("last"))
    pre = F.least(F.col("at") + 1, F.lit(cfg.pre_roll))
    full = F.col("at") + cfg.most - pre
    ends = F.least(full, F.col("close"))  # least() passes over nulls
    found = close.withColumn("end", ends)
    longer = found.filter("end <= last and (close is null or close > end)")
    if not longer.isEmpty():
        found = found.unionByName(_later_pieces(d, longer, cfg))
    length = pre + F.col("end") - F.col("at")
    good = (F.col("end") <= F.col("last")) & ((length >= cfg.most) | (length >= cfg.least))
    return found.filter(good).select(F.col("device").cast("string").alias("device"), (F.col("at") - pre + 1).alias("first"), length.alias("samples"))


def _later_pieces(d: DataFrame, longer: DataFrame, cfg: MotionConfig) -> DataFrame:
    """Segments behind the first one of stretches that the longest length cuts.

    Each sample that opens knows the sample that would open the next segment, so
    the segments of a stretch are a chain.
    """
    s = d.select("device", "stretch", "block", "n", "opens").join(longer.select("device", "stretch", "at", "close", "last"), ["device", "stretch"])
    # The next sample that opens: inside of the block, or else the first of the stretch's blocks behind it.
    of = ["device", "stretch", "block"]
    forward = Window.partitionBy(*of).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = s.groupBy(*of).agg(F.min(F.when(F.col("opens"), F.col("n"))).alias("next"))
    behind = Window.partitionBy("device", "stretch").orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # one row a block
    firsts = firsts.select(*of, F.first("next", ignorenulls=True).over(behind).alias("later"))
    s = s.withColumn("next", F.last(F.when(F.col("opens"), F.col("n")), ignorenulls=True).over(forward)).join(firsts, of)
    s = s.withColumn("next", F.coalesce("next", "later"))
    pre = F.least(F.col("n") + 1, F.lit(cfg.pre_roll))
    nodes = s.filter("opens and n >= at").select("device", "stretch", F.col("n").alias("at"), "close", "last", F.least(F.col("n") + cfg.most - pre, F.col("close")).alias("end"))
    following = s.select("device", "stretch", (F.col("n") - cfg.start_count).alias("end"), F.col("next").alias("to"))
    nodes = cut(nodes.join(following, ["device", "stretch", "end"], "left"))
    reached = follow(nodes, longer, ["device", "stretch"])
    later = reached.join(longer.select("device", "stretch", "at"), ["device", "stretch", "at"], "left_anti")
    return nodes.join(later, ["device", "stretch", "at"]).select("device", "stretch", "at", "close", "last", "end")
