"""Cleaning of sample windows: length bands, idle trimming, audits, baselines, numbering.

All windows are partitioned by the measurement key, so one exchange on it serves
the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.operators.lineage import numbered
from wavefold.schemas import AXES

#: Reasons of the audit in order of precedence.
REASONS = ("mixed_label", "bad_seq", "too_short", "too_long_raw", "trim_too_short", "trim_too_long")


def norm_label(col: Column, strip_prefix: bool = True) -> Column:
    """Lower-case token with underscores; ``strip_prefix`` drops a leading number."""
    c = F.translate(F.lower(F.trim(col)), " -", "__")
    return F.regexp_replace(c, r"^\d+_?", "") if strip_prefix else c


def map_labels(df: DataFrame, aliases: DataFrame, map_name: str, token: str = "token") -> DataFrame:
    """Rows with their canonical label by an alias table (map_name, alias, canonical); unknown tokens are dropped."""
    a = aliases.filter(F.col("map_name") == map_name).select(F.col("alias").alias(token), "canonical")
    return df.join(a, token)


def length_band(df: DataFrame, key: str, low: int, high: int | None = None) -> DataFrame:
    """Windows whose number of samples lies in low..high."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    d = df.withColumn("_n", n)
    d = d.filter(F.col("_n") >= low) if high is None else d.filter(F.col("_n").between(low, high))
    return d.drop("_n")


def gyro_magnitude() -> Column:
    return F.sqrt(F.col("gyro_x") * F.col("gyro_x") + F.col("gyro_y") * F.col("gyro_y") + F.col("gyro_z") * F.col("gyro_z"))


def trim_idle(df: DataFrame, key: str = "measurement_id", seq: str = "sequence_id", threshold: float = 5.0, magnitude: Column | None = None) -> DataFrame:
    """Samples from the first to the last active one; a window without activity stays whole."""
    w = Window.partitionBy(key)
    active = F.when((magnitude if magnitude is not None else gyro_magnitude()) >= threshold, F.col(seq))
    d = df.withColumn("_a", F.min(active).over(w)).withColumn("_b", F.max(active).over(w))
    return d.filter(F.col("_a").isNull() | F.col(seq).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def drop_reasons(df: DataFrame, key: str = "measurement_id", raw: tuple[int, int] = (10, 300), trimmed: tuple[int, int] = (40, 300), threshold: float = 5.0) -> DataFrame:
    """measurement and its first failing rule (null: valid), by one aggregation on the key."""
    seq = F.col("sequence_id")
    active = F.when(gyro_magnitude() >= threshold, seq)
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"), F.count("sequence_id").alias("seqs"), F.countDistinct("sequence_id").alias("different"),
        F.min(active).alias("a"), F.max(active).alias("b"),
    )
    kept = F.when(F.col("a").isNull(), F.col("n")).otherwise(F.col("b") - F.col("a") + 1)
    reason = (
        F.when(F.col("labels") != 1, REASONS[0]).when((F.col("seqs") != F.col("n")) | (F.col("different") != F.col("n")), REASONS[1])
        .when(F.col("n") < raw[0], REASONS[2]).when(F.col("n") > raw[1], REASONS[3]).when(kept < trimmed[0], REASONS[4]).when(kept > trimmed[1], REASONS[5])
    )
    return g.select(key, "n", reason.alias("reason"))


def drop_report(reasons: DataFrame) -> DataFrame:
    """Windows by reason, with 0 for reasons that never occurred."""
    all_reasons = reasons.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in REASONS])).alias("reason"))
    n = reasons.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return all_reasons.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n_windows"))


def strict_windows(df: DataFrame, key: str, seq: str, label: str, length: int, labels: tuple[str, ...]) -> DataFrame:
    """Keys of windows of exactly ``length`` rows, as many different sequence numbers, and one known label."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(seq).alias("d"), F.min(label).alias("l0"), F.max(label).alias("l1"))
    return g.filter((F.col("n") == length) & (F.col("d") == length) & (F.col("l0") == F.col("l1")) & F.col("l0").isin(*labels)).select(key, F.col("l0").alias("label"))


def remove_baseline(df: DataFrame, key: str = "measurement_id", seq: str = "sequence_id", channels: tuple[str, ...] = AXES, frames: int = 5) -> DataFrame:
    """Each channel less the mean of its first ``frames`` samples (by rank of seq)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    d, w = df.withColumn("_r", rank), Window.partitionBy(key)
    return d.select(*[c for c in df.columns if c not in channels], *[(F.col(c) - F.avg(F.when(F.col("_r") <= frames, F.col(c))).over(w)).alias(c) for c in channels])


def renumber(df: DataFrame, key: str = "measurement_id", seq: str = "sequence_id") -> DataFrame:
    """Sequence numbers from 0 in their order."""
    return df.withColumn(seq, (F.row_number().over(Window.partitionBy(key).orderBy(seq)) - 1).cast("int"))


def number_measurements(blocks: DataFrame, start: int = 0) -> DataFrame:
    """measurement_id of each (file, block) in order of files, then blocks.

    ``blocks`` has one row a sample. Blocks are counted by file first; the prefix
    sum runs over files only, never over samples.
    """
    per_file = blocks.select("file", "block").distinct()
    counts = per_file.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("file", before.alias("first"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("block")) - 1
    ids = per_file.withColumn("rank", rank).join(first, "file").select("file", "block", (F.col("first") + F.col("rank") + start).alias("measurement_id"))
    return blocks.join(ids, ["file", "block"])


def append_measurements(base: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` behind ``base`` with ids that continue at the largest one plus 1 (one broadcast row)."""
    return base.unionByName(_moved_behind(base, new))


def write_appended(new: DataFrame, path: str) -> None:
    """Appends ``new`` to the Parquet table of measurements at ``path``, with ids that continue behind those in it.

    Rows that are there are not written again. The append is one Spark write; two at a time would take the same ids.
    """
    spark = new.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = _moved_behind(spark.read.parquet(path), new).select(new.columns)
    new.write.mode("append").parquet(path)


def _moved_behind(base: DataFrame, new: DataFrame) -> DataFrame:
    top = base.agg((F.coalesce(F.max("measurement_id"), F.lit(-1)) + 1).alias("_next"))
    ids = numbered(new.select("measurement_id").distinct(), F.col("measurement_id"), name="_rank")
    return new.join(ids, "measurement_id").crossJoin(F.broadcast(top)).withColumn("measurement_id", F.col("_next") + F.col("_rank")).drop("_next", "_rank")


def import_actions(actions: DataFrame, rows: DataFrame, exclude: DataFrame | None = None, min_len: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows of actions long enough, skipped actions with their counts); one join instead of a query an action.

    ``actions`` has id, ``rows`` has action_id; ``exclude`` lists ids to leave out.
    """
    a = actions if exclude is None else actions.join(exclude, "id", "left_anti")
    j = a.join(rows, a["id"] == rows["action_id"], "left")
    counted = j.withColumn("_n", F.count("action_id").over(Window.partitionBy("id")))
    kept = counted.filter(F.col("_n") >= min_len).drop("_n")
    skipped = counted.filter(F.col("_n") < min_len).select("id", F.col("_n").alias("n")).distinct()
    return kept, skipped


def balanced_merge(new: DataFrame, old: DataFrame, new_count: int, old_count: int, label: str = "label", order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(first blocks of each label by quota, with their origin; labels that fall short)."""
    both = new.withColumn("origin", F.lit("new")).unionByName(old.withColumn("origin", F.lit("old")))
    quota = F.when(F.col("origin") == "new", new_count).otherwise(old_count)
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy(label, "origin").orderBy(order)))
    short = ranked.groupBy(label, "origin").agg(F.max("_r").alias("found")).withColumn("wanted", quota).filter("found < wanted")
    return ranked.filter(F.col("_r") <= quota).drop("_r"), short


def natural_key(col: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.lower(col), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))


def speaker_ids(manifest: DataFrame, clips_per_speaker: int = 5) -> DataFrame:
    """ordinal, speaker_local_id, speaker_id and utterance_id of each clip of a (source, label) folder.

    A clip in a nested folder takes the folder's cleaned name as its speaker.
    """
    w = Window.partitionBy("source", "label").orderBy(natural_key(F.col("path")), "path")
    d = manifest.withColumn("ordinal", F.row_number().over(w) - 1)
    folder = F.regexp_replace(F.coalesce("folder", F.lit("")), r"\([^)]*\)", "")
    folder = F.lower(F.trim(F.regexp_replace(F.trim(folder), "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    numbered = F.concat(F.lit("speaker_"), F.lpad((F.floor(F.col("ordinal") / clips_per_speaker) + 1).cast("string"), 3, "0"))
    local = F.when(F.col("folder").isNull(), numbered).when(folder == "", "speaker").otherwise(folder)
    d = d.withColumn("speaker_local_id", local).withColumn("speaker_id", F.concat("source", F.lit("_"), "speaker_local_id"))
    return d.withColumn("utterance_id", (F.col("ordinal") % clips_per_speaker + 1).cast("int"))


def next_index(names: DataFrame, pattern: str = r"_(\d+)\.[a-z]+$") -> DataFrame:
    """For each label the highest numeric suffix of its file names plus 1."""
    n = F.try_to_number(F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")), F.lit("999999999999")).cast("long")
    return names.groupBy("label").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_index"))


def valid_labels(df: DataFrame, label: str, order: str, n_classes: int, most: int | None = None) -> DataFrame:
    """Rows whose label is one of 0 .. n_classes - 1; with ``most`` the first ones in order."""
    d = df.filter(F.col(label).between(0, n_classes - 1))
    return d if most is None else d.orderBy(order).limit(most)


def newest_artefact(files: DataFrame, kind: str, path: str = "path", modified: str = "modified") -> DataFrame:
    """(kind, newest) path of the latest modification of each kind, ties to the greater path; repeated listings count once."""
    latest = files.filter(F.col(modified).isNotNull()).groupBy(kind, path).agg(F.max(modified).alias("_m"))
    return latest.groupBy(kind).agg(F.max_by(path, F.struct("_m", path)).alias("newest"))


def manifest_counts(df: DataFrame, source: str = "source", key: str = "measurement_id") -> DataFrame:
    """Measurements and rows by source and for all together (source 'combined')."""
    by = df.groupBy(source).agg(F.countDistinct(key).alias("measurements"), F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.countDistinct(key).alias("measurements"), F.count(F.lit(1)).alias("rows")).select(F.lit("combined").alias(source), "measurements", "rows")
    return by.unionByName(total)
