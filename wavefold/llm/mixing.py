"""Mixing sources to target weights by capped water-filling (operator 2, native expressions only).

Targets share the corpus size by weight; a source stops at ``max_epochs`` times
its own size and its excess is shared again by weight until no source is above.
That fixed point is target = min(cap, level * weight): sources are ordered by
cap / weight, and the level is found from running sums over the (few) sources.

A source whose target is r times its size repeats every document floor(r) times
and gives one more repetition to a seeded share of frac(r) of its words: the
documents are ordered by a hash of seed, doc_id and text and taken while the words
before them are below the share, so the taken words miss the target by less
than one document. Rows that agree in doc_id and text are counted together, and
where the share ends among them an even part of them is taken, by their place in
their partitions. The running sums have two levels (hash bucket, then inside a
bucket), so a hot source or doc_id is spread over all buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.llm.shared import fresh, light


@dataclass(frozen=True)
class MixConfig:
    #: Weight of the sources in code point order (null last), repeated as often as needed.
    weights: tuple[float, ...] = (1, 2, 3)
    max_epochs: int = 3
    seed: int = 42
    #: Hex digits of the hash that name a bucket: 16 ** digits buckets a source.
    bucket_digits: int = 3
    #: Sources up to which their plan is broadcast; beyond, the join is a shuffle.
    light_sources: int = 10_000
    word: str = field(default=r"[^\x20\x09-\x0D]+")


def count_words(text: Column, cfg: MixConfig = MixConfig()) -> Column:
    """Number of words of a text; null has none. Words shrink to one letter, so no list is built."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), cfg.word, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """source, source_size, target from rows (source, source_size), one a source.

    Windows without a partition run over sources only, never over documents.
    """
    n = len(cfg.weights)
    weights = F.array(*[F.lit(float(w)) for w in cfg.weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(weights, (rank % n + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(cfg.max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # The level if all sources before this one are capped and this and all later ones are not.
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(past), F.lit(0))) / F.sum("weight").over(rest))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )["level"]
    s = s.withColumn("at", level)
    capped = F.col("at").isNull() | (F.col("at") * F.col("weight") >= F.col("cap"))
    return s.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def _key(cfg: MixConfig) -> Column:
    return F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def sized(documents: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, source, size and key (the hash that orders documents)."""
    return documents.select("doc_id", "source", count_words(F.col("text"), cfg).alias("size"), _key(cfg).alias("key"))


def source_plan(sizes: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """What each source repeats: source, source_size, target, whole, cut, cut_rows and cut_of.

    ``sizes`` is ``sized(documents)``. All documents of a source repeat ``whole``
    times, those whose key is below ``cut`` once more, and of the ``cut_of`` rows
    whose key is the cut itself ``cut_rows``.
    """
    d = sizes.groupBy("source", F.left("key", F.lit(cfg.bucket_digits)).alias("bucket"), "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    words = F.col("size") * F.col("rows")
    buckets = d.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cfg)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("share", F.col("target") - F.col("whole") * F.col("source_size"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)))
    t = targets.select(F.col("source").alias("s"), "share")
    starts = starts.join(t, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("bucket").alias("b"), "bucket_start", "share")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # Rows of a key that begin below the share, by half a word so that no rounding counts.
    left = F.col("share") - 0.5 - F.col("bucket_start") - F.col("before")
    taken = F.when(left <= 0, 0).when(F.col("size") == 0, F.col("rows")).otherwise(F.least(F.ceil(left / F.greatest("size", F.lit(1))), F.col("rows")))
    cut = d.filter(left > 0).groupBy("source").agg(F.max(F.struct("key", taken.alias("taken"), "rows")).alias("m"))
    cut = cut.select(F.col("source").alias("s"), F.col("m.key").alias("cut"), F.col("m.taken").alias("cut_rows"), F.col("m.rows").alias("cut_of"))
    return targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", "cut_rows", "cut_of")


def _planned(rows: DataFrame, plan: DataFrame, key: Column, own: str, cfg: MixConfig) -> DataFrame:
    """rows with the columns of their source's plan (named ``own`` and their name) and their repetitions.

    The plan has one row a source; up to ``cfg.light_sources`` it is broadcast, so texts are not moved.
    """
    p = light(plan.select(*[F.col(c).alias(own + c) for c in plan.columns]), cfg.light_sources)
    # Multiples of the golden ratio fall evenly on the unit interval, whichever rows in a row they number.
    at = F.monotonically_increasing_id()
    even = (at.bitwiseAND(F.lit((1 << 33) - 1)) * 0.6180339887498949 + F.shiftright(at, 33) * 0.7548776662466927) % 1.0
    among = (F.col(own + "cut_rows") == F.col(own + "cut_of")) | (even < F.col(own + "cut_rows") / F.col(own + "cut_of"))
    extra = F.coalesce((key < F.col(own + "cut")) | (key == F.col(own + "cut")) & among, F.lit(False)).cast("long")
    out = rows.join(p, F.col("source").eqNullSafe(F.col(own + "source")))
    return out.withColumn(own + "repetitions", F.least(F.col(own + "whole") + extra, F.lit(cfg.max_epochs).cast("long")))


def mix(sizes: DataFrame, plan: DataFrame | None = None, cfg: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, source, size, source_size, target, repetitions and taken of every row of ``sized``.

    ``plan`` is ``source_plan(sizes)``, where it was written before.

    Null text has size 0; null is a source of its own, last in order. Documents
    of size 0 take part with 0 words. Rows that repeat a doc_id are told apart by
    their texts, and by their place where these agree too. An empty table gives no
    rows. Sums are whole numbers, so a rerun gives the same rows.
    """
    out = _planned(sizes.select("doc_id", "source", "size", "key"), source_plan(sizes, cfg) if plan is None else plan, F.col("key"), "_plan_", cfg)
    n = F.col("_plan_repetitions")
    return out.select(
        "doc_id", "source", "size", F.col("_plan_source_size").alias("source_size"), F.col("_plan_target").alias("target"),
        n.alias("repetitions"), (F.col("size") * n).alias("taken"),
    )


def mixed_documents(documents: DataFrame, plan: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``documents``, each as often as the mix repeats it.

    ``plan`` is ``source_plan(sized(documents))``, best written once.
    """
    own = fresh(documents.columns, "plan_")
    out = _planned(documents, plan, _key(cfg), own, cfg).filter(F.col(own + "repetitions") > 0)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(own + "repetitions")))
    return out.select(*documents.columns, each.alias(own + "n")).drop(own + "n")
