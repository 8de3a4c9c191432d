"""Review loop: misclassified clips, decisions, deletions, pages, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def misclassified(predictions: DataFrame, root: str) -> DataFrame:
    """Rows not marked correct whose path is not blank and inside ``root``."""
    path = F.regexp_replace("path", r"/(\./|/)+", "/")
    wrong = ~F.lower(F.trim(F.coalesce("is_correct", F.lit("")))).isin("1", "true", "yes")
    inside = path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")
    return predictions.filter(wrong & (F.trim("path") != "") & inside)


def apply_reviews(predictions: DataFrame, reviews: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions with status and final label, rejected reviews).

    Per sample the first valid review counts: a wrong prediction needs a
    correct_label that is a known label. ``labels`` is the label dimension.
    """
    known = labels.select(F.col("label").alias("_known")).distinct()
    r = reviews.join(known, F.col("correct_label") == F.col("_known"), "left")
    valid = F.col("is_correct") | F.col("_known").isNotNull()
    first = r.filter(valid).withColumn("_r", F.row_number().over(Window.partitionBy("sample_id").orderBy("reviewed_at"))).filter("_r = 1")
    first = first.select("sample_id", F.col("is_correct").alias("review_correct"), "correct_label")
    out = predictions.join(first, "sample_id", "left")
    status = F.when(F.col("review_correct").isNull(), "pending").when(F.col("review_correct"), "correct").otherwise("corrected")
    final = F.when(F.col("review_correct") == F.lit(False), F.col("correct_label")).otherwise(F.col("predicted_label"))
    return out.withColumn("status", status).withColumn("final_label", final).drop("review_correct", "correct_label"), r.filter(~valid).drop("_known")


def delete_clips(predictions: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions without the deleted paths, log of the rows deleted)."""
    gone = deletions.select("path").distinct()
    return predictions.join(gone, "path", "left_anti"), predictions.join(gone, "path", "left_semi")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows of one page (offset at least 0, limit within 1..200) with the total count."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(order).offset(max(0, offset)).limit(min(200, max(1, limit))).crossJoin(F.broadcast(total))


def latest_state(df: DataFrame, kind: str, ts: str) -> DataFrame:
    """Last record of each kind."""
    rest = [c for c in df.columns if c != kind]
    return df.groupBy(kind).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(kind, "r.*")
