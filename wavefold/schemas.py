"""Fixed column lists of the tables that recordings pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame

AXES = ("gyro_x", "gyro_y", "gyro_z", "acc_x", "acc_y", "acc_z")
SAMPLE_COLUMNS = ("measurement_id", "sequence_id", "label_id", "label", *AXES)
SAMPLE_SCHEMA = "measurement_id long, sequence_id int, label_id int, label string, " + ", ".join(f"{a} double" for a in AXES)
#: Motion labels in id order (fixed values).
LABELS = ("Raise", "Shake", "Chop", "Stir", "Swing", "Punch")


def require_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``df`` itself, or a ValueError that names the columns it lacks (driver side, no job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
