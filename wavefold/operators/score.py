"""Batch scoring of windows by a small convolutional network, training, sweeps and quantisation reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def network(params: DataFrame, limit: int = 1_000_000) -> dict[str, np.ndarray]:
    """Named arrays from rows (layer, shape, values); the parameter count is checked before they are sent to tasks."""
    n = params.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).collect()[0][0]
    if n > limit:
        raise ValueError(f"{n} parameters; at most {limit} are sent to tasks")
    return {r["layer"]: np.array(r["values"], float).reshape(r["shape"]) for r in params.collect()}


def forward(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of windows x (rows, channels, time): conv3, relu, pool2, conv3, relu, mean over time, linear."""
    for name in ("conv1", "conv2"):
        w, b = net[f"{name}.weight"], net[f"{name}.bias"]
        p = np.pad(x, ((0, 0), (0, 0), (1, 1)))
        x = np.maximum(sum(np.einsum("nct,oc->not", p[:, :, k : k + x.shape[2]], w[:, :, k]) for k in range(3)) + b[:, None], 0)
        if name == "conv1":
            x = x[:, :, : x.shape[2] // 2 * 2].reshape(*x.shape[:2], -1, 2).max(axis=3)
    return x.mean(axis=2) @ net["fc.weight"].T + net["fc.bias"]


def _scored(windows: DataFrame, params: DataFrame, channels: int, kinds: dict[str, bool]) -> DataFrame:
    """id and, for each kind (a prefix; whether features are rounded to 8.8 fixed point), pred_id and confidence, in one pass. Ties go to the lowest class."""
    net = network(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("flat").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1, channels)
            out = [b.column("id")]
            for quantised in kinds.values():
                flat = np.rint(np.clip(raw, -128, 127.99609375) * 256) / 256 if quantised else raw
                z = forward(flat.transpose(0, 2, 1), net) if b.num_rows else np.zeros((0, 1))
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                out += [pa.array(z.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1))]
            yield pa.RecordBatch.from_arrays(out, names=["id", *[f"{k}{c}" for k in kinds for c in ("pred_id", "confidence")]])

    return windows.select("id", "flat").mapInArrow(run, "id long, " + ", ".join(f"{k}pred_id int, {k}confidence double" for k in kinds))


def score(windows: DataFrame, params: DataFrame, channels: int, quantise: bool = False) -> DataFrame:
    """(id, pred_id, confidence) of rows (id, flat: time-major values), by batches of rows.

    ``quantise`` rounds features to 8.8 fixed point first.
    """
    return _scored(windows, params, channels, {"": quantise})


def quantisation_report(windows: DataFrame, params: DataFrame, channels: int) -> DataFrame:
    """id, true_id and the predictions with raw and with 8.8 features, both from one pass."""
    both = _scored(windows, params, channels, {"": False, "q88_": True}).select("id", "pred_id", "q88_pred_id")
    return windows.select("id", "true_id").join(both, "id")


def fit_classifier(train: DataFrame, max_iter: int = 50, reg: float = 0.01, weight: str | None = None):
    """A multinomial logistic regression on rows (flat, label)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = train.withColumn("features", array_to_vector(F.col("flat").cast("array<double>"))).withColumn("label", F.col("label").cast("double"))
    lr = LogisticRegression(maxIter=max_iter, regParam=reg)
    return (lr.setWeightCol(weight) if weight else lr).fit(d)


def predict(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("features", array_to_vector(F.col("flat").cast("array<double>")))
    return model.transform(d).withColumn("pred_id", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def sweep(df: DataFrame, grid: dict[str, list], n_classes: int) -> DataFrame:
    """One row a grid point: its parameters and the accuracy on each split, best test accuracy first.

    ``df`` has flat, label and split; each point is one fit on the train rows. The weights of all points are stacked
    in one matrix, so all are scored in one pass over the rows, which counts hits by split and point where they lie.
    """
    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    train = df.filter("split = 'train'").persist()
    models = [fit_classifier(train, **point) for point in points]
    train.unpersist()
    weights = np.concatenate([m.coefficientMatrix.toArray() for m in models])
    intercepts = np.concatenate([m.interceptVector.toArray() for m in models])
    binary = len(intercepts) == len(models)  # of two classes only the second has weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("flat").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            z = (x @ weights.T + intercepts).reshape(b.num_rows, len(points), -1)
            pred = (z[:, :, 0] > 0).astype(int) if binary else z.argmax(axis=2)
            true = b.column("label").to_numpy(zero_copy_only=False)
            valid = (true >= 0) & (true < n_classes)
            right = valid[:, None] & (np.where((pred >= 0) & (pred < n_classes), pred, 0) == true[:, None])
            split = np.array(b.column("split").to_pylist(), object)
            for s in dict.fromkeys(split):
                at = split == s
                yield pa.RecordBatch.from_pydict({"split": [s] * len(points), "point": pa.array(np.arange(len(points)), pa.int32()), "total": pa.array([int(valid[at].sum())] * len(points)), "right": pa.array(right[at].sum(axis=0))})

    rows = df.filter("split is not null and label is not null").select("flat", "label", "split")
    counts = rows.mapInArrow(run, "split string, point int, total long, right long").groupBy("point")
    rate = lambda s: 100.0 * F.coalesce(F.sum(F.when(F.col("split") == s, F.col("right"))), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.when(F.col("split") == s, F.col("total"))), F.lit(0)), F.lit(1))
    found = counts.agg(*[rate(s).alias(f"{s}_acc") for s in ("train", "val", "test")])
    each = [F.element_at(F.array(*[F.lit(p[k]) for p in points]), F.col("point") + 1).alias(k) for k in grid]
    return found.orderBy(F.desc("test_acc"), F.desc("val_acc"), "point").select(*each, "train_acc", "val_acc", "test_acc")
