"""Toxicity by a classifier chain of linear models (operator 7).

Categories are predicted one after the other; each model sees the words of the
text and the probabilities of the categories before it. For training, those
probabilities are out of fold: they come from models that did not see the row.

Features are hashes of words and of their first bytes, so inflected and compound
forms of a word count too. The features kept are those of the highest chi-square
with any category. Training uses a bounded sample of labelled rows (those of
least hash of the id that have a document); every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefold.llm.shared import written
from wavefold.llm.words import BY_LETTER, word_batches


@dataclass(frozen=True)
class ToxicityConfig:
    #: Label columns (0/1) in the order of the chain; the last one decides.
    categories: tuple[str, ...] = ("low_quality", "toxic")
    threshold: float = 0.5
    #: Bound of the training sample, in labelled documents.
    sample: int = 20_000
    #: Features kept for each category, and the fewest documents that have one.
    features: int = 1000
    least_documents: int = 3
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    folds: int = 4
    steps: int = 80
    l2: float = 1e-4


def _features(texts: pa.Array, prefixes: tuple[int, ...], kept: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct features); with ``kept`` (sorted) their positions in it instead."""
    table = None
    if kept is not None:
        table = np.zeros(1 << 20, bool)
        table[kept & np.uint64((1 << 20) - 1)] = True
    open_row, parts = -1, []

    def known(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if kept is None:
            return at, h
        hit = np.flatnonzero(table[h & np.uint64((1 << 20) - 1)])
        at, h = at[hit], h[hit]
        i = np.searchsorted(kept, h)
        good = (i < len(kept)) & (kept[np.minimum(i, len(kept) - 1)] == h) if len(kept) else np.zeros(len(h), bool)
        return at[good], i[good].astype(np.uint64)

    for first, rows, edges, w in word_batches(texts, BY_LETTER):
        found = [known(np.arange(len(w.hashes)), w.hashes), *(known(*w.prefixes(n)) for n in prefixes)]
        at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        row = np.searchsorted(edges, at, side="right") - 1
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        row, h = row[new], h[new]
        cut = np.searchsorted(row, np.arange(rows + 1))
        for r in range(rows):
            own = h[cut[r] : cut[r + 1]]
            if first + r != open_row:
                if open_row >= 0:
                    yield open_row, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
                open_row, parts = first + r, [own]
            else:  # a further piece of a long text
                parts.append(own)
    if open_row >= 0:
        yield open_row, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def labelled(documents: DataFrame, labels: DataFrame, folder: str, cfg: ToxicityConfig) -> DataFrame:
    """The training sample, written to ``folder``: _id, text and one 0/1 column for each category, at most ``cfg.sample`` rows.

    ``labels`` has doc_id and the categories; of several rows of a doc_id the
    highest value counts, null counts as 0. Only documents with a label are
    counted; those of least hash of doc_id are taken, among texts of one doc_id
    those of least hash; rows that agree in both count once. Texts are named by
    a hash until the sample is known, so they are not moved before.
    """
    y = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).cast("int").alias(f"_y{i}") for i, c in enumerate(cfg.categories)])
    d = documents.select(F.col("doc_id").cast("long").alias("_id"), "text").withColumn("_text", F.xxhash64("text"))
    known = d.select("_id", "_text").join(y, F.col("_id") == F.col("doc_id")).drop("doc_id").distinct()
    sample = written(known.orderBy(F.xxhash64("_id"), "_id", "_text").limit(cfg.sample), folder, "sample-ids")
    rows = d.join(F.broadcast(sample), ["_id", "_text"]).dropDuplicates(["_id", "_text"])  # at most cfg.sample rows of a few numbers
    return written(rows.select("_id", "text", *[f"_y{i}" for i in range(len(cfg.categories))]), folder, "sample")


def _counted(n: int, prefixes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array([batch.column(f"_y{i}").to_numpy() for i in range(n)]).T
            found = list(_features(batch.column("text"), prefixes))
            row, h = np.repeat([r for r, _ in found], [len(f) for _, f in found]), np.concatenate([f for _, f in found] or [np.zeros(0, np.uint64)])
            h, back = np.unique(h, return_inverse=True)
            counts = [np.bincount(back, minlength=len(h)), *(np.bincount(back, y[row, i], minlength=len(h)) for i in range(n))]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["f", "n", *(f"y{i}" for i in range(n))])

    return run


def _indexed(n: int, prefixes: tuple[int, ...], kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [f.astype("<i4").tobytes() for _, f in _features(batch.column("text"), prefixes, kept)]  # compact on the driver
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(batch.column(f"_y{i}") for i in range(n)), pa.array(x, pa.binary())], names=["_id", *(f"_y{i}" for i in range(n)), "x"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse 0/1 rows with some dense columns."""

    def __init__(self, x: list[np.ndarray], dense: np.ndarray):
        self.index, self.row = np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(x)), [len(r) for r in x])
        self.n, self.dense = len(x), dense

    def times(self, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.index], minlength=self.n) + self.dense @ v + b


def fit_logistic(rows: _Rows, y: np.ndarray, size: int, use: np.ndarray, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the features, of the dense columns and the intercept, by Adam steps over the rows in ``use``."""
    take = use[rows.row]
    row, index, u = rows.row[take], rows.index[take], use.astype(float)
    p = np.zeros(size + rows.dense.shape[1] + 1)
    rate = (y * u).sum() / max(u.sum(), 1)
    p[-1] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    m, s = np.zeros_like(p), np.zeros_like(p)
    weight = u * np.where(y > 0, 0.5 / max((y * u).sum(), 1), 0.5 / max(((1 - y) * u).sum(), 1))  # both classes weigh the same
    for t in range(1, cfg.steps + 1):
        z = np.bincount(row, p[index], minlength=rows.n) + rows.dense @ p[size:-1] + p[-1]
        g = (_sigmoid(z) - y) * weight
        grad = np.r_[np.bincount(index, g[row], minlength=size), rows.dense.T @ g, g.sum()] + cfg.l2 * np.r_[p[:-1], 0]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        p -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return p[:size], p[size:-1], float(p[-1])


@dataclass(frozen=True)
class Chain:
    kept: np.ndarray  # sorted hashes
    models: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    cfg: ToxicityConfig

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One row a text, one column a category."""
        out = np.zeros((len(texts), len(self.models)))
        for r, x in _features(texts, self.cfg.prefixes, self.kept):
            x = x.astype(np.int64)
            for i, (w, v, b) in enumerate(self.models):
                out[r, i] = w[x].sum() + out[r, :i] @ v + b
                out[r, i] = _sigmoid(out[r, i])
        return out


def fit_chain(documents: DataFrame, labels: DataFrame, folder: str, cfg: ToxicityConfig = ToxicityConfig()) -> Chain:
    """Trains the chain; without labelled rows all probabilities are near 0. Features of equal chi-square are taken by their hash."""
    n, sample = len(cfg.categories), labelled(documents, labels, folder, cfg)
    counts = sample.mapInArrow(_counted(n, cfg.prefixes), "f long, n long, " + ", ".join(f"y{i} long" for i in range(n)))
    counts = counts.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", *(f"y{i}" for i in range(n)))]).filter(F.col("n") >= cfg.least_documents)
    total = sample.agg(F.count("*"), *[F.coalesce(F.sum(f"_y{i}"), F.lit(0)) for i in range(n)]).collect()[0]
    kept: set[int] = set()
    if total[0]:
        scores = []
        for i in range(n):
            expected = F.col("n") * F.lit(total[1 + i] / total[0])
            scores.append((F.pow(F.col(f"y{i}") - expected, 2) / (expected * F.lit(1 - total[1 + i] / total[0]) + 1e-9)).alias(f"s{i}"))
        scored = counts.select("f", *scores)
        best = [scored.select("f", F.col(f"s{i}").alias("s")).orderBy(F.desc("s"), "f").limit(cfg.features) for i in range(n)]
        for b in best:
            kept.update(r[0] for r in b.collect())
    hashes = np.sort(np.array(sorted(kept), np.int64).view(np.uint64))
    rows = sample.mapInArrow(_indexed(n, cfg.prefixes, hashes), "_id long, " + ", ".join(f"_y{i} int" for i in range(n)) + ", x binary").collect() if kept else []
    rows.sort(key=lambda r: (r[0], bytes(r[-1])))
    ids, y = np.array([r[0] for r in rows], np.int64), np.array([[r[1 + i] for i in range(n)] for r in rows], float).reshape(-1, n)
    x = [np.frombuffer(r[-1], "<i4") for r in rows]
    fold = (np.array(ids, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % cfg.folds if len(ids) else np.zeros(0, np.int64)
    earlier, models = np.zeros((len(rows), 0)), []
    for i in range(n):
        data = _Rows(x, earlier)
        models.append(fit_logistic(data, y[:, i], len(hashes), np.ones(len(rows), bool), cfg) if rows else (np.zeros(len(hashes)), np.zeros(i), -30.0))
        if i + 1 < n:
            unseen = np.zeros(len(rows))
            for k in range(cfg.folds):
                out = fold == k
                if out.any():
                    unseen[out] = _sigmoid(data.times(*fit_logistic(data, y[:, i], len(hashes), ~out, cfg)))[out]
            earlier = np.column_stack([earlier, unseen])
    return Chain(hashes, tuple(models), cfg)


def probability(text: Column, chain: Chain) -> Column:
    """Struct of the category probabilities of a text; null counts as empty."""
    names, kind = chain.cfg.categories, pa.struct([(c, pa.float64()) for c in chain.cfg.categories])

    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in names) + ">")
    def score(texts: pa.Array) -> pa.Array:
        p = chain.probabilities(texts)
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))], fields=list(kind))

    return score(text)


def score_documents(documents: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each, and toxic (the last one is at the threshold or above).

    Every row is scored where it lies; null ids and repeated rows are kept, null
    and empty texts get the score of no words. An empty table gives no rows.
    """
    s = documents.select("doc_id", probability(F.col("text"), chain).alias("p"))
    names = chain.cfg.categories
    return s.select("doc_id", *[F.round(f"p.{c}", 6).alias(f"p_{c}") for c in names], (F.col(f"p.{names[-1]}") >= chain.cfg.threshold).alias("toxic"))
