"""Exact top-k inner product search with multi-resolution segment statistics (operator 1).

All vectors are turned by one orthogonal matrix, fitted on a bounded sample, so that
the leading coordinates hold as much as they can; inner products stay as they are.
Each vector keeps, at every resolution, the mean and the deviation of segments of
the turned coordinates. For a query q and a vector v the squared distance is at
least sum over segments of length * ((mean q - mean v)^2 + (sd q - sd v)^2), so
their inner product (|q|^2 + |v|^2 - distance^2) / 2 has an upper bound: sum over
segments of length * (mean q * mean v + sd q * sd v). Bounds are taken coarse to
fine; only pairs whose bound reaches the query's k-th best score so far get an
exact integer product. A bound may fall short by rounding, of which a share of
|q| |v| takes care, so the turn and the resolutions shape cost, never results.

The queries are dealt into groups that a task can hold, the candidates into parts;
each cell of groups and parts is one task, which holds the group's queries and
reads the part's candidates block by block, so that statistics are made once a
block and rows do not grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchConfig:
    k: int = 5
    scale: float = 256.0
    #: Leading coordinates that are segments of their own at each resolution; segments of doubling length cover the others.
    resolutions: tuple[int, ...] = (0, 16, 32)
    #: The turn is fitted on so many components at most, and for vectors of so many components at most.
    sample: int = 1 << 20
    most_turned: int = 1024
    #: Bytes of a group's queries, as doubles; queries and candidates compared at once.
    group_bytes: int = 16 << 20
    query_block: int = 2048
    candidate_block: int = 1024
    #: Bytes of a part's candidates, about, and the fewest cells (0: four for each core of the cluster).
    part_bytes: int = 256 << 20
    cells: int = 0


#: Components of more count as so much, so that sums of squares stay finite.
_MOST = 2.0**400
#: Share of |q| |v| by which a bound may fall short.
_SLACK = 1e-9
_LONG = (1 << 63) - 1


def good_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and embedding of each vector that takes part.

    Null vectors, empty ones and those with a null or non-finite component take
    no part, nor do rows without vec_id.
    """
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("embedding"))


def fit_turn(good: DataFrame, cfg: SearchConfig) -> dict[int, np.ndarray]:
    """The main axes of a sample of the vectors of the most frequent length, those of least hash; none for very long ones."""
    top = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top or top[0]["dim"] > cfg.most_turned:
        return {}
    dim = top[0]["dim"]
    rows = good.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, cfg.sample // dim)).select("embedding").toArrow()
    x = np.clip(rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim), -_MOST, _MOST)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return {dim: np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])}


def segment_edges(dim: int, lead: int) -> np.ndarray:
    """Begins and end of segments: ``lead`` single coordinates, then 1, 2, 4, ... of them."""
    edges = list(range(min(lead, dim)))
    at, step = len(edges), 1
    while at < dim:
        edges.append(at)
        at, step = at + step, 2 * step
    return np.array([*edges, dim])


class Side:
    """Vectors of one length with their segment statistics."""

    def __init__(self, dim: int, ids: np.ndarray, raw: np.ndarray, cfg: SearchConfig, turn: np.ndarray | None):
        self.ids = ids
        self.x = np.floor(np.clip(raw * cfg.scale, -_MOST, _MOST))
        self.norm = np.sqrt(np.einsum("nd,nd->n", self.x, self.x))
        y = self.x if turn is None else self.x @ turn
        self.levels = []
        for lead in cfg.resolutions:
            edges = segment_edges(dim, lead)
            length = np.diff(edges)
            if len(length) >= dim:  # as many segments as coordinates: no less work than the product itself
                break
            mean = np.add.reduceat(y, edges[:-1], axis=1) / length
            sd = np.sqrt(np.maximum(np.add.reduceat(y * y, edges[:-1], axis=1) / length - mean * mean, 0))
            # The last column is the slack of a bound.
            self.levels.append(np.hstack([mean * np.sqrt(length), sd[:, length > 1] * np.sqrt(length[length > 1]), np.sqrt(_SLACK) * self.norm[:, None]]))

    def part(self, at: slice) -> Side:
        out = object.__new__(Side)
        out.ids, out.x, out.norm, out.levels = self.ids[at], self.x[at], self.norm[at], [s[at] for s in self.levels]
        return out


class Left:
    """The pairs of a block that are left: a matrix of marks while they are many, then their rows and columns."""

    def __init__(self, rows: int, columns: int):
        self.mask: np.ndarray | None = np.ones((rows, columns), bool)
        self.i = self.j = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.i) if self.mask is None else int(np.count_nonzero(self.mask))

    def keep(self, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> None:
        """Keeps the pairs whose product of rows of a and b reaches ``low`` of the row."""
        if self.mask is not None:
            self.mask &= a @ b.T >= low[:, None]
            if 8 * len(self) <= self.mask.size:
                self.listed()
            return
        runs = [slice(n, n + (1 << 16)) for n in range(0, len(self.i), 1 << 16)]
        product = np.concatenate([np.einsum("nd,nd->n", a[self.i[r]], b[self.j[r]]) for r in runs] or [np.zeros(0)])
        good = product >= low[self.i]
        self.i, self.j = self.i[good], self.j[good]

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        if self.mask is not None:
            (self.i, self.j), self.mask = np.nonzero(self.mask), None
        return self.i, self.j


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, row by row, of whole numbers held as doubles; beyond a long, its limit."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if most < 1 << 48 and a.shape[1] <= 1 << 14:  # halves of 24 bits: their sums of products fit a long
        a_high, b_high = np.floor(a / (1 << 24)), np.floor(b / (1 << 24))
        ah, al, bh, bl = (x.astype(np.int64) for x in (a_high, a - a_high * (1 << 24), b_high, b - b_high * (1 << 24)))
        parts = [np.einsum("nd,nd->n", x, y).tolist() for x, y in ((ah, bh), (ah, bl), (al, bh), (al, bl))]
        sums = [(hh << 48) + ((hl + lh) << 24) + ll for hh, hl, lh, ll in zip(*parts, strict=True)]
    else:
        sums = [sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([max(-_LONG, min(_LONG, s)) for s in sums], np.int64)


class Best:
    """The k best (score, id) of each query of a group so far, as rows (query, id, score) in order."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.at, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        at, ids, score = np.r_[self.at, at], np.r_[self.ids, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        first = np.searchsorted(at, np.arange(self.queries))
        rank = np.arange(len(at)) - first[at]
        keep = rank < self.k
        self.floor[at[rank == self.k - 1]] = score[rank == self.k - 1]
        self.at, self.ids, self.score = at[keep], ids[keep], score[keep]


def search_block(q: Side, v: Side, first: int, best: Best, counts: list[int] | None = None) -> None:
    """Adds the best of a block of candidates to those of the queries ``first`` and on; ``counts`` takes the pairs left after each level."""
    n = len(q.ids)
    safe = q.norm.max(initial=0) * v.norm.max(initial=0) < 1 << 53  # all sums are whole numbers that a double holds

    def scores(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nd->n", q.x[i], v.x[j]).astype(np.int64) if safe else exact_products(q.x[i], v.x[j])

    floor = best.floor[first : first + n].copy()
    if (new := np.flatnonzero(np.isinf(floor))).size:  # the vectors of best bound, scored exactly, set a first floor
        bound = q.levels[-1][new] @ v.levels[-1].T if q.levels else q.x[new] @ v.x.T
        m = min(2 * best.k + 1, len(v.ids))
        i, j = np.repeat(new, m), np.argpartition(-bound, m - 1, axis=1)[:, :m].ravel()
        i, j = (x[q.ids[i] != v.ids[j]] for x in (i, j))
        score = scores(i, j)
        order = np.lexsort((-score, i))
        i, score = i[order], score[order]
        kth = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i] == best.k - 1)
        floor[i[kth]] = score[kth]
    low = np.where(np.isinf(floor), floor, floor - 1e-12 * np.abs(floor))
    left = Left(n, len(v.ids))
    for a, b in zip(q.levels, v.levels, strict=True):  # coarse to fine
        left.keep(a, b, low)
        if counts is not None:
            counts.append(len(left))
    with_slack = [np.hstack([s.x, np.sqrt(_SLACK) * s.norm[:, None]]) for s in (q, v)] if not safe else [q.x, v.x]
    left.keep(*with_slack, floor if safe else low)
    i, j = left.listed()
    other = q.ids[i] != v.ids[j]
    i, j = i[other], j[other]
    runs = [slice(k, k + (1 << 16)) for k in range(0, len(i), 1 << 16)]
    score = np.concatenate([scores(i[r], j[r]) for r in runs] or [np.zeros(0, np.int64)])
    keep = score >= floor[i]
    best.add(first + i[keep], v.ids[j[keep]], score[keep])


_BLOCK = "dim int, share long, ids binary, xs binary"


def _to_blocks(size: int):
    """Blocks of vectors of one dim and share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, share, ids = (batch.column(c).to_numpy() for c in ("dim", "share", "vec_id"))
            out: list[tuple] = []
            for dim, own in sorted(set(zip(dims.tolist(), share.tolist(), strict=True))):
                at = np.flatnonzero((dims == dim) & (share == own))
                for k in range(0, len(at), size):
                    some = at[k : k + size]
                    flat = batch.column("embedding").take(pa.array(some)).flatten().to_numpy().astype("<f8")
                    out.append((dim, own, ids[some].astype("<i8").tobytes(), flat.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "share", "ids", "xs"])

    return run


def _cells(cfg: SearchConfig, turns: dict[int, np.ndarray]):
    """Of each cell and dim the queries come first, then the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(dim: int, rows: list) -> Side:
            ids, xs = (np.frombuffer(b"".join(r[n] for r in rows), t) for n, t in (("ids", "<i8"), ("xs", "<f8")))
            return Side(dim, ids, xs.reshape(-1, dim), cfg, turns.get(dim))

        def found(q: Side, best: Best) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q.ids[best.at], best.ids, best.score)], names=["query_id", "vec_id", "score"])

        now, held, q, best = None, [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["cell"], r["dim"]) != now:
                    if q is not None:
                        yield found(q, best)
                    now, held, q = (r["cell"], r["dim"]), [], None
                if r["side"] == 0:
                    held.append(r)
                    continue
                if q is None:
                    if not held:
                        continue  # no queries of this length here
                    q, held = side(r["dim"], held), []
                    best = Best(len(q.ids), cfg.k)
                v = side(r["dim"], [r])
                for at in range(0, len(q.ids), cfg.query_block):
                    search_block(q.part(slice(at, at + cfg.query_block)), v, at, best)
        if q is not None:
            yield found(q, best)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Both tables have vec_id and embedding; a candidate with the query's own
    vec_id is left out. Ties go to the smaller vec_id. Queries are matched with
    vectors of their own length. Rows that repeat a vec_id are candidates of
    their own; queries that repeat a vec_id give one answer, for the least vector.
    Scores are exact for components of any size; one that a long cannot hold is
    given as the long nearest to it. Fewer candidates than k give all; a query
    without any, and empty tables, give no rows. Other columns are not read.
    """
    good = good_vectors(vectors)
    q = good_vectors(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    turns = fit_turn(good, cfg)
    size = lambda d: d.agg(F.coalesce(F.sum(F.col("dim") * F.lit(8).cast("long")), F.lit(0))).collect()[0][0]
    groups = max(1, -(-size(q) // cfg.group_bytes))
    least = cfg.cells or 4 * q.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-least // groups), -(-size(good) // cfg.part_bytes))
    # Each query meets every vector of its length: the stated query set against all rows, in blocks.
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    qb = q.withColumn("share", spread(groups)).mapInArrow(_to_blocks(cfg.query_block), _BLOCK).withColumn("part", every(parts))
    qb = qb.select("dim", (F.col("share") * parts + F.col("part")).alias("cell"), F.lit(0).alias("side"), "ids", "xs")
    vb = good.withColumn("share", F.lit(0).cast("long")).mapInArrow(_to_blocks(cfg.candidate_block), _BLOCK).withColumn("group", every(groups))
    vb = vb.select("dim", (F.col("group") * parts + F.pmod(F.xxhash64("ids"), F.lit(parts))).alias("cell"), F.lit(1).alias("side"), "ids", "xs")
    rows = qb.unionByName(vb).repartitionById(groups * parts, F.col("cell").cast("int")).sortWithinPartitions("cell", "dim", "side")
    found = rows.mapInArrow(_cells(cfg, turns), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
