"""Merkle manifest of a data set by time-forward processing (operator 11).

Every row is a leaf. The leaves of a source form a tree of runs of ``fan_out``
nodes, and the sources' roots form a tree above them. A node is labelled by the
last leaf below it and its level, so children come before parents in the order
of labels. A digest is a message to the label of the parent.

The priority queue of messages has two parts. Between blocks of fan_out ** levels
nodes it is external: a shuffle by block with Spark's spilling sort by label.
Inside of a block a heap delivers the child digests to their parents, and what is
left, one node a block, is the message to the next, smaller round. The reversed
sweep goes down the same rounds in falling order of labels: a block gets the
proof of its own root as a message, sorted before its leaves, and each node sends
its children their siblings and its own proof.

Positions come from a range sort by source and order with a count a range, so a
source with most of the rows is spread over ranges and blocks like any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.llm.shared import discard, light, written


@dataclass(frozen=True)
class MerkleConfig:
    #: Columns of a leaf in order, the one that names its tree, and the order of leaves inside of it.
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    source: str = "source"
    order: str = "doc_id"
    fan_out: int = 16
    #: Levels that a block spans.
    levels: int = 2
    #: Rows of counts by range and source up to which they are broadcast; beyond, the join is a shuffle.
    light_rows: int = 10_000


#: A proof is, level by level from the leaf, what stands left and right of a node in its run.
PROOF = "array<struct<left:string,right:string>>"
_NODE = "tree string, pos long, n long, digest string"


def digest(*values: Column | str) -> Column:
    """Lower-case hex sha256 of the values, each as its UTF-8 byte count, a colon and its text; null is a hyphen."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """The nodes above consecutive leaves of a tree, up to ``levels`` levels or its root."""

    def __init__(self, digests: list[str], first: int, n: int, fan_out: int, levels: int):
        self.first, self.n, self.fan, self.top = first, n, fan_out, 0
        while self.top < levels and self._count(self.top) > 1:
            self.top += 1
        self.digests = {(0, first + i): d for i, d in enumerate(digests)}
        heap: list[tuple[int, int, int]] = []  # messages (label of the receiver: last leaf and level; sender)
        for i in range(len(digests)):
            self._send(heap, 0, first + i)
            while heap and heap[0][0] <= first + i:
                self._receive(heap)

    def _count(self, level: int) -> int:
        return -(-self.n // self.fan**level)

    def _end(self, level: int, index: int) -> int:
        return min((index + 1) * self.fan**level, self.n) - 1

    def _send(self, heap: list, level: int, index: int) -> None:
        if level < self.top:
            heapq.heappush(heap, (self._end(level + 1, index // self.fan), level + 1, index))

    def _receive(self, heap: list) -> None:
        """The node of the least label takes the digests of its children."""
        label, children = heap[0][:2], []
        while heap and heap[0][:2] == label:
            children.append(heapq.heappop(heap)[2])
        level, index = label[1], children[0] // self.fan
        self.digests[level, index] = _hash([self.digests[level - 1, c] for c in children])
        self._send(heap, level, index)

    @property
    def root(self) -> tuple[int, int]:
        return self.top, self.first // self.fan**self.top

    def proofs(self, above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
        """The proof of each leaf, where the block's root has the proof ``above``; nodes are taken from the last label to the first."""
        level, index = self.root
        heap = [(-self._end(level, index), -level, index, above)]
        leaves: dict[int, list[tuple[str, str]]] = {}
        while heap:
            _, level, index, proof = heapq.heappop(heap)
            if level == 0:
                leaves[index] = proof
                continue
            below = -level - 1
            run = range(index * self.fan, min((index + 1) * self.fan, self._count(below)))
            names = [self.digests[below, c] for c in run]
            for i, c in enumerate(run):
                sent = [("".join(names[:i]), "".join(names[i + 1 :])), *proof]
                heapq.heappush(heap, (-self._end(below, c), -below, c, sent))
        return [leaves[i] for i in sorted(leaves)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other, from batches sorted by tree and position."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != key and rows:
                yield rows
                rows = []
            key = row["tree"], row["block"]
            rows.append(row)
    if rows:
        yield rows


def _up(fan_out: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "pos", "n", "digest"]
        for rows in _rows(batches):
            b = Block([r["digest"] for r in rows], rows[0]["pos"], rows[0]["n"], fan_out, levels)
            level, index = b.root
            yield pa.RecordBatch.from_pydict({"tree": [rows[0]["tree"]], "pos": pa.array([index], pa.int64()), "n": pa.array([b._count(level)], pa.int64()), "digest": [b.digests[b.root]]}).select(names)

    return run


def _down(fan_out: int, levels: int, kept: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for message, *rows in _rows(batches):
            b = Block([r["digest"] for r in rows], rows[0]["pos"], rows[0]["n"], fan_out, levels)
            proofs = b.proofs([(s["left"], s["right"]) for s in message["proof"]])
            steps = [s for p in proofs for s in p]
            ends = [0]
            for p in proofs:
                ends.append(ends[-1] + len(p))
            pairs = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)], ["left", "right"])
            columns = [pa.array([r[c] for r in rows], schema.field(c).type) for c in kept]
            roots = pa.array([message["roots"]] * len(rows), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), roots], names=[*kept, "proof", "roots"])

    return run


def _block(cfg: MerkleConfig) -> Column:
    return F.floor(F.col("pos") / F.lit(cfg.fan_out**cfg.levels)).cast("long").alias("block")


def sweep_up(nodes: DataFrame, most: int, folder: str, cfg: MerkleConfig) -> list[DataFrame]:
    """Rounds of nodes (tree, pos, n, digest): the given ones, then one node a block of the round before, until each tree has one.

    ``most`` is the number of nodes of the largest tree.
    """
    rounds = [nodes]
    while most > 1:
        d = rounds[-1].select("tree", _block(cfg), "pos", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "pos")
        rounds.append(written(d.mapInArrow(_up(cfg.fan_out, cfg.levels), _NODE), folder, f"round-{len(rounds)}"))
        most = -(-most // cfg.fan_out**cfg.levels)
    return rounds


def sweep_down(rounds: list[DataFrame], roots: DataFrame, cfg: MerkleConfig) -> DataFrame:
    """The rows of the first round with their proof and the roots that they end in.

    ``roots`` has tree, the proof of the tree's root and roots, an array of digests that every row gets.
    """
    messages = roots.select("tree", F.lit(0).cast("long").alias("block"), "proof", "roots")
    for nodes in reversed(rounds[:-1]):
        kept = [c for c in nodes.columns if c not in ("n", "digest")]
        schema = pa.schema([pa.field(c, {"string": pa.string(), "bigint": pa.int64()}[t]) for c, t in nodes.select(kept).dtypes])
        out = ", ".join(f"{c} {t}" for c, t in nodes.select(kept).dtypes) + f", proof {PROOF}, roots array<string>"
        d = nodes.withColumn("block", _block(cfg)).unionByName(messages, allowMissingColumns=True)
        d = d.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("pos").asc_nulls_first())
        messages = d.mapInArrow(_down(cfg.fan_out, cfg.levels, kept, schema), out).withColumnRenamed("pos", "block")
    return messages.withColumnRenamed("block", "pos")


def placed(leaves: DataFrame, order: list[Column], folder: str, cfg: MerkleConfig) -> tuple[DataFrame, int]:
    """``leaves`` with pos (from 0 in their tree) and n (leaves of their tree), and the leaves of the largest tree.

    The rows are dealt out by ranges of tree and order. What is counted is one row a range and tree.
    """
    by = [F.col("tree"), *order]
    d = written(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), folder, "ranges")
    d = d.withColumn("range", F.shiftright("at", 33))
    counts = d.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("tree", "range", "first", before.alias("before"), F.sum("rows").over(tree).alias("n")), folder, "starts")
    most = starts.agg(F.max("n")).collect()[0][0] or 0
    d = d.join(light(starts, cfg.light_rows), ["tree", "range"])
    return d.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "range", "first", "before"), most


def manifest(documents: DataFrame, folder: str, cfg: MerkleConfig = MerkleConfig(), also: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id (``cfg.order`` as long), tree, pos, leaf, proof, roots (subroot and root) of every row, and ``also``, named strings of it.

    Trees are named by their source with an equals sign before, the empty string is the one without source. Leaves of
    a tree ascend by ``cfg.order``, null first, and by digest where it is equal; equal rows are leaves of their own.
    Nulls count as a hyphen in the digest. A tree of one leaf has this as root and no level. An empty table
    gives no rows. Columns that the configuration does not name are not read.
    """
    source, order = F.col(cfg.source).cast("string"), F.col(cfg.order).cast("long").alias("doc_id")
    tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("tree")
    leaves = documents.select(tree, order, digest(*[F.col(c) for c in cfg.columns]).alias("digest"), *also, F.monotonically_increasing_id().alias("salt"))
    leaves, most = placed(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("salt")], folder, cfg)
    leaves = written(leaves.drop("salt"), folder, "leaves")
    discard(documents.sparkSession, folder, "ranges")
    rounds = sweep_up(leaves, most, folder, cfg)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots, sources = placed(subroots, [F.col("name")], f"{folder}/top", cfg)
    above = sweep_up(written(subroots, f"{folder}/top", "leaves"), sources, f"{folder}/top", cfg)
    root = above[-1].select("tree", F.array().cast(PROOF).alias("proof"), F.array("digest").alias("roots"))
    top = sweep_down(above, root, cfg) if sources > 1 else above[0].crossJoin(root.select("proof", "roots"))  # one row each
    starts = top.select(F.col("name").alias("tree"), "proof", "roots").join(rounds[-1].select("tree", "digest"), "tree")
    starts = written(starts.select("tree", "proof", F.concat(F.array("digest"), "roots").alias("roots")), folder, "starts-down")
    if most <= 1:  # every tree is one leaf
        return leaves.join(starts, "tree").withColumnRenamed("digest", "leaf").drop("n")
    return sweep_down([leaves.withColumn("leaf", F.col("digest")), *rounds[1:]], starts, cfg)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))
