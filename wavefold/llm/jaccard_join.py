"""N-gram Jaccard join by signature trees (operator 4).

Texts become sets of 64-bit hashes of their word shingles; equal sets are one
class, so copies cost one comparison side. A set has two independent 64-bit names.
The first names its class; where sets with different second names share it, all but
one get another, so classes are told apart by 128 bits.

Distribution. Two sets that reach the threshold share at least l elements of
their prefixes, the first n - ceil(t * n) + l in one global order, where l is
1 + n / ``extra`` for the smaller one. Classes that share fewer elements than any
partner of fitting size asks for drop out before sets are moved. The order
puts elements that are frequent in a sample last, so common passages seldom bring
documents together; the sample shapes cost only, never results. Each element with
several classes names the least one as pivot; each class goes to the pivot that
it shares most elements with. Those groups, split by size, are the blocks.

Signature trees. In a block, classes are the leaves of a tree whose nodes hold
the OR of their token bitmaps, the range of set sizes and the fewest bits of a
member. A dual traversal from the root against itself (or against the root of
another block's tree) prunes pairs of nodes whose maximum possible overlap stays
below the overlap that their sizes ask for; what remains at the leaves is
verified on the full sets.

Round A joins each block with itself. Round B joins pairs of blocks that share
enough prefix elements. A class is a member of one block, so each pair of classes
is verified in one task at most. Tasks return a forest of links, which makes the
components, and for each class the number of documents it links with: every link
is counted, but rows do not grow with the square of a group.

Without ``every_link`` (``one_of_each``, which asks for components only) pairs that
are in one component already are not verified: round A has each block's pivot as
a guest, and round B takes blocks that still hold different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.components import components
from wavefold.llm.shared import discard, fresh, light, written
from wavefold.llm.words import BY_SPACE, mix64, word_batches


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    percent: int = 75
    #: A prefix is longer by 1 + n / extra elements, and so many must be shared.
    extra: int = 10
    #: 64-bit words of a token bitmap; members of a leaf; children of a node.
    bitmap: int = 16
    leaf: int = 16
    fan: int = 4
    #: Set elements and sets of a block, about (a single larger set is a block).
    block: int = 500_000
    block_rows: int = 1024
    #: One document in so many is sampled for frequent elements; at most so many of them are sent to tasks.
    sample: int = 32
    frequent: int = 20_000
    #: Rows of (class, key) or ids up to which they are broadcast to find texts; beyond, texts are shuffled.
    light_rows: int = 500_000
    #: Verify and count all links; without it only as many as connect the components.
    every_link: bool = True
    #: Bits of a set's first name; fewer make sets share names, for tests.
    name_bits: int = 64


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; null is empty."""
    times = [np.uint64(pow(0x9E3779B97F4A7C15, words - 1 - i, 1 << 64)) for i in range(words)]

    def rolled(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = max(0, len(h) - words + 1)
            out = np.zeros(n, np.uint64)
            for i in range(words):
                out += h[i : i + n] * times[i]
        return mix64(out)

    def few(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = np.uint64(len(h))
            for v in h:
                x = mix64(np.array([x * np.uint64(0xD6E8FEB86659FD93) + v], np.uint64))[0]
        return np.array([x], np.uint64)

    held: list[np.ndarray] = []
    open_row = -1

    def close() -> np.ndarray:
        h = np.concatenate(held)
        return np.unique(rolled(h)) if len(h) >= words else few(h) if len(h) else np.zeros(0, np.uint64)

    for first, rows, edges, w in word_batches(texts, BY_SPACE):
        if rows == 1:
            if first != open_row and open_row >= 0:
                yield close()
                held = []
            open_row = first
            held.append(w.hashes)
            continue
        if open_row >= 0:
            yield close()
            held, open_row = [], -1
        s = rolled(w.hashes)
        row = np.searchsorted(edges, np.arange(len(s)), side="right") - 1
        inside = np.arange(len(s)) + words <= edges[row + 1]
        row, s = row[inside], s[inside]
        order = np.lexsort((s, row))
        row, s = row[order], s[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (s[1:] != s[:-1])] if len(s) else np.zeros(0, bool)
        row, s = row[new], s[new]
        cut = np.searchsorted(row, np.arange(rows + 1))
        for r in range(rows):
            n = edges[r + 1] - edges[r]
            yield s[cut[r] : cut[r + 1]] if n >= words else few(w.hashes[edges[r] : edges[r + 1]]) if n else np.zeros(0, np.uint64)
    if open_row >= 0:
        yield close()


def class_names(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent names of a set, the first one of ``bits`` bits."""
    with np.errstate(over="ignore"):
        mixed = mix64(s + np.uint64(0xA0761D6478BD642F))
        other = mix64((mixed ^ np.uint64(0x8EBC6AF09C88C6E3)) * np.uint64(0x589965CC75374CC3))
        x = np.array([mixed.sum(dtype=np.uint64), other.sum(dtype=np.uint64)], np.uint64) ^ (np.uint64(len(s)) * np.uint64(0xE7037ED1A0B428DB))
    first, second = mix64(x).view(np.int64).tolist()
    return first & (1 << bits) - 1 if bits < 64 else first, second


def _renamed(cls: int, check: int, twins: dict[int, int]) -> int:
    """The class of a set by its names: the first one, but for sets of ``twins`` that are not the one to keep it."""
    if not twins or twins.get(cls, check) == check:
        return cls
    x = np.array([cls, check], np.int64).view(np.uint64)
    return int(mix64(mix64(x[:1]) ^ x[1:]).view(np.int64)[0])


def _digests(cfg: JoinConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for s in shingle_sets(batch.column("text"), cfg.words):
                sizes.append(len(s)), names.append(class_names(s, cfg.name_bits) if len(s) else (None, None))
            columns = [batch.column("doc_id"), batch.column("text_key"), batch.column("key"), pa.array(sizes, pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "key", "n_shingles", "cls", "check"])

    return run


def _prefixes(cfg: JoinConfig, frequent: np.ndarray, twins: dict[int, int]):
    """Rows (cls, token) of the prefix of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                cls, prefix = [], []
                for s in shingle_sets(batch.column("text").slice(i, 1024), cfg.words):
                    if not len(s):
                        continue
                    size = len(s)
                    cls.append(_renamed(*class_names(s, cfg.name_bits), twins))
                    if len(frequent):
                        at = np.searchsorted(frequent, s)
                        late = frequent[np.minimum(at, len(frequent) - 1)] == s
                        if late.any():
                            s = np.concatenate([s[~late], s[late]])
                    prefix.append(s[: size - -(-cfg.percent * size // 100) + 1 + size // cfg.extra])
                tokens = np.concatenate([*prefix, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(cls, np.int64), [len(x) for x in prefix])), pa.array(tokens)], names=["cls", "token"])

    return run


def _sampled(cfg: JoinConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {class_names(s): s for s in shingle_sets(batch.column("text"), cfg.words) if len(s)}
            h, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def frequent_shingles(documents: DataFrame, cfg: JoinConfig) -> np.ndarray:
    """Elements found in several sampled documents, at most ``cfg.frequent`` (most frequent first), sorted."""
    d = documents.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(cfg.sample)) == 0).select("text")
    n = d.mapInArrow(_sampled(cfg), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 4")
    rows = n.orderBy(F.desc("n"), "h").limit(cfg.frequent).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (token, cls) sorted by both: those of tokens with several classes, each once, with the token's least class."""
    last_token, last_cls, pivot, emitted = None, None, None, True
    for batch in batches:
        token, cls = batch.column("token").to_numpy(), batch.column("cls").to_numpy()
        if not len(token):
            continue
        fresh = np.r_[last_token is None or token[0] != last_token, token[1:] != token[:-1]]
        other = fresh | np.r_[last_cls is None or cls[0] != last_cls, cls[1:] != cls[:-1]]
        token, cls, fresh = token[other], cls[other], fresh[other]
        if not len(token):
            continue
        group = np.cumsum(fresh)  # 0: still the group that the last batch left open
        least = np.r_[pivot if pivot is not None else 0, cls[fresh]][group]
        size = np.bincount(group, minlength=int(group[-1]) + 1)
        out_token, out_cls, out_least = [], [], []
        if size[0] and not emitted:  # the open group has its second class now
            out_token, out_cls, out_least = [np.array([last_token])], [np.array([pivot])], [np.array([pivot])]
            emitted = True
        end = int(group[-1])
        keep = (size[group] > 1) | (group == 0)
        out_token.append(token[keep]), out_cls.append(cls[keep]), out_least.append(least[keep])
        if end > 0:
            emitted, pivot = bool(size[end] > 1), int(least[-1])
        last_token, last_cls = int(token[-1]), int(cls[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_token, out_cls, out_least)], names=["token", "cls", "pivot"])


class Tree:
    """Signature tree over sets in a given order; level 0 holds the leaves."""

    def __init__(self, sets: list[np.ndarray], cfg: JoinConfig):
        first = np.array([int(s[0]) >> 1 if len(s) else 0 for s in sets], np.int64)
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((size, first))  # sets with one least hash are neighbours
        self.size = size[self.order]
        bits = np.zeros((len(sets), cfg.bitmap), np.uint64)
        mask = np.uint64(cfg.bitmap * 64 - 1)
        for r, i in enumerate(self.order):
            b = sets[i] & mask
            np.bitwise_or.at(bits[r], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        self.bits, self.ones = bits, np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = []
        begin, join, low, high, least = np.arange(0, len(sets) + 1, 1), bits, self.size, self.size, self.ones
        step = cfg.leaf
        while True:
            at = np.arange(0, len(low), step)
            join = np.bitwise_or.reduceat(join, at, axis=0)
            low, high, least = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(least, at)
            begin = np.r_[begin[at], len(sets)]
            self.levels.append((join, low, high, least, begin))
            if len(at) == 1:
                return
            step = cfg.fan


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b that reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of two leaves, given as ``Leaves`` holds them."""
    out = np.zeros((x[1].shape[1] * 8, y[1].shape[1] * 8), np.int64)
    for k in range(0, len(x[0]), 1 << 16):
        e = x[0][k : k + (1 << 16)]
        at = np.minimum(np.searchsorted(y[0], e), len(y[0]) - 1)
        both = np.flatnonzero(y[0][at] == e)
        u, v = np.unpackbits(x[1][k + both], axis=1).astype(np.float32), np.unpackbits(y[1][at[both]], axis=1).astype(np.float32)
        out += (u.T @ v).astype(np.int64)  # at most 2^16 ones each: exact
    return out


class Leaves:
    """Distinct elements of a leaf and, as packed bits, which of its members hold each; made when asked for."""

    def __init__(self, sets: list[np.ndarray], places: np.ndarray, tree: Tree):
        self.sets, self.places, self.tree, self.made = sets, places, tree, {}

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.made:
            begin = self.tree.levels[0][4]
            members = [self.sets[k] for k in self.places[self.tree.order[begin[i] : begin[i + 1]]]]
            elements, at = np.unique(np.concatenate(members), return_inverse=True)
            bits = np.zeros((len(elements), -(-len(members) // 8)), np.uint8)
            row = np.repeat(np.arange(len(members)), [len(m) for m in members])
            for r in range(len(members)):
                bits[at[row == r], r >> 3] |= np.uint8(128 >> (r & 7))
            self.made[i] = elements, bits
        return self.made[i]


def tree_links(sets: list[np.ndarray], ids: np.ndarray, cfg: JoinConfig, split: int | None = None, weights: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest of links between sets by dual traversal, and the weight of the sets that each is linked with.

    With ``split``, only between the first ``split`` sets and the others. Without
    ``weights``, pairs already in one component are not verified, and nothing is
    counted.
    """
    parent = np.arange(len(sets))  # component of each set, renamed at every link
    linked = np.zeros(len(sets), np.int64)
    left = np.arange(len(sets)) if split is None else np.arange(split)
    right = left if split is None else np.arange(split, len(sets))
    if not len(left) or not len(right):
        return [], linked
    a = Tree([sets[i] for i in left], cfg)
    b = a if split is None else Tree([sets[i] for i in right], cfg)
    in_a = Leaves(sets, left, a)
    in_b = in_a if a is b else Leaves(sets, right, b)
    sizes = np.array([len(s) for s in sets], np.int64)
    links: list[tuple[int, int]] = []

    def linked_pair(u: int, v: int) -> bool:
        s, t = (sets[u], sets[v]) if len(sets[u]) <= len(sets[v]) else (sets[v], sets[u])
        at = np.searchsorted(t, s)
        both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
        return bool(both) and 100 * both >= cfg.percent * (len(s) + len(t) - both)

    def leaves(i: int, j: int) -> None:
        x, y = slice(a.levels[0][4][i], a.levels[0][4][i + 1]), slice(b.levels[0][4][j], b.levels[0][4][j + 1])
        m, n = left[a.order[x]], right[b.order[y]]
        sm, sn = a.size[x][:, None], b.size[y][None, :]
        common = np.bitwise_count(a.bits[x][:, None, :] & b.bits[y][None, :, :]).sum(axis=2).astype(np.int64)
        # A bit that only one set has stands for an element that only it has.
        most = np.minimum(sm - (a.ones[x][:, None] - common), sn - (b.ones[y][None, :] - common))
        asked = most >= _needed(sm, sn, cfg.percent)
        if weights is None:
            for p, q in zip(*np.nonzero(asked & (parent[m][:, None] != parent[n][None, :])), strict=True):
                if parent[m[p]] != parent[n[q]] and linked_pair(m[p], n[q]):
                    links.append((int(ids[m[p]]), int(ids[n[q]])))
                    parent[parent == parent[n[q]]] = parent[m[p]]
            return
        if a is b and i == j:
            asked = np.triu(asked, 1)
        p, q = np.nonzero(asked)
        if not len(p):
            return
        if len(p) <= 4:
            ok = np.array([linked_pair(u, v) for u, v in zip(m[p], n[q], strict=True)])
        else:
            both = _overlaps(in_a[i], in_b[j])[p, q]
            ok = (both > 0) & (100 * both >= cfg.percent * (sizes[m[p]] + sizes[n[q]] - both))
        u, v = m[p[ok]], n[q[ok]]
        np.add.at(linked, u, weights[v])
        np.add.at(linked, v, weights[u])
        apart = parent[u] != parent[v]
        for c, d in zip(u[apart], v[apart], strict=True):
            if parent[c] != parent[d]:
                links.append((int(ids[c]), int(ids[d])))
                parent[parent == parent[d]] = parent[c]

    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        ja, lo, hi, ones, at_a = a.levels[la]
        jb, lo_b, hi_b, ones_b, at_b = b.levels[lb]
        common = int(np.bitwise_count(ja[i] & jb[j]).sum())
        most = min(hi[i] - max(0, ones[i] - common), hi_b[j] - max(0, ones_b[j] - common))
        if most < -(-cfg.percent * int(lo[i] + lo_b[j]) // (100 + cfg.percent)) or 100 * hi[i] < cfg.percent * lo_b[j] or 100 * hi_b[j] < cfg.percent * lo[i]:
            continue
        one = parent[left[a.order[at_a[i]]]]
        if weights is None and (parent[left[a.order[at_a[i] : at_a[i + 1]]]] == one).all() and (parent[right[b.order[at_b[j] : at_b[j + 1]]]] == one).all():
            continue
        if la == 0 and lb == 0:
            leaves(i, j)
            continue
        mine = [(la - 1, k) for k in range(i * cfg.fan, min((i + 1) * cfg.fan, len(a.levels[la - 1][1])))] if la >= lb and la else [(la, i)]
        yours = [(lb - 1, k) for k in range(j * cfg.fan, min((j + 1) * cfg.fan, len(b.levels[lb - 1][1])))] if lb >= la and lb else [(lb, j)]
        stack += [(x, k, y, m) for x, k in mine for y, m in yours if a is not b or (x, k) <= (y, m) or x != y]
    return links, linked


def _block_links(cfg: JoinConfig, pair: bool):
    """Rows (a, b, 0) of a forest of links and, for each class a with links, (a, a, documents linked with)."""

    def run(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side").to_numpy())
        ids = rows.column("cls").to_numpy()
        data = rows.column("hashes").to_pylist()
        # A pivot may be a member too, and rows of a repeated doc_id give a set twice.
        order = np.concatenate([np.flatnonzero(side == x)[np.unique(ids[side == x], return_index=True)[1]] for x in (0, 1)])
        split = int((side[order] == 0).sum()) if pair else None
        weights = rows.column("size").to_numpy()[order] if cfg.every_link else None
        links, linked = tree_links([np.frombuffer(data[i], "<u8") for i in order], ids[order], cfg, split, weights)
        some = np.flatnonzero(linked)
        a, b = ([x[k] for x in links] for k in (0, 1))
        own = ids[order][some].tolist()
        return pa.table({"a": pa.array(a + own, pa.int64()), "b": pa.array(b + own, pa.int64()), "n": pa.array([0] * len(a) + linked[some].tolist(), pa.int64())})

    return run


def _sets(cfg: JoinConfig, twins: dict[int, int]):
    """Sets of rows (cls, text); a text that is not of the class (its doc_id is repeated) is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = [(c, s.astype("<u8").tobytes()) for c, s in zip(part.column("cls").to_pylist(), shingle_sets(part.column("text"), cfg.words), strict=True) if _renamed(*class_names(s, cfg.name_bits), twins) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["cls", "hashes"])

    return run


def _in_play(shared: DataFrame, classes: DataFrame, cfg: JoinConfig, folder: str, name: str) -> DataFrame:
    """Rows (token, cls, n, pivot) of classes that share enough elements with classes of fitting size."""
    met = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("met")).join(classes.select("cls", "n"), "cls")
    least = F.ceil(F.col("n") * cfg.percent / 100)
    kept = met.filter(F.col("met") >= 1 + F.floor(least / cfg.extra)).select("cls", "n")
    left = written(shared.select("token", "cls").join(kept, "cls"), folder, f"{name}-kept")
    pivots = left.groupBy("token").agg(F.min("cls").alias("pivot"), F.max("cls").alias("_last")).filter("pivot <> _last").drop("_last")
    return written(left.join(pivots, "token").select("token", "cls", "n", "pivot"), folder, name)


def twin_classes(docs: DataFrame) -> dict[int, int]:
    """First names that sets with different second names share, each with the least second name.

    Among 10 ** 10 sets about three such names are expected by chance, so what comes to the driver is bounded.
    """
    both = docs.filter("cls is not null").groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b")
    return {r["cls"]: r["a"] for r in both.select("cls", "a").collect()}


def link_components(documents: DataFrame, folder: str, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links of each row of (doc_id, text); ``folder`` takes the stage tables.

    class_id names the set of shingles (null without shingles): rows of one class
    are exact copies. n_links is the number of other rows a row is linked with,
    copies of its class included; it is null without ``every_link``.

    Texts without words and null texts have no shingles, link with nothing and
    are components of their own, as are rows with a null doc_id that link with
    nothing (their component_id is null). Rows that repeat a doc_id are compared
    like others. An empty table gives no rows. Other columns are not read.
    """
    out = labelled(documents, folder, cfg)
    least_id = out.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(least_id, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_id", "n_links")


def labelled(documents: DataFrame, folder: str, cfg: JoinConfig) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component (null without words), class_id, n_links of each row."""
    spark = documents.sparkSession
    # key finds a text again; rows without a doc_id are found by their text.
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).withColumn("key", F.coalesce("doc_id", "text_key"))
    frequent = frequent_shingles(d, cfg)
    docs = written(d.mapInArrow(_digests(cfg), "doc_id long, text_key long, key long, n_shingles long, cls long, check long"), folder, "docs")
    twins = twin_classes(docs)
    if twins:
        rename = F.udf(lambda c, x: None if c is None else _renamed(c, x, twins), "long")
        docs = written(docs.withColumn("cls", rename("cls", "check")), folder, "docs-renamed")
    docs = docs.drop("check")

    # Texts are read a second time for their prefixes: hashing again costs less than prefixes on disk.
    tokens = d.select("text").mapInArrow(_prefixes(cfg, frequent, twins), "cls long, token long").repartition("token").sortWithinPartitions("token", "cls")
    shared = written(tokens.mapInArrow(_shared, "token long, cls long, pivot long"), folder, "shared")

    # Blocks: each class goes to the pivot that it shares most elements with, itself if there is none of fitting size.
    classes = written(docs.filter("cls is not null").groupBy("cls").agg(F.min("key").alias("key"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("size")), folder, "classes")
    for step in range(2):
        shared = _in_play(shared, classes, cfg, folder, f"shared-{step}")
    discard(spark, folder, "shared", "shared-0-kept", "shared-0", "shared-1-kept")
    met = shared.groupBy("cls", "pivot").agg(F.count("*").alias("met"))
    met = met.join(classes.select("cls", "n", "size"), "cls").join(classes.select(F.col("cls").alias("pivot"), F.col("n").alias("pivot_n")), "pivot")
    fits = (100 * F.least("n", "pivot_n") >= cfg.percent * F.greatest("n", "pivot_n")) & (F.col("cls") != F.col("pivot"))
    best = met.groupBy("cls").agg(F.max("n").alias("n"), F.max("size").alias("size"), F.max(F.when(fits, F.struct("met", "pivot"))).alias("best"))
    member = best.select("cls", "n", "size", F.coalesce("best.pivot", "cls").alias("pivot"))
    parts = member.groupBy("pivot").agg(F.greatest(F.ceil(F.sum("n") / cfg.block), F.ceil(F.count(F.lit(1)) / cfg.block_rows)).alias("parts"))
    member = member.join(parts, "pivot").select("cls", "n", "size", "pivot", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"))
    member = written(member, folder, "members")

    # Full sets of the classes in play, each from one document of its class.
    source = member.select("cls").join(classes.select("cls", F.col("key").alias("_key")), "cls")
    texts = d.join(light(source, cfg.light_rows), F.col("key") == F.col("_key")).select("cls", "text")
    sets = written(texts.mapInArrow(_sets(cfg, twins), "cls long, hashes binary"), folder, "sets")

    # Round A: members of a block and, to connect them, its pivot.
    rows = member.select("cls", "size", "pivot", "part")
    if not cfg.every_link:
        rows = rows.unionByName(member.filter("cls <> pivot").select("pivot", "part").distinct().select(F.col("pivot").alias("cls"), F.lit(0).cast("long").alias("size"), "pivot", "part"))
    rows = rows.withColumn("side", F.lit(0)).join(sets, "cls")
    links = written(rows.groupBy("pivot", "part").applyInArrow(_block_links(cfg, False), "a long, b long, n long"), folder, "links-a")

    # Round B: classes that share enough elements with other blocks (or components), then pairs of blocks that share enough.
    block = F.struct("pivot", "part")
    if cfg.every_link:
        m = member.select("cls", "n", "size", block.alias("block"), block.alias("component"))
    else:
        near = components(links.select("a", "b"), f"{folder}/near")
        m = member.join(near, F.col("cls") == F.col("node"), "left").select("cls", "n", "size", block.alias("block"), F.coalesce("component", "cls").alias("component"))
        links = near.select(F.col("node").alias("a"), F.col("component").alias("b"), F.lit(0).cast("long").alias("n"))
    t = shared.select("token", "cls").join(m, "cls")
    least = lambda n: 1 + F.floor(F.ceil(n * cfg.percent / 100) / cfg.extra)
    for step in range(2):
        several = t.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("token")
        t = written(t.join(several, "token"), folder, f"several-{step}")
        enough = t.groupBy("cls").agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("_n")).filter(F.col("met") >= least(F.col("_n"))).select("cls")
        t = written(t.join(enough, "cls", "left_semi"), folder, f"open-{step}")
    side = t.groupBy("token", "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    other = side.select("token", *[F.col(c).alias(f"o_{c}") for c in side.columns[1:]])
    apart = ~((F.col("c0") == F.col("c1")) & (F.col("o_c0") == F.col("o_c1")) & (F.col("c0") == F.col("o_c0")))
    fitting = (100 * F.col("n1") >= cfg.percent * F.col("o_n0")) & (100 * F.col("o_n1") >= cfg.percent * F.col("n0"))
    pairs = side.join(other, "token").filter((F.col("block") < F.col("o_block")) & apart & fitting).groupBy("block", "o_block").agg(F.count(F.lit(1)).alias("met"), F.least(F.min("n0"), F.min("o_n0")).alias("_n"))
    pairs = written(pairs.filter(F.col("met") >= 1 + F.floor(F.col("_n") / cfg.extra)).select("block", "o_block"), folder, "pairs")
    open_members = t.select("cls", "size", "block").distinct()
    first = pairs.join(open_members, "block").select("block", "o_block", "cls", "size", F.lit(0).alias("side"))
    second = pairs.join(open_members.withColumnRenamed("block", "o_block"), "o_block").select("block", "o_block", "cls", "size", F.lit(1).alias("side"))
    rows = first.unionByName(second).join(sets, "cls")
    links_b = written(rows.groupBy("block", "o_block").applyInArrow(_block_links(cfg, True), "a long, b long, n long"), folder, "links-b")
    links = links.unionByName(links_b)
    joined = components(links.select("a", "b"), f"{folder}/joined").withColumnRenamed("node", "cls")
    if cfg.every_link:
        linked = links.filter("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
        found = classes.select("cls", "size").join(joined, "cls", "left").join(linked, "cls", "left")
        n_links = F.when(F.col("cls").isNull(), 0).otherwise(F.col("size") - 1 + F.coalesce("linked", F.lit(0)))
    else:
        found, n_links = joined, F.lit(None)

    out = docs.select("doc_id", "text_key", "n_shingles", "cls").join(found, "cls", "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "cls").alias("component"), F.col("cls").alias("class_id"), n_links.cast("long").alias("n_links"))
    out = written(out, folder, "labelled")
    discard(spark, folder, "sets", "shared-1", "docs", "docs-renamed", "classes", "several-0", "several-1", "open-0", "open-1", "members", "pairs", "links-a", "links-b", "near", "joined")
    return out


def one_of_each(documents: DataFrame, folder: str, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """The rows of ``documents`` without those that are linked, directly or not, with another that stays.

    One row of each component stays: the one of least doc_id (null last), among
    different texts of that doc_id the one of least hash; rows that agree in both
    are copies, of which any stays. Different texts that are not linked all stay,
    whatever their doc_ids, as does each row without words.
    """
    c = labelled(documents, folder, replace(cfg, every_link=False))
    rows = c.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("_rows"))
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_key", "_rows")).alias("m"))
    wordless = rows.filter("component is null").select("doc_id", "text_key", F.lit(1).cast("long").alias("_rows"))
    own = fresh(documents.columns, "near_")
    keep = first.select("m.doc_id", "m.text_key", "m._rows").unionByName(wordless)
    keep = written(keep.select(F.col("doc_id").alias(f"{own}id"), F.col("text_key").alias(f"{own}text"), F.col("_rows").alias(f"{own}rows")), folder, "keep")
    d = documents.withColumns({f"{own}row_id": F.col("doc_id").cast("long"), f"{own}row_text": F.xxhash64("text")})
    here = F.col(f"{own}row_id").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}row_text") == F.col(f"{own}text"))
    found = lambda rows: d.join(light(rows.drop(f"{own}rows"), cfg.light_rows), here, "left_semi")
    out, copies = found(keep.filter(F.col(f"{own}rows") == 1)), keep.filter(F.col(f"{own}rows") > 1)
    if not copies.isEmpty():
        out = out.unionByName(found(copies).dropDuplicates([f"{own}row_id", f"{own}row_text"]))
    return out.drop(f"{own}row_id", f"{own}row_text")
