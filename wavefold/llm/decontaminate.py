"""Benchmark decontamination by q-gram lemma filtering (operator 5).

An item of m characters that occurs in a text with at most k edits shares at
least m + 1 - q * (k + 1) of its q-grams with it, and the diagonals (position in
the text less position in the item) of the alignment lie within k of each other.
So shared q-grams are counted in overlapping bands of 2 * (k + 1) diagonals, one
every k + 1: one band holds the whole alignment. Bands that reach the lemma's
bound are verified by a banded alignment with free ends in the text.

A q-gram that stands at many places of the benchmark (a rule line, a phrase of all
items) is not counted: it says little and could cost its places in the text times
its places in the items. The bound of an item falls by its places of such q-grams.
Where nothing of it is left, positions of the text are counted instead, each once:
at least as many as the lemma asks for hold a q-gram of the item within the length
of its alignment; there the alignment's band is the whole region. So no item is
given up and the work at a position of a text is bounded.

Texts and items are compared in lower case and with white space runs as one space.
Items of fewer than q characters are found where they stand unchanged as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefold.llm.shared import written


@dataclass(frozen=True)
class DecontaminationConfig:
    q: int = 8
    #: Edits allowed, as a share of the item's characters.
    edit_rate: float = 0.1
    #: Benchmark characters that one pass over the texts holds in memory.
    block_chars: int = 2_000_000
    #: Characters of a text examined at once; windows overlap by the longest item and its edits.
    window: int = 1 << 20
    #: Places of the benchmark beyond which a q-gram is not counted, and pairs of places counted at once.
    most_places: int = 16
    most_pairs: int = 1 << 20


_MULTIPLIER, _BASE = 0x9E3779B97F4A7C15, 0x100000001B3


def normal(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Hashes of 1, 2, 4, ... characters, joined to q by its binary digits.
    h, done, block, width = None, 0, codes.astype(np.uint64), 1
    while True:
        if q & width:
            part = block[done : done + n]
            h = part.copy() if h is None else h * np.uint64(pow(_BASE, width, 1 << 64)) + part
            done += width
        if done == q:
            break
        block = block[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + block[width:]
        width *= 2
    h *= np.uint64(_MULTIPLIER)
    return h ^ (h >> np.uint64(29))


def edit_budget(m: int, cfg: DecontaminationConfig) -> int:
    """Edits allowed for an item of m characters: the rate, but few enough that the lemma asks for two q-grams."""
    return max(0, min(int(m * cfg.edit_rate), (m - 1) // cfg.q - 1))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits of ``item`` against a part of ``text`` on diagonals low..high, and where that part ends; None above ``most``.

    Row i holds the cells of text positions i + low .. i + high, so each costs a
    few operations on an array of the band's width.
    """
    width, n, big = high - low + 1, len(text), len(item) + most + 9
    column = np.arange(width)
    j = column + low  # text prefix lengths in row 0
    row = np.where((j >= 0) & (j <= n), 0, big)
    # Text character before each cell of all rows; no character matches outside of the text.
    span = np.arange(low, high + len(item))
    before = np.where((span >= 0) & (span < n), text[np.clip(span, 0, max(n - 1, 0))] if n else 0, -1).astype(np.int64)
    for i in range(1, len(item) + 1):
        new = row + (before[i - 1 : i - 1 + width] != item[i - 1])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        if low + i < 1 or high + i > n:
            j = column + low + i
            new[(j < 0) | (j > n)] = big
            if 0 <= -low - i < width:
                new[-low - i] = i  # no text yet: the item's begin is left out
        row = np.minimum.accumulate(new - column) + column
        if high + i > n:
            row[max(0, n - low - i + 1) :] = big
        if row.min() > most:
            return None
    best = int(np.argmin(row))
    return int(row[best]), int(best + low + len(item))


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Index:
    """q-grams of benchmark items; items of equal text are one entry."""

    def __init__(self, items: list[tuple[int, str]], cfg: DecontaminationConfig):
        self.cfg, texts = cfg, {}
        for i, t in items:
            texts.setdefault(normal(t), []).append(i)
        self.short = {t: ids for t, ids in texts.items() if 0 < len(t) < cfg.q}
        self.texts = [t for t in texts if len(t) >= cfg.q]
        self.ids = [texts[t] for t in self.texts]
        self.codes = [_codes(t) for t in self.texts]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(int(m), cfg) for m in self.length], np.int64)
        need = self.length + 1 - cfg.q * (self.budget + 1)
        grams = [_grams(c, cfg.q) for c in self.codes]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item, at = np.repeat(np.arange(len(grams)), [len(g) for g in grams]), np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        known, back, places = np.unique(h, return_inverse=True, return_counts=True)
        often = places[back] > cfg.most_places
        # What is left of the lemma's bound when frequent q-grams are not counted.
        self.need = need - np.bincount(item[often], minlength=len(grams))
        counted = ~often & (self.need[item] > 0)
        order = np.flatnonzero(counted)[np.argsort(h[counted], kind="stable")]
        self.item, self.at = item[order], at[order].astype(np.int64)
        self.known, self.first = np.unique(h[order], return_index=True)
        self.last = np.r_[self.first[1:], len(order)].astype(np.int64)
        self.bits = max(16, min(26, int(np.ceil(np.log2(16 * max(1, len(known)))))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[known & np.uint64((1 << self.bits) - 1)] = True
        # Items of which nothing is left: their q-grams, and how many positions of how long a span must hold one.
        self.alike = [(i, np.unique(grams[i]), int(need[i])) for i in np.flatnonzero(self.need <= 0).tolist()]
        self.alike_grams = np.unique(np.concatenate([*(g for _, g, _ in self.alike), np.zeros(0, np.uint64)]))
        self.span = int((self.length + self.budget).max(initial=0))

    def _hit(self, i: int, edits: int, end: int, found: dict) -> None:
        found[i] = min(found.get(i, (1 << 60, 0)), (edits, end))

    def _window(self, text: str, codes: np.ndarray, offset: int, found: dict) -> None:
        h = _grams(codes, self.cfg.q)
        pos = np.flatnonzero(self.table[h & np.uint64((1 << self.bits) - 1)])
        if not len(pos):
            return
        if len(self.alike):
            self._alike(text, codes, pos, h[pos], offset, found)
        k = np.searchsorted(self.known, h[pos])
        good = _in(h[pos], self.known)
        self._bands(text, codes, pos[good], k[good], offset, found)

    def _bands(self, text: str, codes: np.ndarray, pos: np.ndarray, k: np.ndarray, offset: int, found: dict) -> None:
        """Counts q-grams in bands of diagonals; where there are too many pairs for once, in two parts that overlap by an alignment."""
        times = self.last[k] - self.first[k]
        total = int(times.sum())
        if not total:
            return
        if total > self.cfg.most_pairs and pos[-1] - pos[0] > 4 * self.span:
            middle = int(pos[0] + pos[-1]) // 2
            for part in (pos <= middle + self.span, pos >= middle):
                self._bands(text, codes, pos[part], k[part], offset, found)
            return
        entry = np.repeat(self.first[k] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(total)
        item, diagonal = self.item[entry], np.repeat(pos, times) - self.at[entry]
        step = self.budget[item] + 1
        band = (diagonal + self.span) // step
        # One band every step diagonals, each two steps wide: a q-gram counts in its band and the one before.
        keys = np.concatenate([item * (1 << 40) + band, item * (1 << 40) + band - 1])
        known, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        full = count >= self.need[known >> 40]
        if not full.any():
            return
        # An alignment keeps each q-gram of the item once: repeats in the text do not count.
        at = np.flatnonzero(full[back])
        pairs = np.unique(back[at] * (1 << 32) + np.tile(self.at[entry], 2)[at])
        band, count = np.unique(pairs >> 32, return_counts=True)
        keys = known[band[count >= self.need[known[band] >> 40]]]
        for key in keys.tolist():
            i = key >> 40
            if found.get(i, (1,))[0] == 0:
                continue
            e, m = int(self.budget[i]), int(self.length[i])
            low = (key & ((1 << 40) - 1)) * (e + 1) - self.span
            high = low + 2 * (e + 1) - 1
            a, b = max(0, low), min(len(codes), high + m)
            part = text[a:b].find(self.texts[i])
            hit = (0, part + m) if part >= 0 else banded_distance(self.codes[i], codes[a:b], low - a, high - a, e)
            if hit is not None and hit[0] <= e:
                self._hit(i, hit[0], offset + a + hit[1], found)

    def _alike(self, text: str, codes: np.ndarray, pos: np.ndarray, h: np.ndarray, offset: int, found: dict) -> None:
        """Items whose q-grams are all frequent: counts positions that hold one of them."""
        mine = _in(h, self.alike_grams)
        pos, h = pos[mine], h[mine]
        for i, grams, need in self.alike:
            if found.get(i, (1,))[0] == 0 or len(pos) < need:
                continue
            at = pos[_in(h, grams)]
            e, m = int(self.budget[i]), int(self.length[i])
            dense = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < m + e) if len(at) >= need else np.zeros(0, np.int64)
            if not len(dense):
                continue
            # Every alignment lies around such a span; spans that touch are one region, cut to a bounded size with overlaps.
            begin, end = np.maximum(at[dense] - m - e, 0), np.minimum(at[dense + need - 1] + m + e + self.cfg.q, len(codes))
            new = np.r_[True, begin[1:] > np.maximum.accumulate(end)[:-1]]
            for a, b in zip(begin[new].tolist(), np.maximum.reduceat(end, np.flatnonzero(new)).tolist(), strict=True):
                part = text[a:b].find(self.texts[i])
                if part >= 0:
                    self._hit(i, 0, offset + a + part + m, found)
                    break
                size = max(1 << 14, 4 * (m + e))
                for x in range(a, b, size):
                    y = min(b, x + size + m + e)
                    if y - x < m - e:  # shorter than any alignment
                        break
                    hit = banded_distance(self.codes[i], codes[x:y], -e, y - x - m + e, e)
                    if hit is not None and hit[0] <= e:
                        self._hit(i, hit[0], offset + x + hit[1], found)

    def _whole_words(self, text: str) -> Iterator[tuple[int, int]]:
        """(item_id, end) of short items that stand unchanged in a text, not inside of a word."""
        for t, ids in self.short.items():
            at = text.find(t)
            while at >= 0:
                end = at + len(t)
                if not (at and text[at].isalnum() and text[at - 1].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum()):
                    yield from ((i, end) for i in ids)
                    break
                at = text.find(t, at + 1)

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, edits, end in the normalised text) of each item found."""
        t, found = normal(text), {}
        out = [(i, 0, end) for i, end in self._whole_words(t)] if self.short else []
        if self.texts:
            codes, step = _codes(t), max(self.cfg.window, 2 * self.span)
            for a in range(0, max(1, len(codes)), step):
                self._window(t[a : a + step + self.span], codes[a : a + step + self.span], a, found)
        return out + [(k, *x) for i, x in sorted(found.items()) for k in self.ids[i]]


def benchmark_blocks(benchmark: DataFrame, cfg: DecontaminationConfig, folder: str) -> Iterator[Index]:
    """Indexes of the benchmark, each of about ``block_chars`` characters, so what is sent to tasks is bounded.

    A benchmark of several blocks is written to ``folder`` by block first, so each is read once.
    """
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0][0]
    n = -(-chars // cfg.block_chars) or 1
    if n > 1:
        path = f"{folder}/benchmark"
        items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
        items = benchmark.sparkSession.read.schema("item_id long, text string, block long").parquet(path)
    for b in range(n):
        rows = (items.filter(F.col("block") == b) if n > 1 else items).select("item_id", "text").collect()
        yield Index(sorted((r[0], r[1]) for r in rows), cfg)


def _found(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d.as_py(), *m) for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for m in index.matches(t.as_py())]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "edits", "match_end"])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, folder: str, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """doc_id, item_id, edits, match_end: benchmark items that documents hold with few edits.

    Each item is reported once a document, with its fewest edits and the end of
    that place in the normalised text. Null or empty texts hold nothing; null and
    empty items take no part. Rows with a null or repeated doc_id are examined like
    others; a repeated item_id is reported for each of its texts. Empty tables give
    no rows. Documents stay where they are: no shuffle. A benchmark of several
    blocks takes a pass over the documents for each, whose rows go to ``folder``.
    """
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    find = lambda index: d.mapInArrow(_found(index), "doc_id long, item_id long, edits long, match_end long")
    blocks = benchmark_blocks(benchmark, cfg, folder)
    index, following = next(blocks), next(blocks, None)
    if following is None:
        return find(index)
    n = 0
    while index is not None:
        find(index).write.parquet(f"{folder}/leaks/block={n}")
        index, following, n = following, next(blocks, None), n + 1
    return d.sparkSession.read.schema("doc_id long, item_id long, edits long, match_end long").parquet(f"{folder}/leaks").drop("block")


def holds_leak(text: Column, index: Index) -> Column:
    @F.arrow_udf("boolean")
    def leak(texts: pa.Array) -> pa.Array:
        return pa.array([bool(index.matches(t.as_py())) for t in texts], pa.bool_())

    return leak(text)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, folder: str, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The rows of ``documents`` whose text holds no benchmark item; what a block of the benchmark leaves goes to ``folder`` before the next."""
    blocks = benchmark_blocks(benchmark, cfg, folder)
    index, n = next(blocks), 0
    while True:
        documents, index = documents.filter(~holds_leak(F.col("text"), index)), next(blocks, None)
        if index is None:
            return documents
        documents, n = written(documents, folder, f"clean-{n}"), n + 1
