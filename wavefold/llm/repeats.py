"""Removal of long repeated passages by prefix-free parsing (operator 13).

Bytes that lie in a string of ``length`` bytes which also starts in a document
with a smaller id are removed.

* Triggers. The rolling hash of ``window`` bytes is computed at every byte. The
  trigger of a string is the least hash among the windows inside of it, so equal strings have equal
  triggers at equal places. Neighbouring strings with one trigger form a phrase, and the phrases of a
  document are its parse. A phrase whose trigger stands in no other document
  shares no string with one; a sort of the triggers by ranges leaves the other phrases.
* Dictionary. Phrases with the same bytes are one entry, and a copy needs no look at its strings:
  all of a phrase that stands in a smaller document is removed. Only the first document of
  an entry can keep some, and only if its trigger has several entries.
* Corpus order. All strings of a phrase hold its trigger. What stands left of it is a suffix of the
  dictionary, what stands right of it is what the parse goes on with. Both are sorted into suffix
  arrays with common lengths. A string with j bytes left of its trigger is the pair of its class of j bytes
  in one array and of the remaining bytes in the other: equal pairs are equal strings, neighbours in corpus order, and
  the least document of a pair is found without writing out the strings.

The phrases are dealt out by ranges of (trigger, phrase, document), so that no
trigger, phrase or copied document is bound to one task. Triggers that reach over the
ends of a range, or have more than ``group`` phrases there, keep one row an entry and range open. Those are gathered
by trigger and ordered as well, or, beyond ``group`` entries, met by joins on strings that Spark splits.
"""

from __future__ import annotations

import functools
import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefold.llm.shared import discard, written
from wavefold.llm.words import mix64


@dataclass(frozen=True)
class RepeatConfig:
    #: Bytes of the strings that count, and of a trigger; 62 offsets (length - window) at most.
    length: int = 50
    window: int = 20
    #: UTF-8 bytes that are parsed at once; a longer text is parsed in parts that overlap by a string.
    piece: int = 1 << 15
    #: Phrases of one trigger that a task orders; beyond, they are met by joins.
    group: int = 200_000
    #: Parts by trigger in which phrases are sorted one after the other, so that a part of them is in a shuffle at a time.
    parts: int = 4

    @property
    def reach(self) -> int:
        """Bytes that a string can have left or right of its trigger."""
        return self.length - self.window


_PLACE = np.uint64((1 << 28) - 1)
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2 ** 64."""
    out = []
    for f in (factor, pow(factor, -1, 1 << 64)):
        p = np.full(n, f, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _sums(data: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes times powers of the factor, and the powers of its inverse: the hash of any range takes one step."""
    up, down = _powers(factor, 1 << max(10, int(len(data)).bit_length()))
    return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])], down


def _least(key: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values: of 2, 4, 8 ..., then of two overlapping runs."""
    run = 1
    while 2 * run <= n:
        key, run = np.minimum(key[:-run], key[run:]), 2 * run
    return np.minimum(key[: len(key) - (n - run)], key[n - run :]) if run < n else key


def _mixed(x: np.ndarray) -> np.ndarray:
    """Brings the low bits of sums of powers, which depend on few bytes, under the high ones."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x


class Parse:
    """The phrases of texts that lie one after the other: first and last start of a string, trigger and its hash."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, cfg: RepeatConfig):
        self.data, self.cfg = data, cfg
        self.first = self.last = self.trigger = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        n, length, window = len(data), cfg.length, cfg.window
        if n < length:
            return
        with np.errstate(over="ignore"):
            sums, down = _sums(data, _FACTORS[0])
            h = _mixed((sums[window:] - sums[:-window]) * down[: n - window + 1])
            trigger = (_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), cfg.reach + 1) & _PLACE).astype(np.int64)
        inside = np.zeros(len(trigger) + 1, np.int64)  # strings that do not end in another text
        whole = np.flatnonzero(np.diff(edges) >= length)
        np.add.at(inside, edges[whole], 1)
        np.add.at(inside, edges[whole + 1] - length + 1, -1)
        good = np.cumsum(inside[:-1]) > 0
        ends = trigger[1:] != trigger[:-1]
        ends |= good[1:] != good[:-1]
        ends = np.r_[-1, np.flatnonzero(ends), len(good) - 1]
        first, last = ends[:-1] + 1, ends[1:]
        has = good[first]
        self.first, self.last = first[has], last[has]
        self.trigger = trigger[self.first]
        self.hashes = h[self.trigger]

    def names(self, at: np.ndarray) -> np.ndarray:
        """Hashes of all bytes of phrases."""
        with np.errstate(over="ignore"):
            sums, down = _sums(self.data, _FACTORS[1])
            first, end = self.first[at], self.last[at] + self.cfg.length
            return mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """The bytes left of the triggers and those right of them; bytes that no string of the phrase reaches are 0."""
        reach, window = self.cfg.reach, self.cfg.window
        near = np.r_[np.arange(-reach, 0), np.arange(window, window + reach)]
        padded = np.concatenate([np.zeros(reach, np.uint8), self.data, np.zeros(reach, np.uint8)])
        out = padded[self.trigger[at][:, None] + (near + reach)[None, :]]
        left, right = self.trigger[at] - self.first[at], reach - self.trigger[at] + self.last[at]
        out[np.r_[np.arange(reach, 0, -1), np.full(reach, -1)] > left[:, None]] = 0
        out[np.r_[np.full(reach, -1), np.arange(reach)] >= right[:, None]] = 0
        return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def parsed(column: pa.Array, cfg: RepeatConfig) -> Iterator[tuple[np.ndarray, np.ndarray, Parse]]:
    """(row of each phrase, where its text begins before the parsed piece, Parse), piece by piece."""
    data, offsets = _texts(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + cfg.piece, side="right")) - 1)
        edges = offsets[at : end + 1] - offsets[at]
        if edges[-1] <= cfg.piece:
            p = Parse(data[offsets[at] : offsets[end]], edges, cfg)
            row = np.searchsorted(edges, p.first, side="right") - 1
            yield at + row, -edges[row], p
        else:  # one long text
            for start in range(0, int(edges[-1]), cfg.piece):
                part = data[offsets[at] + start : min(offsets[at] + start + cfg.piece + cfg.length - 1, offsets[end])]
                p = Parse(part, np.array([0, len(part)]), cfg)
                yield np.full(len(p.first), at), np.full(len(p.first), start), p
        at = end


def _triggers(cfg: RepeatConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows of the task that were parsed; equal ones give nothing new
        for batch in batches:
            keys = batch.column("key").to_pylist()
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            batch = batch.take(pa.array(new, pa.int64()))
            key = batch.column("key").to_numpy()
            for row, _, p in parsed(batch.column("text"), cfg):
                yield pa.RecordBatch.from_arrays([pa.array(p.hashes.view(np.int64)), pa.array(key[row])], names=["trigger", "key"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (trigger, key) in order: the rows of triggers with several keys, and of the first and last trigger, which may go on elsewhere."""
    held_t, held_k, open_at = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # the last row, if alone so far
    out = lambda t, k: pa.RecordBatch.from_arrays([pa.array(t), pa.array(k)], names=["trigger", "key"])
    for batch in batches:
        if not batch.num_rows:
            continue
        t, k = np.concatenate([held_t, batch.column("trigger").to_numpy()]), np.concatenate([held_k, batch.column("key").to_numpy()])
        if open_at is None:
            open_at = t[0]
        new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]
        t, k = t[new], k[new]
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[begin, len(t)])
        keep = np.repeat(size > 1, size) | (t == open_at)
        alone = not keep[-1]
        if not alone:
            open_at = t[-1]
        held_t, held_k = (t[-1:], k[-1:]) if alone else (t[:0], k[:0])
        yield out(t[keep], k[keep])
    if len(held_t):
        yield out(held_t, held_k)


_PHRASE = "trigger long, phrase long, id long, key long, place long, low int, high int, context binary"


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one length as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    start = offsets[column.offset] if len(column) else 0
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[start : start + len(column) * width].reshape(-1, width)


def _phrases(cfg: RepeatConfig):
    names = [c.split()[0] for c in _PHRASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A trigger that repeats is wanted in every text that has it.
            wanted = np.unique(batch.column("triggers").flatten().to_numpy())
            ids, key = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            for row, shift, p in parsed(batch.column("text"), cfg):
                t = p.hashes.view(np.int64)
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, t), len(wanted) - 1)] == t)
                low, high = p.trigger[at] - p.last[at], p.trigger[at] - p.first[at]
                columns = [t[at], p.names(at).view(np.int64), ids[row[at]], key[row[at]], p.trigger[at] + shift[at], low.astype(np.int32), high.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _fixed(p.contexts(at))], names=names)

    return run


def _suffixes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row in the order of (group, bytes), and how many bytes each place has in common with the one before (-1: another group)."""
    packed = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    packed[:, : rows.shape[1]] = rows
    order = np.lexsort([*packed.view(">u8").T[::-1], group])
    ordered, g = rows[order], group[order]
    common = np.logical_and.accumulate(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)
    common = np.r_[-1, np.where(g[1:] == g[:-1], common, -1)]
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    return place, common


def repeated_offsets(group: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: np.ndarray, cfg: RepeatConfig) -> np.ndarray:
    """For each dictionary entry the offsets (as bits) whose string is in an entry of the group with a smaller first document."""
    reach, bits = cfg.reach, np.zeros(len(group), np.int64)
    (left, left_common), (right, right_common) = _suffixes(contexts[:, :reach][:, ::-1], group), _suffixes(contexts[:, reach:], group)
    for j in range(reach + 1):
        has = np.flatnonzero((low <= j) & (j <= high))
        if len(has) < 2:
            continue
        both = np.cumsum(left_common < j)[left[has]] * (len(group) + 1) + np.cumsum(right_common < reach - j)[right[has]]
        order = np.argsort(both)
        begin = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0])
        least = np.minimum.reduceat(first[has[order]], begin)
        least = np.repeat(least, np.diff(np.r_[begin, len(has)]))
        at = has[order]
        bits[at] |= (least < first[at]).astype(np.int64) << j
    return bits


class _Held:
    """Columns of phrases of whole triggers, and which of them are to be removed."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.columns = [batch.column(c).to_numpy() for c in ("trigger", "phrase", "id", "key", "place", "low", "high")] + [_rows_of(batch.column("context"), width)]

    def after(self, other: _Held | None) -> _Held:
        if other is not None:
            self.columns = [np.concatenate([x, y]) for x, y in zip(other.columns, self.columns, strict=True)]
        return self

    def part(self, at: slice | np.ndarray) -> _Held:
        out = object.__new__(_Held)
        out.columns = [c[at] for c in self.columns]
        return out

    def copies(self) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have the phrase of a smaller document before them, and the bits of all offsets of each row."""
        trigger, phrase, ids, _, _, low, high, _ = self.columns
        entry = np.r_[True, (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])]
        first = ids[np.flatnonzero(entry)][np.cumsum(entry) - 1]  # rows of an entry ascend by document
        return ids > first, (np.int64(2) << high.astype(np.int64)) - (np.int64(1) << low.astype(np.int64))

    def removals(self, cfg: RepeatConfig) -> tuple[np.ndarray, np.ndarray]:
        """Rows with something to remove, and the bits of their offsets."""
        trigger, phrase, ids, _, _, low, high, context = self.columns
        entry = np.r_[True, (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])]
        begin, of = np.flatnonzero(entry), np.cumsum(entry) - 1
        first, (later, every) = ids[begin], self.copies()
        group = np.cumsum(np.r_[True, np.diff(trigger[begin]) != 0]) - 1
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        bits = np.zeros(len(begin), np.int64)
        at = begin[several]
        if len(several):
            bits[several] = repeated_offsets(group[several], first[several], low[at], high[at], context[at], cfg)
        removed = np.where(later, every, bits[of] & every)
        rows = np.flatnonzero(removed)
        return rows, removed[rows]


def _ordered(cfg: RepeatConfig):
    names = [c.split()[0] for c in _PHRASE.split(", ")] + ["bits"]

    def opened(h: _Held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, h.columns[:-1]), _fixed(h.columns[-1]), pa.nulls(len(h.columns[0]), pa.int64())], names=names)

    def parted(h: _Held) -> Iterator[pa.RecordBatch]:
        """Rows of an open trigger: what has its phrase in a smaller document here is removed as a whole, the rest stays open."""
        later, every = h.copies()
        yield closed(h, np.flatnonzero(later), every[later])
        yield opened(h.part(~later))

    def closed(h: _Held, rows: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        x = [pa.array(c[rows]) for c in h.columns[:-1]]
        return pa.RecordBatch.from_arrays([*x, pa.nulls(len(rows), pa.binary()), pa.array(bits)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to be removed with their bits; without bits all rows of the first and last trigger and of those with too many."""
        held, open_at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = _Held(batch, 2 * cfg.reach).after(held)
            t = h.columns[0]
            if open_at is None:
                open_at = t[0]
            begin, last = int(np.count_nonzero(t == open_at)), int(np.flatnonzero(np.r_[True, t[1:] != t[:-1]])[-1])
            if begin:
                yield from parted(h.part(slice(0, begin)))
            if last > begin:
                whole = h.part(slice(begin, last))
                yield closed(whole, *whole.removals(cfg))
            held = h.part(slice(max(begin, last), None))
            if len(held.columns[0]) > cfg.group:
                yield from parted(held)
                held, open_at = None, t[-1]
        if held is not None and len(held.columns[0]):
            yield from parted(held)

    return run


def _met_here(cfg: RepeatConfig):
    columns = ("trigger", "phrase", "first", "low", "high")

    def marks(rows: pa.Table) -> pa.RecordBatch:
        t, phrase, first, low, high = (rows.column(c).to_numpy() for c in columns)
        group = np.cumsum(np.r_[True, t[1:] != t[:-1]]) - 1
        bits = repeated_offsets(group, first, low, high, _rows_of(rows.column("context").combine_chunks(), 2 * cfg.reach), cfg)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(phrase), pa.array(bits)], names=["trigger", "phrase", "some"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The offsets of entries, by triggers in order; a trigger's entries are in one task and at most ``cfg.group``."""
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows])
                t = rows.column("trigger").to_numpy()
                last = int(np.flatnonzero(np.r_[True, t[1:] != t[:-1]])[-1])
                if last:
                    yield marks(rows.slice(0, last))
                held = rows.slice(last)
        if held is not None:
            yield marks(held)

    return run


def met(opened: DataFrame, folder: str, cfg: RepeatConfig) -> DataFrame:
    """key, place, bits of rows whose triggers are not in one task.

    Their dictionary entries are gathered by trigger and ordered like the others, but for those of triggers with more
    than ``cfg.group`` entries: their strings meet by joins, of which Spark splits the large parts.
    """
    own = ("low", "high", "context")
    entries = written(opened.groupBy("trigger", "phrase").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in own]), folder, "entries")
    large = entries.groupBy("trigger").agg(F.count("*").alias("n")).filter(F.col("n") > cfg.group).select("trigger")
    small = entries.join(large, "trigger", "left_anti").select("trigger", "phrase", "first", *own)
    here = small.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_met_here(cfg), "trigger long, phrase long, some long")
    each = entries.join(large, "trigger", "left_semi")
    each = each.withColumn("j", F.explode(F.sequence("low", "high"))).withColumn("string", F.expr(f"substring(context, {cfg.reach + 1} - j, {cfg.reach})"))
    each = each.select("trigger", "phrase", "first", "j", "string")
    least = each.groupBy("trigger", "j", "string").agg(F.min("first").alias("least"))
    hits = each.join(least, ["trigger", "j", "string"]).filter("least < first").groupBy("trigger", "phrase").agg(F.expr("bit_or(shiftleft(1L, j))").alias("some"))
    marks = entries.select("trigger", "phrase", "first").join(here.unionByName(hits), ["trigger", "phrase"], "left")
    every = F.expr("shiftleft(2L, high) - shiftleft(1L, low)")
    bits = F.when(F.col("id") > F.col("first"), every).otherwise(F.coalesce("some", F.lit(0)).bitwiseAND(every))
    return opened.join(marks, ["trigger", "phrase"]).select("key", "place", bits.alias("bits")).filter("bits <> 0")


def _cover(places: np.ndarray, bits: np.ndarray, size: int, cfg: RepeatConfig) -> np.ndarray:
    """Which bytes of a text lie in a removed string."""
    row, j = np.nonzero((bits[:, None] >> np.arange(cfg.reach + 1)) & 1)
    starts = places[row] - j
    change = np.bincount(starts, minlength=size + 1) - np.bincount(starts + cfg.length, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(cfg: RepeatConfig):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            doc_id, strings = batch.column("doc_id"), batch.column("strings")
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(strings), 0).to_numpy(zero_copy_only=False))]
            places, bits = (strings.flatten().field(i).to_numpy() for i in (0, 1))
            for at in range(0, batch.num_rows, 256):
                part = range(at, min(at + 256, batch.num_rows))
                out = []
                for i in part:
                    text = data[offsets[i] : offsets[i + 1]]
                    if ends[i] == ends[i + 1]:
                        out.append((len(text), 0, [], text.tobytes()))
                        continue
                    gone = _cover(places[ends[i] : ends[i + 1]], bits[ends[i] : ends[i + 1]], len(text), cfg)
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                    out.append((len(text), int(gone.sum()), [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)], text[~gone].tobytes()))
                n, removed, spans, kept = zip(*out, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(list(map(len, spans)), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([doc_id[part.start : part.stop], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def _settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so once neither Python nor its driver holds what stands for them."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _wanted(texts: DataFrame, folder: str, cfg: RepeatConfig) -> DataFrame:
    """key and the triggers of its text that other texts have too."""
    by, pair = ["trigger", "key"], "trigger long, key long"
    found = texts.select("text", "key").mapInArrow(_triggers(cfg), pair).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_repeated, pair)
    return written(found.groupBy("key").agg(F.collect_list("trigger").alias("triggers")), folder, "wanted")


def _parts(texts: DataFrame, wanted: DataFrame, folder: str, cfg: RepeatConfig) -> DataFrame:
    """The phrases of wanted triggers, in folders by part; rows that agree in doc_id and text are parsed once."""
    once = texts.groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text")).join(wanted, "key")
    phrases = once.mapInArrow(_phrases(cfg), _PHRASE).withColumn("part", F.pmod("trigger", F.lit(cfg.parts)))
    phrases.write.partitionBy("part").option("compression", "zstd").parquet(f"{folder}/phrases")
    return texts.sparkSession.read.schema(f"{_PHRASE}, part int").parquet(f"{folder}/phrases")


def _marked(phrases: DataFrame, n: int, folder: str, cfg: RepeatConfig) -> DataFrame:
    by = ["trigger", "phrase", "id", "key", "place"]
    some = phrases.filter(F.col("part") == n).drop("part").repartitionByRange(*by).sortWithinPartitions(*by)
    return written(some.mapInArrow(_ordered(cfg), _PHRASE + ", bits long"), folder, f"marked-{n}")


def _strings(marked: DataFrame, folder: str, cfg: RepeatConfig) -> DataFrame:
    """key and what is removed from its text: places of triggers and the offsets of strings before them."""
    removed = marked.filter("bits is not null").select("key", "place", "bits").unionByName(met(marked.filter("bits is null").drop("bits"), folder, cfg))
    return written(removed.groupBy("key").agg(F.collect_list(F.struct("place", "bits")).alias("strings")), folder, "strings")


def remove_repeats(documents: DataFrame, folder: str, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """doc_id (as long), n_bytes, n_removed, n_spans, spans and kept (the remaining bytes) of each row of (doc_id, text).

    Null text is empty. A null doc_id is smaller than all others. Rows with the same doc_id take nothing from each other; rows that
    agree in doc_id and text get the same result. Strings never reach over the end of a text, and what is removed is judged on the
    input. Spans are maximal and in bytes; ``kept`` need not be valid UTF-8. Other columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    d = d.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    long = d.filter(F.octet_length("text") >= cfg.length)
    wanted = _wanted(long, folder, cfg)
    _settled(spark)
    phrases = _parts(long, wanted, folder, cfg)
    discard(spark, folder, "wanted")
    marked = []
    for n in range(cfg.parts):
        _settled(spark)
        marked.append(_marked(phrases, n, folder, cfg))
        discard(spark, folder, f"phrases/part={n}")
    _settled(spark)
    strings = _strings(functools.reduce(DataFrame.unionByName, marked), folder, cfg)
    discard(spark, folder, "phrases", "entries", *[f"marked-{n}" for n in range(cfg.parts)])
    _settled(spark)
    return d.select("doc_id", "text", "key").join(strings, "key", "left").select("doc_id", "text", "strings").mapInArrow(_remove(cfg), _KEPT)
