"""Alignment of the tokens of two tokenizers (operator 12).

Both tokenizers encode the whole text with a space before it. Where a token of
either begins at the same byte and both tokens begin with a space, all tokens before
end at a shared byte: such verified anchors cut a document into windows of
token ids. Windows repeat, so the alignment of a window is computed once a worker and
remembered by its two tuples of ids: groups of tokens between shared ends, and the
pairs of ids that share a group. How many documents hold a pair is counted over
the corpus, and every document gets the sums of its pairs' counts.

Pairs are joined with their counts in two parts: frequent pairs, of which there are at most
``light_pairs``, are broadcast, so no frequent pair is a hot key; the rare ones are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.shared import written
from wavefold.llm.token_count import _BYTE_LETTERS, cuts_before_spaces, pieces
from wavefold.llm.words import mix64


@dataclass(frozen=True)
class AlignConfig:
    #: A byte-level tokenizers file and a sentencepiece model that puts a space before the text.
    first: str = ""
    second: str = ""
    #: Pieces and windows that a worker remembers at most, and ids of either kind in all.
    pieces: int = 400_000
    windows: int = 150_000
    ids: int = 3_000_000
    #: UTF-8 bytes of texts that are aligned at once; a longer text comes alone.
    block: int = 1 << 20
    #: Pairs of ids whose counts are broadcast.
    light_pairs: int = 1_000_000


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
_CUT = re.compile(r"(?<=\S)(?= )")


def _gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of ``rows`` of a ragged array lie, and how many each row has."""
    n = offsets[rows + 1] - offsets[rows]
    return np.repeat(offsets[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()), n


class Ragged:
    """Rows of whole numbers of any length, appended in blocks."""

    def __init__(self, kind: type = np.int32):
        self.flat, self.offsets = np.zeros(0, kind), np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = _gather(self.offsets, rows)
        return self.flat[at].astype(np.int64), n


class Codec:
    """The two libraries, what bytes their ids stand for, and the pieces that were encoded before.

    A piece begins with a space that follows a character other than white space, or is a text's
    begin. Neither library joins a piece with the one before (checked for the vocabularies; others get
    whole texts), so the ids of the pieces are the ids of the text.
    """

    def __init__(self, cfg: AlignConfig):
        import sentencepiece
        from tokenizers import Tokenizer

        self.cfg = cfg
        self.a = Tokenizer.from_file(cfg.first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=cfg.second)
        letters = {chr(_BYTE_LETTERS.get(x, x)): x for x in range(256)}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        marks = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(marks)]
        self.lengths = [np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b)]
        self.spaced = [np.array([x[:1] == b" " for x in y], bool) for y in (self.bytes_a, self.bytes_b)]
        #: A pair is first id * second + second id inside of a worker, which is below both.
        self.second, self.both = len(marks), len(marks) * len(self.bytes_a)
        self.cuts = cuts_before_spaces(self.a) and not any("▁" in p.lstrip("▁") for p in marks)
        self.latin = self._by_ranks() if self.cuts else None
        self.forget()

    def _by_ranks(self):
        """The same ids by a faster library for Latin letters, where merges come in the order of ids; None where they do not."""
        import tiktoken

        model = json.loads(self.a.to_str())["model"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        single = {self.bytes_a[i]: i for i in model["vocab"].values() if len(self.bytes_a[i]) == 1}
        if ids != sorted(set(ids)) or len(single) < 256 or len(single) + len(ids) != len(model["vocab"]) or max(single.values()) > ids[0] or model.get("ignore_merges") or model.get("dropout"):
            return None
        ranks = single | {self.bytes_a[i]: i for i in ids}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: what the byte-level pre-tokenizer takes as words
        return tiktoken.Encoding("ranks", pat_str=words, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.known = (Ragged(), Ragged())
        self.same, self.used = np.zeros(0, bool), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keeps the pieces that were looked up most often, half of the limit at most."""
        least = 2
        while (self.used >= least).sum() > self.cfg.pieces // 2 or self.known[0].flat.nbytes and self.known[0].take(np.flatnonzero(self.used >= least))[1].sum() > self.cfg.ids // 2:
            least *= 2
        keep = np.flatnonzero(self.used >= least)
        known = (Ragged(), Ragged())
        for new, old in zip(known, self.known, strict=True):
            new.append(*old.take(keep))
        place = np.full(len(self.used), -1)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        self.rows = {p: place[r] for p, r in self.rows.items() if place[r] >= 0}
        self.known, self.same, self.used = known, self.same[keep], np.ones(len(keep), np.int64)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a space and the text, each without its first space."""
        if not self.cuts:
            return [text]
        p = pieces(text)
        return p if p is not None else [x[1:] for x in _CUT.split(" " + text)]

    def learn(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.rows))
        if len(self.rows) + len(new) > self.cfg.pieces or max(len(k.flat) for k in self.known) > self.cfg.ids:
            self.trim()
            new = list(wanted.difference(self.rows))
        if not new:
            return
        a = [self.latin(" " + x) if self.latin and (x.isascii() or max(x) < "\u0250") else None for x in new]
        rest = [i for i, ids in enumerate(a) if ids is None]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for i, e in zip(part, self.a.encode_batch_fast([" " + new[i] for i in part], add_special_tokens=False), strict=True):
                a[i] = e.ids
        b = self.b.encode(new, num_threads=1)
        if "" in wanted and "" in new:  # the library gives no token for it, but the text goes on with a space
            b[new.index("")] = [self.b.piece_to_id("▁")]
        flat = []
        for known, ids in zip(self.known, (a, b), strict=True):
            flat.append((np.array(list(chain.from_iterable(ids)), np.int64), np.array(list(map(len, ids)), np.int64)))
            known.append(*flat[-1])
        self.same = np.concatenate([self.same, self._same(new, flat)])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))

    def _same(self, new: list[str], flat: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which pieces have the bytes of their tokens of either kind."""
        texts = [(" " + x).encode() for x in new]
        whole, size = b"".join(texts), np.array(list(map(len, texts)), np.int64)
        same = np.ones(len(new), bool)
        for (ids, n), names, length in zip(flat, (self.bytes_a, self.bytes_b), self.lengths, strict=True):
            ends = np.cumsum(n)
            total = np.r_[0, np.cumsum(length[ids])]
            alike = total[ends] - total[ends - n] == size
            if not alike.all() or b"".join(map(names.__getitem__, ids.tolist())) != whole:
                x = ids.tolist()
                alike = np.array([b"".join(map(names.__getitem__, x[e - k : e])) == t for e, k, t in zip(ends.tolist(), n.tolist(), texts, strict=True)], bool)
            same &= alike
        return same

    def encode(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens, the ids of both kinds in a row, and how many each of these texts has."""
        cut = {i: self.pieces(t) for i, t in enumerate(texts) if t}
        self.learn(set().union(*cut.values()))
        rows = {i: np.fromiter(map(self.rows.__getitem__, p), np.int64, len(p)) for i, p in cut.items()}
        good = [i for i, r in rows.items() if self.same[r].all() or self._joined(texts[i], r)]
        flat = np.concatenate([rows[i] for i in good]) if good else np.zeros(0, np.int64)
        self.used += np.bincount(flat, minlength=len(self.used))
        starts = np.r_[0, np.cumsum([len(rows[i]) for i in good])[:-1]].astype(np.int64)
        ids, counts = [], []
        for known in self.known:
            x, n = known.take(flat)
            ids.append(x)
            counts.append(np.add.reduceat(n, starts) if good else np.zeros(0, np.int64))
        return good, ids, counts

    def _joined(self, text: str, rows: np.ndarray) -> bool:
        """Whether the bytes of both kinds' tokens are those of a space and the text."""
        whole = (" " + text).encode()
        return all(b"".join(map(names.__getitem__, known.take(rows)[0].tolist())) == whole for known, names in zip(self.known, (self.bytes_a, self.bytes_b), strict=True))


def _ends(lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


class Aligner:
    """Alignments of windows, remembered by their tuples of ids.

    A window is looked up by a hash, then its ids are compared with the remembered ones.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        strings = [np.array(list(map(str, range(max(map(len, codec.lengths))))), object) + end for end in ("", ",", "|", ";")]
        self.strings = np.concatenate(strings)
        self.step = len(strings[0])
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.texts: list[str] = []
        self.groups, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = (Ragged(), Ragged())
        self.pairs, self.times = Ragged(np.int64), Ragged(np.int64)

    def learn(self, names: list[int], windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of windows, which are given by their hashes and, for either kind, all ids in a row and the number of each."""
        cfg, count = self.codec.cfg, len(names)
        if len(self.texts) > cfg.windows or max(len(x.flat) for x in (self.pairs, *self.ids)) > cfg.ids:
            self.forget()
        row = np.fromiter((self.rows.get(x, -1) for x in names), np.int64, count)
        known = np.flatnonzero(row >= 0)
        parts = [(ids, np.r_[0, np.cumsum(n)]) for ids, n in windows]
        good = np.ones(len(known), bool)
        for kept, (ids, offsets) in zip(self.ids, parts, strict=True):
            at, n = _gather(offsets, known)
            was, m = kept.take(row[known])
            if not np.array_equal(n, m) or not np.array_equal(ids[at], was):
                pairs = zip(np.split(ids[at], np.cumsum(n)[:-1]), np.split(was, np.cumsum(m)[:-1]), strict=True)
                good &= np.array([np.array_equal(x, y) for x, y in pairs], bool)
        row[known[~good]] = -1  # another window of the same hash
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.texts) + np.arange(len(new))
            self.rows.update(zip([names[i] for i in new.tolist()], row[new].tolist(), strict=True))
            self._align([(ids[at], n) for (ids, offsets) in parts for at, n in [_gather(offsets, new)]], len(new))
        return row

    def _align(self, windows: list[tuple[np.ndarray, np.ndarray]], count: int) -> None:
        for kept, (ids, n) in zip(self.ids, windows, strict=True):
            kept.append(ids, n)
        (a, na), (b, nb) = windows
        ends = [_ends(length, x) for length, x in zip(self.codec.lengths, (a, b), strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)
        # The group of a token is the first shared end that is not before its own.
        ga, gb = (np.searchsorted(shared, e) for e in ends)
        ba, bb = (np.searchsorted(g, np.arange(len(shared) + 1)) for g in (ga, gb))
        last = ga[np.cumsum(na) - 1]  # the last group of each window
        self.groups = np.concatenate([self.groups, np.diff(np.r_[-1, last])])
        # Ids in order of groups, first kind before second; what follows each: nothing, comma, bar or semicolon.
        tokens = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.full(len(a), 1), np.full(len(b), 1)
        mark_a[ba[1:] - 1], mark_b[bb[1:] - 1] = 2, 3
        mark_b[np.cumsum(nb) - 1] = 0
        tokens[np.arange(len(a)) + bb[ga]] = a + mark_a * self.step
        tokens[np.arange(len(b)) + ba[gb + 1]] = b + mark_b * self.step
        words, cut = self.strings[tokens].tolist(), np.cumsum(na + nb).tolist()
        self.texts += ["".join(words[s:e]) for s, e in zip([0, *cut[:-1]], cut, strict=True)]
        # Every token of the first kind with all of the second in its group.
        at, many = _gather(bb, ga)
        window = np.repeat(np.repeat(np.arange(count), na), many)
        pair = np.repeat(a, many) * self.codec.second + b[at]
        self.links = np.concatenate([self.links, np.bincount(window, minlength=count)])
        window, pair, times = _counted(window, pair, None, self.codec.both)
        per = np.bincount(window, minlength=count)
        self.pairs.append(pair, per)
        self.times.append(times, per)


def _counted(key: np.ndarray, value: np.ndarray, times: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value) in order with the sum of ``times`` (None: one each); values are below ``limit``."""
    both = key * limit + value
    if times is None:
        both, times = np.unique(both, return_counts=True)
    elif len(both):
        order = np.argsort(both)
        both = both[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        both, times = both[first], np.add.reduceat(times[order], first)
    return both // limit, both % limit, times


def _windows(codec: Codec, ids: list[np.ndarray]) -> list[np.ndarray]:
    """Where windows begin in either row of ids: tokens that begin at the same byte and with a space."""
    starts = [_ends(length, x) - length[x] for length, x in zip(codec.lengths, ids, strict=True)]
    marked = np.zeros(int(starts[0][-1]) + 1, bool)
    marked[starts[0][codec.spaced[0][ids[0]]]] = True
    b = codec.spaced[1][ids[1]] & (starts[1] < len(marked))
    b[b] = marked[starts[1][b]]
    at = np.flatnonzero(b)
    return [np.searchsorted(starts[0], starts[1][at]), at]


def _distinct(ids: list[np.ndarray], begins: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Hashes of the kinds of windows, one window of each and the kind of every window; classes of a hash are compared id by id."""
    total, sizes, ranks = np.zeros(len(begins[0]), np.uint64), [], []
    with np.errstate(over="ignore"):
        for x, at in zip(ids, begins, strict=True):
            n = np.diff(np.r_[at, len(x)])
            place = np.arange(len(x)) - np.repeat(at, n)
            h = mix64(x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            total = mix64(total * np.uint64(0xC2B2AE3D27D4EB4F) + np.add.reduceat(h, at))
            sizes.append(n)
            ranks.append(place)
    _, first, kind = np.unique(total, return_index=True, return_inverse=True)
    rep = first[kind]
    alike = all((n == n[rep]).all() and (x == x[np.repeat(at[rep], n) + p]).all() for x, at, n, p in zip(ids, begins, sizes, ranks, strict=True))
    if not alike:
        first = kind = np.arange(len(rep))
    return total[first].tolist(), first, kind


def align_texts(aligner: Aligner, texts: list[str]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups, pairs, times of each text."""
    codec, out = aligner.codec, [(0, 0, 0, 0, "", [], [])] * len(texts)
    good, ids, counts = codec.encode(texts)
    if not good:
        return out
    begins = _windows(codec, ids)
    names, first, kind = _distinct(ids, begins)
    windows = [(x[at], n) for x, begin in zip(ids, begins, strict=True) for at, n in [_gather(np.r_[begin, len(x)], first)]]
    row = aligner.learn(names, windows)[kind]
    doc_ends = np.cumsum(counts[0])
    doc = np.searchsorted(doc_ends, begins[0], side="right")
    bounds = np.searchsorted(doc, np.arange(len(good) + 1)).tolist()
    groups, links = (np.bincount(doc, weights=x[row], minlength=len(good)).astype(np.int64).tolist() for x in (aligner.groups, aligner.links))
    # Windows of a document counted once each, then their pairs.
    d, w, n = _counted(doc, row, None, len(aligner.texts))
    pairs, many = aligner.pairs.take(w)
    times = aligner.times.take(w)[0] * np.repeat(n, many)
    d, pairs, times = _counted(np.repeat(d, many), pairs, times, codec.both)
    pairs = pairs // codec.second << 32 | pairs % codec.second
    cut = np.searchsorted(d, np.arange(len(good) + 1)).tolist()
    row = row.tolist()
    for j, i in enumerate(good):
        text = ";".join(map(aligner.texts.__getitem__, row[bounds[j] : bounds[j + 1]]))
        out[i] = (int(counts[0][j]), int(counts[1][j]), groups[j], links[j], text, pairs[cut[j] : cut[j + 1]], times[cut[j] : cut[j + 1]])
    return out


@lru_cache(maxsize=2)
def _aligner(cfg: AlignConfig) -> Aligner:
    return Aligner(Codec(cfg))


def _blocks(lengths: list[int], size: int) -> Iterator[slice]:
    """Consecutive rows of at most ``size`` bytes, one row at least."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _align(cfg: AlignConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(cfg)
        for batch in batches:
            doc_id, text = batch.column("doc_id"), batch.column("text")
            for part in _blocks(batch.column("n_bytes").to_pylist(), cfg.block):
                rows = align_texts(aligner, [t or "" for t in text[part.start : part.stop].to_pylist()])
                a, b, g, n, groups, pairs, times = zip(*rows, strict=True)
                offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in pairs])], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))) for x in (pairs, times)]
                counts = [pa.array(x, pa.int64()) for x in (a, b, g, n)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([doc_id[part.start : part.stop], *counts, pa.array(groups, pa.string()), *lists], names=names)

    return run


def align(documents: DataFrame, cfg: AlignConfig) -> DataFrame:
    """doc_id (as long), n_a, n_b, n_groups, n_links, groups, pairs and times of each row of (doc_id, text).

    ``groups`` has the ids of both kinds between shared ends (``a1,a2|b1;a3|b2,b3``), ``pairs`` the distinct linked
    pairs (first id << 32 | second id) and ``times`` how often each is linked. Texts that are null or empty, or whose tokens
    of either kind do not join to a space and the text, have no tokens: zeros and empty values. Rows are aligned one by
    one where they lie; null and repeated doc_ids are kept, other columns are not read, an empty table gives no rows.
    """
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return d.mapInArrow(_align(cfg), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (rows that hold it) and best (no pair of its first id has a higher count); ``aligned`` is best written before."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("count").alias("most"))  # one row an id of the vocabulary
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_scores(aligned: DataFrame, counts: DataFrame, cfg: AlignConfig) -> DataFrame:
    """``aligned`` (with a column row that no other row has) with n_best and count_sum in place of pairs and times.

    ``counts`` is ``pair_counts(aligned)``, written before.
    """
    size = F.floor(F.log2("count"))
    sizes = {r["size"]: r["n"] for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, held = 64, 0
    for s in sorted(sizes, reverse=True):
        if (held := held + sizes[s]) > cfg.light_pairs:
            break
        least = s
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = each.join(F.broadcast(counts.filter(size >= least)), "pair", "left")
    if any(s < least for s in sizes):
        rare = found.filter("count is null").select("row", "pair", "times").join(counts.filter(size < least), "pair")
        found = found.filter("count is not null").unionByName(rare)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = aligned.drop("pairs", "times")
    return out.join(sums, "row", "left").select(*[c for c in out.columns if c != "row"], zero("n_best"), zero("count_sum"))


def align_corpus(documents: DataFrame, folder: str, cfg: AlignConfig) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (empty without tokens), n_best and count_sum of each row."""
    name = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    d = align(documents, cfg).select("doc_id", "n_a", "n_b", "n_groups", "n_links", name, "pairs", "times", F.monotonically_increasing_id().alias("row"))
    aligned = written(d, folder, "aligned")
    return with_scores(aligned, written(pair_counts(aligned), folder, "pairs"), cfg)
