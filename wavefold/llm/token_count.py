"""Exact token counts of texts of any length (operator 6).

A document of up to ``chunk`` characters is encoded as it is. A longer one is
encoded in overlapping chunks with offsets (overlap resynchronisation). Two
neighbours are spliced at a common boundary inside their overlap: a position
where both begin a new pre-token. It is stable, since

* the left chunk's pre-tokens are those of the whole text up to ``margin``
  characters before its cut end (matches are leftmost, with one character of
  lookahead, and no special string is longer than the margin), and
* from a shared start, matching depends on the text behind it alone, so the
  right chunk's tokens from there on are those of the whole text.

If an overlap has no such boundary (one huge word, a long run of spaces), it is
widened: the right chunk starts further back, in the end at the last spliced
boundary, and the left chunk grows, in the end to the whole rest.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountConfig:
    tokenizer: str = ""
    limit: int = 1024
    #: Characters of a chunk and of the first overlap.
    chunk: int = 32768
    overlap: int = 256
    #: Pieces whose counts a worker remembers at most.
    remembered: int = 1_000_000


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def cuts_before_spaces(tokenizer) -> bool:
    """Whether the tokenizer is a byte-level one of the pattern that pieces and splices rely on; others get whole texts."""
    j = json.loads(tokenizer.to_str())
    pre = j["pre_tokenizer"] or {}
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in j["added_tokens"])
    return j["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and plain


def _margin(tokenizer) -> int:
    return 2 + max([len(t.content) for t in tokenizer.get_added_tokens_decoder().values()], default=0)


def _starts(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a pre-token begins, and the number of tokens before each."""
    e = tokenizer.encode(text, add_special_tokens=False)
    if not e.ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.array([o[0] for o in e.offsets], np.int64)
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (word[1:] < 0)])
    return begin[new], new


def count_spliced(tokenizer, text: str, chunk: int, overlap: int, stats: dict | None = None) -> int:
    """Tokens of ``text`` by overlapping chunks; equals len(encode(text))."""
    stats = stats if stats is not None else {}
    margin, total, at, n = _margin(tokenizer), 0, 0, len(text)
    size = max(chunk, 2 * (overlap + margin))
    while n - at > size:
        # The left chunk begins at ``at``, a proven boundary of the whole text.
        left, before = _starts(tokenizer, text[at : at + size])
        end, wide, cut = at + size, overlap, None
        while cut is None:
            begin = max(at + 1, end - wide)
            right, _ = _starts(tokenizer, text[begin : min(n, end + overlap)])
            common = np.intersect1d(left + at, right + begin)
            # Behind the right chunk's first character and clear of the left chunk's cut end.
            common = common[(common > begin) & (common <= end - margin)]
            if len(common):
                cut = int(common[-1])
            elif begin == at + 1:
                break
            else:
                wide, stats["widened"] = 2 * wide, stats.get("widened", 0) + 1
        if cut is None:  # no boundary in the whole left chunk: it grows
            size, stats["grown"] = 2 * size, stats.get("grown", 0) + 1
            continue
        total += int(before[np.searchsorted(left + at, cut)])
        at, size = cut, max(chunk, 2 * (overlap + margin))
        stats["spliced"] = stats.get("spliced", 0) + 1
    return total + len(tokenizer.encode(text[at:], add_special_tokens=False).ids)


#: White space of Unicode and the separators 1C-1F (fixed values): a piece must not end with one.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def pieces(text: str) -> list[str] | None:
    """A text cut before each space, or None where such cuts are not safe.

    A space that follows a character that is none begins a pre-token, so such
    pieces can be encoded on their own. The first piece is the text's begin.
    """
    spaces = _SPACES if not text.isascii() else _SPACES[:10]
    if text[:1] == " " or any(c + " " in text for c in spaces):
        return None
    return text.split(" ")


class Memory(dict):
    """Values of the pieces that follow a space, each computed once by the library.

    At most ``most`` pieces are remembered; then all are forgotten.
    """

    def __init__(self, most: int, cuts: bool = True):
        super().__init__()
        self.most, self.cuts = most, cuts

    def learn(self, tokenizer, wanted: set[str], prefix: str, value, direct=None) -> None:
        """``direct`` gives the value of a plain word from the library's model, None for other pieces."""
        new = list(wanted.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(wanted)
        if direct is not None:
            found = {x: d for x in new if (d := direct(x)) is not None}
            self.update(found)
            new = [x for x in new if x not in found]
        for i in range(0, len(new), 1024):
            part = new[i : i + 1024]
            for piece, e in zip(part, tokenizer.encode_batch_fast([prefix + x for x in part], add_special_tokens=False), strict=True):
                self[piece] = value(e)


#: Byte-level vocabularies write printable bytes as themselves and the n-th other byte as letter 256 + n.
_AS_IS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _AS_IS)}


def byte_letters(word: str) -> str | None:
    """A word of Latin letters as a byte-level model reads it: one pre-token; None for other words.

    Such words need no pre-tokenizer, and none of the normalizers here changes them.
    """
    if not word.isalpha():
        return None
    if word.isascii():
        return word
    if max(word) >= "\u0250" or not unicodedata.is_normalized("NFC", word):
        return None
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def _direct_count(tokenizer):
    model, space = tokenizer.model, chr(_BYTE_LETTERS[32])
    marks = {c: len(model.tokenize(c)) for c in ".,"}

    def count(piece: str) -> int | None:
        if (w := byte_letters(piece)) is not None:
            return len(model.tokenize(space + w))
        if piece[-1:] in marks and (w := byte_letters(piece[:-1])) is not None:
            return len(model.tokenize(space + w)) + marks[piece[-1]]
        return None

    return count


@lru_cache(maxsize=4)
def _memory(path: str, most: int) -> Memory:
    return Memory(most, cuts_before_spaces(load(path)))


def count_texts(tokenizer, memory: Memory, texts: list[str], cfg: CountConfig) -> list[int]:
    if not memory.cuts:
        return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    out = [0] * len(texts)
    cut: dict[int, list[str]] = {}
    for i, t in enumerate(texts):
        if len(t) > cfg.chunk:
            out[i] = count_spliced(tokenizer, t, cfg.chunk, cfg.overlap)
        elif (p := pieces(t)) is None:
            out[i] = len(tokenizer.encode(t, add_special_tokens=False).ids)
        else:
            cut[i] = p
    memory.learn(tokenizer, set().union(*(p[1:] for p in cut.values())), " ", len, _direct_count(tokenizer))
    first = tokenizer.encode_batch_fast([p[0] for p in cut.values()], add_special_tokens=False)
    for (i, p), e in zip(cut.items(), first, strict=True):
        out[i] = len(e) + sum(map(memory.__getitem__, p[1:]))
    return out


def _count(cfg: CountConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, memory = load(cfg.tokenizer), _memory(cfg.tokenizer, cfg.remembered)
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 512):
                texts = batch.column("text").slice(i, 512).to_pylist()
                out += count_texts(tokenizer, memory, [t or "" for t in texts], cfg)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, cfg: CountConfig) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of (doc_id, text).

    Null text counts as empty: 0 bytes, 0 tokens. Rows are counted one by one
    where they lie, without a shuffle; a null or repeated doc_id is kept as it
    is. Other columns are not read. An empty table gives no rows.
    """
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = d.mapInArrow(_count(cfg), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > cfg.limit)
