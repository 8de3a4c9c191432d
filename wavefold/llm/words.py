"""Vectorised words of Arrow text columns and 64-bit names of them.

A text is read as its UTF-8 bytes. A table of 256 entries says which bytes belong
to words and how they are folded. A word is read eight bytes at a time, each mixed
into its name, so most words cost one or two steps on an array, not a Python
object; words of more than 64 bytes are named by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd factors.
_LENGTH, _STEP, _PREFIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes read at once; a text of more is cut between words, and a word of more is a piece of its own.
PIECE = 1 << 19
#: The lowest 0 to 8 bytes of a number.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are named by BLAKE2.
_SHORT = 64

#: Space, and tab to carriage return, part words; A-Z are folded.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[32, *range(9, 14)]] = False
#: Letters, digits and all bytes beyond ASCII are words.
BY_LETTER = np.zeros(256, bool)
BY_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of one piece: where they start and end, the name of each, and the names of their prefixes."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, is_word: np.ndarray, fold: bool = True):
        word = is_word[data]
        new = np.zeros(len(data) + 1, bool)
        new[edges] = True
        before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        self.starts = np.flatnonzero(word & (~before | new[:-1]))
        self.ends = np.flatnonzero(word & (~after | new[1:])) + 1
        self.data = np.concatenate([LOWER[data] if fold else data, np.zeros(8, np.uint8)])
        self._eights = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))
        self.hashes = self._names()

    def chunk(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Eight bytes of each word from its byte 8 * k on, as a number; bytes behind its end are 0."""
        begin = self.starts[at] + 8 * k
        return self._eights[np.minimum(begin, len(self._eights) - 1)] & _BYTES[np.clip(self.ends[at] - begin, 0, 8)]

    def _names(self) -> np.ndarray:
        n = self.ends - self.starts
        with np.errstate(over="ignore"):
            h, k = mix64(self.chunk(0) + n.astype(np.uint64) * _LENGTH), 1
            at = np.flatnonzero((n > 8) & (n <= _SHORT))
            while len(at):
                h[at] = mix64((h[at] ^ self.chunk(k, at)) * _STEP)
                k += 1
                at = at[n[at] > 8 * k]
        for i in np.flatnonzero(n > _SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return h

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more than ``n`` bytes (8 at most), and a name of the first ``n`` of each."""
        at = np.flatnonzero(self.ends - self.starts > n)
        with np.errstate(over="ignore"):
            return at, mix64((self.chunk(0, at) & _BYTES[n]) + np.uint64(n) * _PREFIX)


def _cut(data: np.ndarray, is_word: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in pieces that end between words; a word longer than a piece is a piece of its own."""
    at = 0
    while len(data) - at > size:
        gaps = np.flatnonzero(~is_word[data[at : at + size]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            end = at + size
            while end < len(data) and not len(gaps):
                gaps = np.flatnonzero(~is_word[data[end : end + size]])
                end += int(gaps[0]) if len(gaps) else len(data[end : end + size])
        yield data[at:end]
        at = end
    yield data[at:]


def word_batches(texts: pa.Array, is_word: np.ndarray, fold: bool = True, piece: int | None = None) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """(first row, rows, words before each row and the end, Words); null is empty.

    A text of more than a piece comes alone, in several such tuples of one row.
    """
    piece = piece or PIECE
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
        part = data[offsets[at] : offsets[end]]
        if len(part) <= piece:
            edges = offsets[at : end + 1] - offsets[at]
            w = Words(part, edges, is_word, fold)
            yield at, end - at, np.searchsorted(w.starts, edges), w
        else:
            for one in _cut(part, is_word, piece):
                w = Words(one, np.array([0, len(one)]), is_word, fold)
                yield at, 1, np.array([0, len(w.starts)]), w
        at = end
