"""Token-ID output with a shared zstandard dictionary (operator 3).

File format: a Parquet table ``blocks`` that Spark's writer commits, and a table
``dictionary`` of one row (hash, dictionary). A block holds documents that follow
each other in ascending doc_id: ``payload`` has one zstandard frame for each
document, all made with the shared dictionary named by ``dictionary_hash``;
``offsets[i]`` and ``offsets[i + 1]`` bound the frame of ``doc_ids[i]``, so a short
document is read by one slice and one small decompression; ``first_id`` and
``last_id`` bound the ids of a block, so the files' statistics lead to it. (part,
seq) orders the blocks. Ids are little-endian unsigned integers of
``width`` bytes. The dictionary is trained on the serialized ids of a bounded
sample of documents; it shapes the size of the files only.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefold.llm.token_count import load
from wavefold.llm.words import BY_SPACE, Words, word_batches


@dataclass(frozen=True)
class TokenConfig:
    tokenizer: str = ""
    end_id: int = 2
    #: Bound of the sample that the dictionary is trained on: documents, bytes of each, bytes of the dictionary.
    sample_docs: int = 1000
    sample_bytes: int = 8192
    dictionary_bytes: int = 65536
    level: int = 3
    #: A block is closed at so many bytes or documents.
    block_bytes: int = 1 << 20
    block_docs: int = 2048
    #: Words whose ids a worker remembers at most.
    remembered: int = 500_000


def id_width(tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


#: What may stand in a tokenizer that encodes the words between ASCII white space on their own (fixed values).
_NORMALIZERS = frozenset(("NFC", "NFKC", "Lowercase", "Replace"))
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_by_word(tokenizer) -> bool:
    """Whether the ids of a text are those of its words between ASCII white space, one after the other.

    So it is where the pre-tokenizer drops white space, no match of it crosses
    any, the normalizer leaves it where it is, and no special string holds or takes
    any. Other tokenizers get whole texts.
    """
    j = json.loads(tokenizer.to_str())
    steps = j["normalizer"] or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    plain = all(s["type"] in _NORMALIZERS and (s["type"] != "Replace" or (s["pattern"], s["content"]) == ({"Regex": r"\s+"}, " ")) for s in steps)
    first, *_ = (j["pre_tokenizer"] or {}).get("pretokenizers", [j["pre_tokenizer"] or {}])
    splits = first.get("type") == "Split" and first["pattern"] == {"Regex": _WORD_PATTERN} and first["behavior"] == "Removed" and first["invert"]
    return plain and bool(splits) and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in j["added_tokens"])


class WordIds:
    """Ids of the words that a worker has met, each encoded once by the library.

    A word of up to 16 bytes is looked up by its 64-bit name in a sorted array and
    then compared byte by byte (two numbers and the length), so a name that two words
    share costs a look into a dictionary and no more. At most ``most`` words are
    remembered; then all are forgotten.
    """

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most, self.width = tokenizer, most, id_width(tokenizer)
        self.by_word = encodes_by_word(tokenizer)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([bool(suffix) and (tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)], bool)
        self.forget()

    def forget(self) -> None:
        self.names, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted names, and which entry each is
        self.first, self.second, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)  # the word of each name
        self.others: dict[bytes, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, f"<u{self.width}")

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Letters, with one mark behind them or not, are encoded together: a word's last id has the word end."""
        out: list = [None] * len(words)
        parts = np.array([1 if w.isalpha() else 2 if w[-1] in ".,;:!?" and w[:-1].isalpha() else 0 for w in words], np.int64)
        for run in np.array_split(plain := np.flatnonzero(parts), max(1, len(plain) // 1024)) if self.ends.any() else ():
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in run])], add_special_tokens=False)[0].ids, f"<u{self.width}")
            cut = np.flatnonzero(self.ends[ids]) + 1
            # Each part has a word end at least, so the same total says that each has one.
            if len(run) and len(cut) == parts[run].sum() and cut[-1] == len(ids):
                last = cut[np.cumsum(parts[run]) - 1]
                for i, a, b in zip(run.tolist(), [0, *last[:-1].tolist()], last.tolist(), strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 1024):
            part = rest[k : k + 1024]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, f"<u{self.width}")
        return out

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Entries of words that have none."""
        ids = self._encoded([w.decode() for w in words])
        count = np.array([len(x) for x in ids], np.int32)
        first = len(self.count)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count, dtype=np.int64) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, *ids])
        return np.arange(first, first + len(words))

    def entries(self, w: Words) -> np.ndarray:
        """The entry of each word, made where there is none."""
        if len(self.count) > self.most:
            self.forget()
        size = w.ends - w.starts
        out, word = np.full(len(size), -1, np.int64), lambda i: w.data[w.starts[i] : w.ends[i]].tobytes()
        at = np.flatnonzero(size <= 16)
        name, head, back = np.unique(w.hashes[at], return_index=True, return_inverse=True)
        place = np.searchsorted(self.names, name)
        new = np.flatnonzero(self.names[np.minimum(place, len(self.names) - 1)] != name) if len(self.names) else np.arange(len(name))
        for k in range(0, len(new), 1 << 16):  # in parts, since words and their ids are objects on the way
            part = new[k : k + (1 << 16)]
            i = at[head[part]]
            entry = self._add([word(j) for j in i.tolist()])
            place = np.searchsorted(self.names, name[part])
            for column, more in (("names", name[part]), ("entry", entry), ("first", w.chunk(0, i)), ("second", w.chunk(1, i)), ("size", size[i])):
                setattr(self, column, np.insert(getattr(self, column), place, more))
        found = np.searchsorted(self.names, name)
        same = (w.chunk(0, at) == self.first[found][back]) & (w.chunk(1, at) == self.second[found][back]) & (size[at] == self.size[found][back])
        out[at[same]] = self.entry[found][back[same]]
        # Long words, and those whose name another word has.
        other = {word(i): i for i in np.flatnonzero(out < 0).tolist()}
        missing = [x for x in other if x not in self.others]
        self.others |= dict(zip(missing, self._add(missing).tolist(), strict=True))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self.others[word(i)]
        return out

    def of(self, entries: np.ndarray) -> np.ndarray:
        """Ids of words one after the other."""
        count = self.count[entries]
        return self.ids[np.repeat(self.begin[entries] - (np.cumsum(count, dtype=np.int64) - count), count) + np.arange(count.sum(dtype=np.int64))]


def encode_texts(memory: WordIds, texts: pa.Array, end_id: int) -> Iterator[bytes]:
    """Serialized ids of each text, the end id included; null is empty."""
    end = int(end_id).to_bytes(memory.width, "little")
    if not memory.by_word:
        for t in texts:
            yield np.array(memory.tokenizer.encode(t.as_py() or "", add_special_tokens=False).ids, f"<u{memory.width}").tobytes() + end
        return
    open_row, parts = -1, []  # a text of several pieces
    for first, rows, edges, w in word_batches(texts, BY_SPACE, fold=False, piece=1 << 20):
        entries = memory.entries(w)
        ids, cut = memory.of(entries), np.r_[0, np.cumsum(memory.count[entries], dtype=np.int64)][edges]
        if first != open_row and open_row >= 0:
            yield b"".join(parts) + end
            open_row, parts = -1, []
        if rows == 1:
            open_row = first
            parts.append(ids.tobytes())
        else:
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield ids[a:b].tobytes() + end
    if open_row >= 0:
        yield b"".join(parts) + end


@lru_cache(maxsize=4)
def _memory(path: str, most: int) -> WordIds:
    return WordIds(load(path), most)


def _samples(cfg: TokenConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(cfg.tokenizer, cfg.remembered)
        for batch in batches:
            ids = [x[: cfg.sample_bytes] for x in encode_texts(memory, batch.column("text"), cfg.end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return run


def train_dictionary(documents: DataFrame, cfg: TokenConfig) -> bytes:
    """A dictionary from the ids of at most ``sample_docs`` doc_ids, those of least hash; of rows that repeat one, those of least ids."""
    d = documents.select("doc_id", "text")
    chosen = [r[0] for r in d.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample_docs).collect()]
    rows = d.filter(F.col("doc_id").isin(chosen)).mapInArrow(_samples(cfg), "ids binary").orderBy("ids").limit(2 * cfg.sample_docs).collect() if chosen else []
    samples = [bytes(r[0]) for r in rows]
    try:
        return zstandard.train_dictionary(cfg.dictionary_bytes, samples, level=cfg.level, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples: their bytes are the dictionary
        return b"".join(samples)[: cfg.dictionary_bytes]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


_BLOCKS = "part int, seq int, first_id bigint, last_id bigint, dictionary_hash string, width int, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<bigint>, payload binary"


def _blocks(cfg: TokenConfig, raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(cfg.tokenizer, cfg.remembered)
        width, name, part = memory.width, hashlib.sha256(raw).hexdigest(), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=cfg.level, dict_data=_dictionary(raw), write_checksum=False)
        seq, doc_ids, frames, counts, size = 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            edges = np.r_[0, np.cumsum([len(f) for f in frames])].tolist()
            values = [part, seq, doc_ids[0], doc_ids[-1], name, width, doc_ids, edges, counts, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode_texts(memory, batch.column("text"), cfg.end_id), strict=True):
                frame = press.compress(data)
                doc_ids.append(doc_id), frames.append(frame), counts.append(len(data) // width)
                size += len(frame)
                if size >= cfg.block_bytes or len(frames) >= cfg.block_docs:
                    yield block()
                    seq, doc_ids, frames, counts, size = seq + 1, [], [], [], 0
        if frames:
            yield block()

    return run


def write_tokens(documents: DataFrame, folder: str, cfg: TokenConfig) -> None:
    """Writes the ids of all rows of (doc_id, text) in ascending doc_id order to ``folder``.

    Null text is an empty one (its end id only); a null doc_id comes first;
    rows that repeat a doc_id follow each other, ordered by text. An empty table
    writes a format without blocks. Other columns are not read. Texts are dealt
    out by ranges of doc_id and, inside of one that is repeated, of the texts'
    beginnings, so each task writes one run of the order.
    """
    spark, d = documents.sparkSession, documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = train_dictionary(d, cfg)
    spark.range(1).select(F.lit(hashlib.sha256(raw).hexdigest()).alias("hash"), F.lit(bytearray(raw)).alias("dictionary")).write.parquet(f"{folder}/dictionary")
    ordered = d.repartitionByRange("doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(cfg, raw), _BLOCKS).write.parquet(f"{folder}/blocks")


def read_dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    name, raw = spark.read.parquet(f"{folder}/dictionary").collect()[0]
    if hashlib.sha256(bytes(raw)).hexdigest() != name:
        raise ValueError(f"the dictionary in {folder} does not have the hash {name}")
    return name, bytes(raw)


def read_ids(doc: int, doc_ids: list, offsets: list[int], payload: bytes, width: int, raw: bytes) -> np.ndarray:
    """Ids of one document of a block, by its offsets alone."""
    i = doc_ids.index(doc)
    data = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress(payload[offsets[i] : offsets[i + 1]])
    return np.frombuffer(data, f"<u{width}").astype("<u4")


def _digests(name: str, raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for r in range(batch.num_rows):
                part, seq, hashed, width, doc_ids, edges, _, payload = (batch.column(c)[r] for c in range(8))
                if hashed.as_py() != name:
                    raise ValueError(f"block {part}/{seq} was made with another dictionary: {hashed}")
                data, at, n, crc = memoryview(payload.as_buffer()), edges.as_py(), [], []
                for a, b in zip(at, at[1:], strict=False):
                    ids = np.frombuffer(press.decompress(data[a:b]), f"<u{width.as_py()}").astype("<u4")
                    n.append(len(ids)), crc.append(zlib.crc32(ids.tobytes()))
                before = np.cumsum([0, *n[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(n), pa.int32()), pa.array([seq.as_py()] * len(n), pa.int32()), pa.array(doc_ids.as_py(), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the written files alone.

    Starts are sums in three levels: over the parts (few), over the blocks of a
    part, over the documents of a block.
    """
    name, raw = read_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").drop("first_id", "last_id")
    totals = blocks.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    of_part = totals.groupBy("part").agg(F.sum("n").alias("n"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    of_part = of_part.select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start")).join(of_part, "part")
    docs = blocks.mapInArrow(_digests(name, raw), "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
