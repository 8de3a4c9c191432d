"""Removal of repeated passages against plain sets of strings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavefold.llm import repeats
from wavefold.llm.shared import scratch_dir


def plain(rows, length):
    """(doc_id, bytes, spans, kept) of every row."""
    least: dict[bytes, int] = {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, order(i)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < order(i):
                gone[p : p + length] = b"\x01" * length
        spans, start = [], None
        for p, g in enumerate([*gone, 0]):
            if g and start is None:
                start = p
            if not g and start is not None:
                spans.append((start, p))
                start = None
        out.append((str(i), len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    words = ["a", "of", "the", "né", "word", "语言", "longerword", "x\n", "="]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(n))
    shared = [prose(r.randrange(5, 40)) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [prose(r.randrange(0, 15))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            cut = r.randrange(len(s))
            parts += [r.choice([s, s[cut:], s[: cut + 30]]), prose(r.randrange(0, 8))]
        rows.append((r.choice([None, i, i, i, i, i - 100, 7]), r.choice(["", " "]).join(parts)))
    rows += [(r.randrange(100), rows[3][1]) for _ in range(20)] + [(9, rows[5][1])] * 15
    rows += [(200, "=" * 3000), (201, "=" * 2990 + "end"), (202, "ab" * 2000), (203, None), (204, ""), (205, "x" * 49), (206, "x" * 50), (207, "y" * 50), (208, "x" * 50)]
    rows += [(300 + i, shared[0] + "".join(r.choice("qwertyuiop") for _ in range(60))) for i in range(60)]
    return rows


@pytest.mark.parametrize("cfg", [repeats.RepeatConfig(), repeats.RepeatConfig(group=3), repeats.RepeatConfig(piece=128), repeats.RepeatConfig(length=12, window=4, piece=300)])
def test_against_plain_sets(spark, cfg):
    rows = corpus(cfg.group + cfg.piece)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("key", "id", "trigger", "kept")})
    assert result(repeats.remove_repeats(d, scratch_dir(spark), cfg)) == plain(rows, cfg.length)


@pytest.fixture
def ranges(spark):
    """Many ranges that are not put together, so that triggers reach over their ends."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("cfg", [repeats.RepeatConfig(parts=1), repeats.RepeatConfig(group=3, parts=1)])
def test_triggers_that_reach_over_the_ends_of_ranges(spark, ranges, cfg):
    rows = corpus(1)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(repeats.remove_repeats(d, scratch_dir(spark), cfg)) == plain(rows, cfg.length)


def test_rows_without_strings(spark):
    schema = "doc_id long, text string"
    assert repeats.remove_repeats(spark.createDataFrame([], schema), scratch_dir(spark)).collect() == []
    assert result(repeats.remove_repeats(spark.createDataFrame([(1, None), (None, "")], schema), scratch_dir(spark))) == [("1", 0, [], b""), ("None", 0, [], b"")]


def test_query_against_plain_sets(spark, sf):
    import hashlib

    from wavefold.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plain(rows, 50)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op13_suffix_array_dedup(spark, sf).collect())
    assert got == want
