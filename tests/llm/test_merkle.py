"""Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wavefold.llm import merkle
from wavefold.llm.shared import scratch_dir

DOC = "doc_id long, source string, lang string, n_chars int, text string"


def h(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain(digests: list[str], fan: int):
    """The root, and each leaf's proof as (left, right) a level."""
    proofs, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            run = at[i] // fan * fan
            p.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + fan])))
            at[i] //= fan
        nodes = [h(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], proofs


def rows_of(r: random.Random, n: int) -> list:
    some = lambda *xs: r.choice(xs)
    return [(some(None, *range(-3, 2 * n)), some("hot", "hot", "", "é", None, f"s{r.randrange(4)}"), some(None, "en"), some(None, 3), some(None, "", "Aé B", "x" * 5000)) for _ in range(n)]


@pytest.mark.parametrize(("n", "fan", "levels"), [(0, 16, 2), (1, 16, 2), (90, 2, 2), (300, 3, 1), (700, 16, 2)])
def test_manifest_against_plain_tree(spark, n, fan, levels):
    rows = rows_of(random.Random(n), n) + [(7, "hot", "en", 1, "same")] * (n // 3)
    cfg = merkle.MerkleConfig(fan_out=fan, levels=levels, light_rows=0 if n == 90 else 10_000)
    d = spark.createDataFrame(rows, DOC).repartition(5).withColumns({c: F.lit("clash") for c in ("pos", "tree", "leaf", "digest", "block")})
    got = merkle.manifest(d, scratch_dir(spark), cfg).withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    trees: dict = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: plain([x[2] for x in sorted(trees[s])], fan) for s in names}
    if names:
        root, tops = plain([subs[s][0] for s in names], fan)
    want = sorted(
        (str(x[1] if x[0] else None), x[2], (subs[s][0], root), tuple(proof) + tuple(tops[k]))
        for k, s in enumerate(names) for x, proof in zip(sorted(trees[s]), subs[s][1], strict=True)
    )
    assert sorted((str(r["doc_id"]), r["leaf"], tuple(r["roots"]), tuple(map(tuple, r["proof"]))) for r in got) == want
    assert all(r["folded"] == r["roots"][1] for r in got)


def test_tampered_rows_fail(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 4, f"Text {i}" if i % 2 else f"text {i}") for i in range(100)]
    d = spark.createDataFrame(rows, DOC)
    changed = merkle.digest("doc_id", "source", "lang", "n_chars", F.lower("text")).alias("changed")
    got = merkle.manifest(d, scratch_dir(spark), also=(changed,)).withColumn("ok", merkle.folded(F.col("changed"), F.col("proof")) == F.col("roots")[1]).collect()
    assert {r["doc_id"]: r["ok"] for r in got} == {i: i % 2 == 0 for i in range(100)}
