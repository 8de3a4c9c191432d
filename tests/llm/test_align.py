"""Token alignment against whole-text encoding and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavefold.llm import align
from wavefold.llm.shared import scratch_dir

CFG = align.AlignConfig(first=public_tokenizers.path("byte_bpe_50k.json"), second=public_tokenizers.path("piece_bpe_32k.model"))


def plain_groups(text):
    """Groups of ids between shared ends, of the tokens of the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(CFG.first), sentencepiece.SentencePieceProcessor(model_file=CFG.second)
    a.encode_special_tokens = True
    letters = {**{chr(x): x for x in (*range(33, 127), *range(161, 173), *range(174, 256))}}
    letters |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
        return []
    out, ga, gb, ea, eb = [], [], [], 0, 0
    ta, tb = ta[::-1], tb[::-1]
    while ta or tb:
        if ea <= eb:
            i, x = ta.pop()
            ga.append(i)
            ea += len(x)
        else:
            i, x = tb.pop()
            gb.append(i)
            eb += len(x)
        if ea == eb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def plain(texts):
    links, rows = [], []
    for t in texts:
        g = plain_groups(t) if t else []
        links.append(Counter((a, b) for x, y in g for a in x for b in y))
        rows.append(g)
    count = Counter(p for c in links for p in c)
    best: dict = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, c in zip(rows, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  spaces  ", "\n", "\n\nx \n y", "tab\t x", "<|endoftext|> a<|endoftext|>b", "<s>x</s> <unk> <0x41>", "▁ x▁y", "a▁", "é é ﬁ ＡＢ",
    "naïve Ünïcode", "日本語 と 中文 混ぜ", "👩‍👩‍👧 🇩🇪 flags", " x y 　z", "\x00nul\x1f \x1c x", "don't I'll we've 'tis", "12 345 6,789 ½ ²", "=" * 999, " " * 300 + "x", "aaaa" * 500, "x" * 40_000,
    ("lorem ipsum " * 3000).strip(), "क्षि नमस्ते", "﻿bom", "\U000e0041 tag", "mixed\r\nlines \r\n here", "ŐőŰű Łódź", "٣٤٥ عربى", "ᲀꟜ ͸x",
]


@pytest.mark.parametrize(("light", "pieces", "block"), [(1_000_000, 1_000_000, 2 << 20), (3, 50, 200)])
def test_alignment_against_whole_texts(spark, light, pieces, block):
    r = random.Random(5)
    alphabet = ["a", "th", "The", " ", " ", "  ", "\n", "é", "ß", "語", "'s", "1", "!", "\t", "▁", "🙂", "</s>"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(150)] + ["same text, twice"] * 2
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    cfg = align.AlignConfig(CFG.first, CFG.second, light_pairs=light, pieces=pieces, windows=pieces, block=block)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("row", "pairs", "groups", "n_a")})
    got = align.align_corpus(d, scratch_dir(spark), cfg).collect()
    key = lambda i, v: (str(i), *v)
    want = sorted(key(i, v) for (i, _), v in zip(rows, plain(texts), strict=True))
    assert sorted(key(g["doc_id"], (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["n_best"], g["count_sum"], g["groups_sha256"])) for g in got) == want


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_corpus(d, scratch_dir(spark), CFG).collect() == []


def test_groups_and_pairs_of_a_text(spark):
    d = spark.createDataFrame([(1, "unbelievable thing")], "doc_id long, text string")
    (row,) = align.align(d, CFG).collect()
    groups = plain_groups("unbelievable thing")
    assert row["groups"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert dict(zip(row["pairs"], row["times"], strict=True)) == Counter(a << 32 | b for x, y in groups for a in x for b in y)


def test_query_against_whole_texts(spark, sf):
    from wavefold.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.op12_token_alignment(spark, sf).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], plain([r["text"] for r in docs]), strict=True))
