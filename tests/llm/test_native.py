"""Mixing, URL filter and chat formatting."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from wavefold.llm import chat, mixing, queries, url_filter
from wavefold.llm.shared import scratch_dir

DOC = "doc_id long, text string, source string"


def targets_by_rounds(sizes: dict, weights=(1, 2, 3), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return out | share
        out |= {s: epochs * sizes[s] for s in over}


def test_mixing_targets_and_words(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        s = r.choice(["a", "b", "é", "Z", None] + ["hot"] * 4)
        rows.append((i, " ".join(["w"] * r.randrange(0, 40)) if i % 50 else None, s))
    rows += [(7, "x y z", "a"), (7, "x y z", "a"), (None, "q q", "b"), (900, "w\u00a0w \t\n\x0b\x0c\rw", "tiny"), (901, "", "empty")]
    d = spark.createDataFrame(rows, DOC).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mix(mixing.sized(d)).collect()
    sizes: dict = {}
    for _, t, s in rows:
        n = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
        sizes[s] = sizes.get(s, 0) + n
    want = targets_by_rounds(sizes)
    assert len(got) == len(rows)
    taken: dict = {}
    for r_ in got:
        assert r_["source_size"] == sizes[r_["source"]]
        assert abs(r_["target"] - want[r_["source"]]) < 1e-6
        assert r_["taken"] <= 3 * r_["size"]
        taken[r_["source"]] = taken.get(r_["source"], 0) + r_["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45
    again = mixing.mix(mixing.sized(d.repartition(7))).collect()
    key = lambda rs: sorted((str(x["doc_id"]), x["size"], x["taken"]) for x in rs)
    assert key(got) == key(again)
    out = mixing.mixed_documents(d, mixing.source_plan(mixing.sized(d)))
    assert out.columns == d.columns and out.count() == sum(x["repetitions"] for x in got)


def test_mixing_of_repeated_and_null_ids(spark):
    """Sources of one doc_id, of null ids, and of equal rows come as near to their targets as others."""
    rows = [(None, f"t{i} " + "w " * 9, "a") for i in range(100)] + [(5, f"t{i} " + "w " * 9, "b") for i in range(100)] + [(6, "w " * 10, "c") for _ in range(300)] + [(i, "w " * 10, "d") for i in range(60)]
    d = spark.createDataFrame(rows, DOC).repartition(3)
    got = mixing.mix(mixing.sized(d)).collect()
    for s in "abcd":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= (60 if s == "c" else 10)
    assert len({r["taken"] for r in got if r["source"] == "a"}) == 2 == len({r["taken"] for r in got if r["source"] == "c"})
    key = lambda rs: sorted((str(x["doc_id"]), x["source"], x["taken"]) for x in rs)
    assert key(got) == key(mixing.mix(mixing.sized(d)).collect())
    more = d.withColumn("plan_whole", F.lit(1))
    out = mixing.mixed_documents(more, mixing.source_plan(mixing.sized(d)))
    assert out.columns == more.columns and abs(out.count() - sum(x["repetitions"] for x in got)) <= 6


def test_suffixes_and_unlabelled_outcomes(spark):
    h = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.z.gov.co.uk",), ("h.de",), ("",), ("xco.uk",)], "host string")
    of = lambda known: [r[0] for r in h.select(url_filter.suffix_of(F.col("host"), known)).collect()]
    assert of(("co.uk", "gov.co.uk")) == ["co.uk", "co.uk", "gov.co.uk", "de", "", "uk"] and of(()) == ["uk", "uk", "uk", "de", "", "uk"]


def test_mixing_empty(spark):
    assert mixing.mix(mixing.sized(spark.createDataFrame([], DOC))).collect() == []


def test_url_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/x?a", "https://a.example.com/en/1#t", "http://x.net/es/", "http://x.net/de/", "ftp://b.com", "no scheme", None, "", "a://h.net?x/fr/", "http://c.com/x://y"]
    p = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    lab = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(p, lab, url_filter.UrlConfig(rules=queries.RULES), scratch_dir(spark)).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("x.net", "/es/", "net/es/", "block")
    assert got[3][2] is None and got[4] == ("b.com", "", None, got[4][3])
    assert got[5][:3] == ("", "", None) == got[6][:3] == got[7][:3]
    assert got[8][:3] == ("h.net", "", None) and got[9][:3] == ("c.com", "/x://y", "com/")
    assert url_filter.filter_urls(p.limit(0), lab.limit(0), url_filter.UrlConfig(), scratch_dir(spark)).collect() == []


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://bad.site.org/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 9}.good.org/{i}") for i in range(200)]
    p = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, int(i % 20 == 0)) for i in range(150)], "id long, bad int")
    got = url_filter.filter_urls(p, lab, url_filter.UrlConfig(), scratch_dir(spark)).groupBy("host").agg(F.first("verdict").alias("v")).collect()
    assert {r["host"] for r in got if r["v"] == "block"} == {"bad.site.org"}


PARTS = ["</turn>", "### ", "\\", "###", " ", "\n", ":", "User", "<", "/turn>", "é🙂", "#", "\\### Assistant: </turn> ok", "#format 1\n", "$1", "</turn>\n"]


def test_chat_round_trip(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a: b", "### x", None]) if c % 3 else r.choice(["user", "assistant"]), "".join(r.choice(PARTS) for _ in range(r.randrange(0, 8))) if r.random() > 0.1 else None) for c in range(120) for t in range(r.randrange(1, 5))]
    rows += [(500, None, "user", "x"), (500, 1, "assistant", "dup"), (500, 1, "assistant", "dup"), (None, 0, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = {x["conv_id"]: x for x in chat.digest(chat.read_back(chat.format_conversations(d))).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2], x[4].encode()))
        g, loss = got[c], "".join(x[4] for x in turns if x[3] == "assistant")
        assert g["round_trip"] and g["n_turns"] == len(turns)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{x[3]}\n{x[4]}\n" for x in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.read_back(chat.format_conversations(d.limit(0)))).collect() == []


def test_chat_escapes_control_strings(spark):
    d = spark.createDataFrame([(1, 0, "user", "\\### Assistant: </turn> ok"), (2, 0, "user", "plain")], "conv_id long, turn long, role string, text string")
    f = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(d).collect()}
    assert f[2] == "#format 0\n### user: plain</turn>\n"
    assert f[1].count("</turn>") == 1 and f[1].count("### ") == 1


def test_a_broken_round_trip_fails(spark):
    import pytest

    d = spark.createDataFrame([(1, 0, "user", "text")], "conv_id long, turn long, role string, text string")
    bad = chat.read_back(chat.format_conversations(d).withColumn("formatted", F.replace("formatted", F.lit("text"), F.lit("other"))))
    assert not bad.first()["round_trip"]
    with pytest.raises(Exception, match="not read back as written: conversation 1"):
        chat.digest(bad).collect()
