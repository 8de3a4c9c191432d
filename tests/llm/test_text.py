"""Search, tokens, HTML text, toxicity, decontamination and the Jaccard join against plain versions."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavefold.llm import decontaminate, html_text, jaccard_join, search, token_count, token_output, toxicity
from wavefold.llm.components import components
from wavefold.llm.shared import scratch_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "É", "İ", "ǅ", "e\u0301", " ", "  ", "\n", "'s", "1", ".", ",", "!", "<|endoftext|>", "<|endof", "text|>", "\u00a0", "漢", "\x1c", "🙂", "Σ", "\xad", "ﬁ", "\x85"]


def odd_texts(n: int, length: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, length))) for _ in range(n)]


# search


@pytest.mark.parametrize("block", [3, 512])
def test_top_k_is_exact(spark, block):
    rng = np.random.default_rng(3)
    vectors = [(int(i), (rng.normal(size=64) * rng.choice([0.1, 1.0])).astype(float).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(9)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 64), (2003, []), (2004, [1.0] * 8), (2050, [2.0] * 8), (5, vectors[5][1])]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = search.top_k(d.filter("vec_id % 50 = 0"), d, search.SearchConfig(query_block=block, candidate_block=block, group_bytes=5 * 512, cells=7, sample=64 * 50)).collect()
    good = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in good:
        if i % 50 == 0:
            c = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(c)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


@pytest.mark.parametrize(("dim", "scale"), [(64, 1e5), (64, 2.0**24), (768, 1e5), (768, 2.0**24), (5, 2.0**60), (3, 1e300)])
def test_scores_of_large_values_are_exact(spark, dim, scale):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(60, dim)) * scale) + rng.random((60, dim))
    x[7], x[8], x[9] = -x[3], x[3], np.r_[x[3][:-1], -x[3][-1]]
    rows = list(enumerate(x.tolist()))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.top_k(d.filter("vec_id % 10 = 0 or vec_id = 3"), d, search.SearchConfig(candidate_block=16)).collect()
    whole = {i: [int(v) for v in np.floor(np.clip(np.array(r) * 256, -(2.0**400), 2.0**400))] for i, r in rows}
    most, want = (1 << 63) - 1, set()
    for i in [*range(0, 60, 10), 3]:
        s = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[i], whole[j], strict=True)))), j) for j in whole if j != i)[:5]
        want |= {(i, r + 1, j, -v) for r, (v, j) in enumerate(s)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_bounds_leave_few_pairs_of_uneven_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64)) * 0.7 ** np.arange(64)
    x = x @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    cfg = search.SearchConfig()
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    side = search.Side(64, np.arange(3000), x, cfg, turn)
    q, best, counts = side.part(slice(0, 100)), search.Best(100, 5), []
    search.search_block(q, side, 0, best, counts)
    scores = (side.x @ q.x.T).T
    scores[np.arange(100), np.arange(100)] = -np.inf
    assert counts[0] >= counts[1] >= counts[2] and counts[2] < 0.05 * 100 * 3000
    assert np.sort(best.score.reshape(100, 5), axis=1)[:, ::-1].tolist() == (-np.sort(-scores, axis=1))[:, :5].tolist()


def test_search_empty(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.top_k(e, e).collect() == []


# tokens


def test_token_counts(spark):
    tok = token_count.load(BYTE)
    texts = [*odd_texts(300, 60), "word " * 9000, "x" * 40000, " " * 40000 + "a", "the end<|endoftext|>" * 3000, "a b. c, déjà vu", "", None]
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (3, "x")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    cfg = token_count.CountConfig(tokenizer=BYTE, chunk=512, overlap=16, remembered=500)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(d, cfg).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in [*enumerate(texts), (None, "x"), (3, "x")])
    assert got == want


def test_other_tokenizers_get_whole_texts():
    tok = token_count.load(WORD)
    assert token_count.cuts_before_spaces(token_count.load(BYTE)) and not token_count.cuts_before_spaces(tok)
    texts = odd_texts(50, 40) + ["x " * 60]
    got = token_count.count_texts(tok, token_count.Memory(9, token_count.cuts_before_spaces(tok)), texts, token_count.CountConfig(chunk=32))
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_splicing_widens_and_grows():
    tok, stats = token_count.load(BYTE), {}
    for text in [*odd_texts(400, 200, 5), "a" * 900 + " " * 700 + "b c" * 300, "<|endoftext|>" * 60]:
        assert token_count.count_spliced(tok, text, 20, 4, stats) == len(tok.encode(text, add_special_tokens=False).ids)
    assert stats["spliced"] > 100 and stats["widened"] > 0 and stats["grown"] > 0


def test_token_files(spark):
    tok = token_count.load(WORD)
    texts = [*odd_texts(300, 60, 2), "Déjà vu. WORDS, words ÀÉ" * 300, "", None]
    rows = [*enumerate(texts), (3, "dup"), (3, "dup"), (None, "nobody")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("start", F.lit("clash"))
    cfg = token_output.TokenConfig(tokenizer=WORD, block_docs=17, sample_docs=50, remembered=300)
    folder = scratch_dir(spark) + "/t"
    token_output.write_tokens(d, folder, cfg)
    got = sorted(token_output.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    pos, ids_of = 0, lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for (i, t), g in zip(order, got, strict=True):
        ids = ids_of(t)
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, pos, len(ids), zlib.crc32(ids.tobytes()))
        pos += len(ids)
    b = spark.read.parquet(folder + "/blocks").filter("array_contains(doc_ids, 301)").collect()[0]
    name, raw = token_output.read_dictionary(spark, folder)
    assert b["dictionary_hash"] == name
    one = token_output.read_ids(301, b["doc_ids"], b["offsets"], bytes(b["payload"]), b["width"], raw)
    assert one.tolist() == ids_of(texts[301]).tolist()


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    import pyarrow as pa

    from wavefold.llm import words

    tok = token_count.load(WORD)
    texts = [*odd_texts(3000, 60, 9), "a\x00 a a\x00\x00", "\ufb1d x \u0130 y \u1100\u1161 z", " \u0301a", "q" * 17 + " " + "q" * 16 + " " + "é" * 40, "word. word, word! word", "</w> <|startoftext|>x"]
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    for names in (None, lambda w: (w.ends - w.starts).astype(np.uint64)):  # the second gives words of one length one name
        if names:
            monkeypatch.setattr(words.Words, "_names", names)
        memory = token_output.WordIds(tok, 100)
        assert memory.by_word and not token_output.encodes_by_word(token_count.load(BYTE))
        for size in (7, 4000):
            got = [x for i in range(0, len(texts), size) for x in token_output.encode_texts(memory, pa.array(texts[i : i + size]), 2)]
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    memory.by_word = False
    assert [np.frombuffer(x, "<u2").tolist() for x in token_output.encode_texts(memory, pa.array(texts), 2)] == want


def test_token_files_empty(spark):
    folder = scratch_dir(spark) + "/t"
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, token_output.TokenConfig(tokenizer=WORD))
    assert token_output.read_digests(spark, folder).collect() == []


# HTML


def test_html_text(spark):
    page = (
        "<html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>m</a></nav><main><article><h1>Head</h1>"
        "<p>Para one is rather long &amp; good&nbsp;text here.<p>Short.<aside>side</aside><div class='cookie-notice'>We use cookies</div><ul><li>item <b>one</b><li>two</ul>"
        "<form>Name</form><script>var a='</p>';</script></article><section id=comments><p>reader comment text that is long</p></section></main><footer>f</footer>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<nav>only</nav>"), (5, "u", "plain &am"), (5, "u", "plain &am")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(d).orderBy("page_id").collect()]
    main = "Head\nPara one is rather long & good text here.\nShort.\nitem one\ntwo"
    assert got == [(1, main, len(main)), (2, "", 0), (3, "", 0), (4, "", 0), (5, "plain &am", 9), (5, "plain &am", 9)]
    assert html_text.extract_text(d.limit(0)).collect() == []


def test_marks_do_not_take_prose():
    long = "A sentence of the article that goes on for quite some length, as prose does. " * 3
    text = long.strip()
    article = f"<article><h2 id='discussion'>Results and more</h2><p id='notice-period'>{long}</p><section id='related-work'><p>{long}</p></section><section id='discussion'><p>{long}</p></section></article>"
    body = f"Results and more\n{text}\n{text}\n{text}"
    links = "<a href=x>Other page</a> <a href=y>More pages</a>"
    assert html_text.main_text(f"<body><nav>m</nav>{article}</body>") == body
    for name in ("sidebar-right", "sidebar", "has-ad content promo-x"):
        assert html_text.main_text(f"<body><nav>m</nav><div class='{name}'>{article}</div></body>") == body
    assert html_text.main_text(f"<body>{article}<div class='comments'><article><p>{long}</p></article></div><div class='related-posts'>{links}</div></body>") == body
    inner = article.replace("</article>", f"<div class='related-posts'>{links}</div></article>")
    assert html_text.main_text(inner) == body
    assert html_text.main_text(f"<body>{article}<nav>m</nav><article><p>Short one.</p></article><nav>m</nav></body>") == body + "\nShort one."
    run = f"<p>{long}</p><p>{long}</p><div class='ad'>Buy</div><p>It ends with a short run here.</p><div class='ad'>Buy</div>"
    assert html_text.main_text(f"<body>{run}</body>") == f"{text}\n{text}\nIt ends with a short run here."


def test_marks_of_an_article_and_unmarked_menus():
    long = "A sentence of the article that goes on for quite some length, as prose does."
    page = lambda inner, more="": f"<body><nav>m</nav>{more}<article><h1>Title</h1><p>{long}</p>{inner}<p>{long}</p></article><footer>f</footer></body>"
    want = lambda *inner: "\n".join(["Title", long, *inner, long])
    assert html_text.main_text(page(f"<section id='discussion'><p>{long}</p></section>")) == want(long)
    assert html_text.main_text(page(f"<section id='related-work'><h3>Related</h3><p>{long}</p></section>")) == want("Related", long)
    assert html_text.main_text(page("<h2 id='search'>Search</h2>")) == want("Search")
    assert html_text.main_text(page("<div class='article-header'><h2>Part two</h2></div>")) == want("Part two")
    assert html_text.main_text(page("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be so.</p>")) == want("Let x=1 be so.")
    menu = "<ul><li><a href=a>Home</a><li><a href=b>All posts</a><li><a href=c>About us</a></ul>"
    assert html_text.main_text(page("", menu)) == want()
    assert html_text.main_text(page(menu)) == want()
    assert html_text.main_text(page("<div><a href=x>Buy the new one now</a></div>")) == want()
    assert html_text.main_text(page("<h2><a href='#s'>A part</a></h2>")) == want("A part")
    assert html_text.main_text(page("<p>Read <a href=x>this other text</a> as well.</p>")) == want("Read this other text as well.")
    assert html_text.main_text(f"<main>{menu}<div><p>{long}</p><p>{long}</p></div></main>") == f"{long}\n{long}"
    bare = f"<body>{menu}<div><h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p></div>{menu}<div>{menu}</div></body>"
    assert html_text.main_text(bare) == f"Title\n{long}\nShort.\n{long}"


def test_pages_made_of_known_parts():
    """Pages without articles, made of parts whose kind is known; lines that are prose or headings must come out, in order, and no other."""
    r = random.Random(2)
    sentence = lambda: " ".join(r.choice(["word", "text", "longer", "part", "of", "and"]) for _ in range(r.randrange(12, 60)))
    wrong = 0
    for _ in range(150):
        want, html = [], []
        for _ in range(r.randrange(2, 7)):
            p = [sentence() for _ in range(r.randrange(2, 5))]
            want += [*p]
            html += [f"<div>{''.join(f'<p>{x}</p>' for x in p)}</div>"]
            html += [r.choice(["", "<ul>" + "".join(f"<li><a href=x>{r.choice('abc')} item</a>" for _ in range(r.randrange(1, 6))) + "</ul>", f"<aside><p>{sentence()}</p></aside>", f"<div class='ad'>{sentence()}</div>", "<form>Name <input></form>"])]
        wrong += html_text.main_text(f"<html><body>{''.join(html)}</body></html>") != "\n".join(want)
    assert wrong == 0


def test_very_long_and_deep_pages():
    long = "word " * 400_000
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert html_text.main_text("<div>" * 20_000 + "<p>deep text here</p>") == "deep text here"
    assert html_text.main_text("<p>x</p>\n" * 20_000) == "\n".join(["x"] * 20_000)


def test_broken_pages_are_linear_and_prose_stays():
    import time

    for page, want in [
        ("<article><p>text here</p>" + "<b>" * 20_000 + "x" + "</i>" * 20_000, "text here\nx"),
        ("<div class='ad x'>" * 8_000 + "<p>Some prose.</p>", ""),
        ("<p><table>" + "<b>" * 10_000 + "<div>" * 10_000 + "x", "x"),
    ]:
        start = time.perf_counter()
        assert html_text.main_text(page) == want
        assert time.perf_counter() - start < 3  # a second or less; machines differ
    long = "Long prose of the article here and there, it goes on."
    links = ["The full report is here for all of you", "Author, A title of the work that is cited, 2020", "Other, Another title of a work cited, 2021"]
    body = f"<p><a href=x>{links[0]}</a></p><ul><li><a href=a>{links[1]}</a><li><a href=b>{links[2]}</a></ul>"
    assert html_text.main_text(f"<article><h1>T</h1><p>{long}</p>{body}</article>") == "\n".join(["T", long, *links])
    assert html_text.main_text(f"<article><p>{long}</p><section id='banner'><p>{long}</p></section></article>") == f"{long}\n{long}"
    assert html_text.main_text("<body><div class='ad'>Buy this now</div><p>Yes.</p><div class='ad'>Buy this now</div></body>") == "Yes."
    comments = f"<ol class='comment-list'><li><article class='comment-body'><p>{long}</p></article></ol>"
    assert html_text.main_text(f"<body><article><p>{long}</p></article>{comments}</body>") == long
    assert html_text.main_text(f"<article><p>{long}</p><p class='advert'>{long}</p><p>Short.</p></article>") == f"{long}\nShort."
    post = f"<div class='post'><h1>T</h1><div class='text'><p>{long}</p><p>{long}</p></div><div><a href=x>share</a> <a href=y>tweet</a></div></div>"
    assert html_text.main_text(f"<body>{post}</body>") == f"T\n{long}\n{long}"


@pytest.mark.parametrize("n", [3, 64, 65, 500])
def test_layout_around_any_number_of_articles(n):
    """A mark around all articles of a page is one of layout, however many of them have marks of their own."""
    parts = [(f"Story {i}", f"The council of town {i} met on Monday and decided how the new bridge is to be paid for.") for i in range(n)]
    articles = "".join(f"<article class='related-story'><h2>{h}</h2><p>{p}</p></article>" for h, p in parts)
    page = f"<body><nav><a href=x>Home</a></nav><div class='sidebar'>{articles}</div><footer>Copyright</footer></body>"
    assert html_text.main_text(page) == "\n".join(x for part in parts for x in part)


def test_two_means_go_on_until_the_clusters_stay():
    for values in ((np.arange(1, 100_001) / 100_000) ** -0.5, np.arange(5000.0) ** 2, np.array([1.0, 1.0, 9.0])):
        cut = html_text.two_means(values)
        assert cut == pytest.approx((values[values > cut].mean() + values[values <= cut].mean()) / 2, rel=1e-9)
    assert html_text.two_means(np.full(7, 0.1)) == pytest.approx(0.1)


def test_ratios_decide_without_names(spark, sf):
    """Most pages come out the same without any evidence of names; none does without the threshold and names."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    bare = html_text.HtmlConfig(containers=False, tags=False, marks=False)
    same = sum(html_text.main_text(h, bare) == html_text.main_text(h) for h in pages)
    assert same >= 0.75 * len(pages)
    no_article = html_text.HtmlConfig(containers=False)
    assert all(html_text.main_text(h, no_article) == html_text.main_text(h) for h in pages)


def test_html_of_driver_pages(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in blocks if b)


# toxicity


def test_toxicity_held_out(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        t = [r.choice(words) for _ in range(r.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["badword", "evilstem"]) + r.choice(["", "ung", "heit", "s"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 7 == 0), int(toxic)))
    rows += [(None, "x"), (2000, None), (2001, ""), (2002, "w1 badwordling evilstems " + "w2 " * 300_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit_chain(d, lab.filter("doc_id % 4 <> 1"), scratch_dir(spark), toxicity.ToxicityConfig(features=200))
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score_documents(d, chain).collect()}
    held = [i for i in range(1200) if i % 4 == 1]
    assert sum(got[i] == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert got[2002] and not got[2000] and not got[2001] and not got[None]
    empty = toxicity.fit_chain(d, lab.limit(0), scratch_dir(spark))
    assert not any(x["toxic"] for x in toxicity.score_documents(d, empty).collect())
    assert toxicity.score_documents(d.limit(0), chain).collect() == []


def test_training_sample_is_bounded(spark):
    """Repeated ids and texts, labels without a document and ties: at most cfg.sample rows, each text of an id once."""
    docs = spark.createDataFrame([(1, "a")] * 50 + [(1, f"t{i}") for i in range(50)] + [(2, "b"), (3, None), (None, "c")], "doc_id long, text string").withColumn("_y0", F.lit(9))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 3)] + [(3, None, 1), (3, 0, None), (None, 1, 1)] + [(i, 1, 1) for i in range(100, 400)], "doc_id long, low_quality int, toxic int")
    rows = toxicity.labelled(docs, labels, scratch_dir(spark), toxicity.ToxicityConfig()).collect()
    assert len(rows) == 53 and sorted((r["_y0"], r["_y1"]) for r in rows if r["_id"] == 3) == [(0, 1)]
    assert len(toxicity.labelled(docs, labels, scratch_dir(spark), toxicity.ToxicityConfig(sample=7)).collect()) == 7


def test_chain_agrees_with_a_plain_version(spark):
    """Probabilities of the chain, feature by feature and category by category, from its weights."""
    rows = [(i, " ".join(["good", "word", f"w{i % 7}"] + (["vile"] if i % 3 == 0 else [])), i % 2, int(i % 3 == 0)) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    chain = toxicity.fit_chain(d.select("doc_id", "text"), d.select("doc_id", "low_quality", "toxic"), scratch_dir(spark), toxicity.ToxicityConfig(features=30))
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"], r["toxic"]) for r in toxicity.score_documents(d, chain).collect()}
    import pyarrow as pa

    from wavefold.llm.words import BY_LETTER, word_batches

    names: dict = {}
    for w in ["good", "word", "vile", *[f"w{k}" for k in range(7)]]:
        *_, words = next(word_batches(pa.array([w]), BY_LETTER))
        names[w] = [int(words.hashes[0]), *(int(x) for n in (4, 5, 6, 7) for x in words.prefixes(n)[1])]
    place = {int(h): k for k, h in enumerate(chain.kept)}
    for i, text, *_ in rows:
        x = {place[h] for w in text.split() for h in names[w] if h in place}
        p: list = []
        for weights, dense, intercept in chain.models:
            z = sum(weights[k] for k in x) + sum(a * b for a, b in zip(dense, p, strict=True)) + intercept
            p.append(1 / (1 + np.exp(-z)))
        assert got[i] == (pytest.approx(p[0], abs=1e-6), pytest.approx(p[1], abs=1e-6), p[1] >= 0.5) and got[i][2] == (i % 3 == 0)


# decontamination


def least_edits(p: str, s: str) -> int:
    row = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(s, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_alignment():
    r, cfg = random.Random(3), decontaminate.DecontaminationConfig(window=64)
    for _ in range(300):
        item = decontaminate.normal("".join(r.choice("abcdefgh é") for _ in range(r.randrange(9, 90))))
        if len(item) < cfg.q:
            continue
        ix, k, s = decontaminate.Index([(1, item)], cfg), decontaminate.edit_budget(len(item), cfg), list(item)
        for _ in range(r.randrange(0, k + 3)):
            p, o = r.randrange(len(s)), r.random()
            s[p : p + 1] = ["x"] if o < 0.33 else ["y", s[p]] if o < 0.66 else []
            s = s or ["z"]
        pad = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 90)))
        doc = decontaminate.normal(pad() + "".join(s) + pad())
        got, best = ix.matches(doc), least_edits(item, doc)
        assert bool(got) == (best <= k)
        assert not got or got[0][1] == best


def test_leaks_of_frequent_and_repeated_grams():
    """Runs, items that differ in a few characters, equal items and small windows: as the plain alignment finds them."""
    r = random.Random(11)
    base = "question: which of these is the right answer to number"
    items = [(i, f"{base} {i} of all?") for i in range(30)] + [(50, "=" * 40), (51, "-=" * 20), (52, "a rule ======== of eight"), (53, f"{base} 7 of all?"), (54, "abcabcabcabc")]
    for cfg in (decontaminate.DecontaminationConfig(), decontaminate.DecontaminationConfig(window=200, most_places=3, most_pairs=50)):
        ix = decontaminate.Index(items, cfg)
        assert ix.alike
        for _ in range(60):
            parts = []
            for _ in range(r.randrange(1, 5)):
                s = list(decontaminate.normal(r.choice(items)[1]))
                for _ in range(r.randrange(0, 9)):
                    p, o = r.randrange(len(s)), r.random()
                    s[p : p + 1] = ["x"] if o < 0.4 else ["y", s[p]] if o < 0.7 else []
                    s = s or ["z"]
                parts += ["".join(s), "=" * r.randrange(0, 60), "".join(r.choice("abc =-") for _ in range(r.randrange(0, 50)))]
            doc = decontaminate.normal("".join(parts))
            got = {i: e for i, e, _ in ix.matches(doc)}
            want = {i: e for i, t in items if (e := least_edits(decontaminate.normal(t), doc)) <= decontaminate.edit_budget(len(decontaminate.normal(t)), cfg)}
            assert got == want


def test_leaks_in_long_runs_need_little_memory():
    import tracemalloc

    ix = decontaminate.Index([(1, "=" * 200), (2, "| a | b | ------------------------ |"), (3, "=" * 150 + "x" + "=" * 150)], decontaminate.DecontaminationConfig())
    tracemalloc.start()
    got = {i: e for i, e, _ in ix.matches("=" * 1_000_000 + " " + "-" * 1_000_000)}
    assert got == {1: 0, 3: 1} and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_short_items_are_found_as_whole_words():
    ix = decontaminate.Index([(1, "Yes"), (2, "a b"), (3, ""), (4, "+1"), (5, "yes")], decontaminate.DecontaminationConfig())
    assert ix.matches("eyes yesterday") == [] and ix.matches("") == [] and ix.matches(None) == []
    assert sorted(ix.matches("Oh,  YES!")) == [(1, 0, 7), (5, 0, 7)]
    assert ix.matches("a\n b") == [(2, 0, 3)] and ix.matches("so +1") == [(4, 0, 5)]


def test_leaks_in_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in (r["text"] or "")}
    more = docs.unionByName(spark.createDataFrame([(None, items[0]), (-5, None), (-6, "")], "doc_id long, text string"), allowMissingColumns=True).withColumn("edits", F.lit("clash"))
    bad = bench.unionByName(spark.createDataFrame([(None, "a text without an id"), (77, None), (78, "abc")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(more, bad, scratch_dir(spark), decontaminate.DecontaminationConfig(block_chars=3000)).collect()}
    assert got == want | {(None, 0)}
    kept = decontaminate.drop_leaks(more, bad, scratch_dir(spark), decontaminate.DecontaminationConfig(block_chars=3000))
    assert kept.columns == more.columns and kept.count() == more.count() - len({d for d, _ in want}) - 1


# Jaccard join


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if n and 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
                root[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(least.get(find(k)))) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("cfg", [jaccard_join.JoinConfig(), jaccard_join.JoinConfig(block=200, block_rows=9, leaf=2, fan=2, bitmap=1, sample=2, extra=4, name_bits=4, light_rows=0)])
def test_join_against_all_pairs(spark, cfg):
    r = random.Random(5)
    base = [[r.choice([f"w{i}" for i in range(40)]) for _ in range(r.randrange(0, 60))] for _ in range(25)]
    rows = []
    for i in range(400):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            if w:
                w[r.randrange(len(w))] = r.choice(["W1", "w2", "é"])
        rows.append((i, " ".join(w) if r.random() > 0.03 else None))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + i, f"{passage} " + " ".join(f"q{i}_{k}" for k in range(25))) for i in range(60)]
    rows += [(2000, "one two"), (2001, "ONE  two\n"), (2002, "two one"), (2003, ""), (None, "one two"), (None, "a b c d e f g"), (2005, "a b c d e f g"), (7, "one two"), (2000, "one two")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("component_id", F.lit("clash"))
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in jaccard_join.link_components(d, scratch_dir(spark), cfg).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("cfg", [jaccard_join.JoinConfig(), jaccard_join.JoinConfig(block=300, leaf=2, fan=2, bitmap=1, sample=2, extra=4)])
def test_join_counts_every_link(spark, cfg):
    r = random.Random(8)
    base = [[f"b{j}_{k}" for k in range(60)] for j in range(3)]
    rows = []
    for i in range(240):
        w = list(base[i % 3])
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000, "one two"), (1001, "ONE two"), (1002, ""), (1003, None), (1004, rows[5][1]), (None, rows[5][1])]
    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())((t or "").lower().split()) for _, t in rows]
    close = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    want = sorted((str(i), sum(close(s, o) for k, o in enumerate(sets) if k != n)) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.link_components(d, scratch_dir(spark), cfg).collect()
    assert sorted((str(x["doc_id"]), x["n_links"]) for x in got) == want
    of = {x["doc_id"]: x["class_id"] for x in got}
    assert all((of[i] == of[j]) == (s == o) for (i, _), s in zip(rows, sets, strict=True) for (j, _), o in zip(rows, sets, strict=True) if s and o)


def test_join_one_of_each_and_empty(spark):
    long = "a b c d e f g h i j"
    rows = [(1, long), (2, long), (3, "x"), (3, "x"), (3, "other words"), (4, None), (4, None), (None, "z"), (None, "z"), (None, long), (None, "y"), (9, "y"), (5, ""), (6, "p q"), (7, "r s"), (7, "p q")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept", F.lit("clash"))
    out = jaccard_join.one_of_each(d, scratch_dir(spark))
    want = [(1, long), (3, "x"), (3, "other words"), (4, None), (4, None), (None, "z"), (9, "y"), (5, ""), (6, "p q"), (7, "r s")]
    assert out.columns == d.columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)
    assert jaccard_join.link_components(d.limit(0), scratch_dir(spark)).collect() == []


def test_long_texts_are_cut_between_words():
    import pyarrow as pa

    from wavefold.llm import words

    old, words.PIECE = words.PIECE, 64
    try:
        texts = ["a b c d e f g " * 30, "short one", None, "x" * 50 + " tail words here now yes " * 9, "one two three four five six"]
        cut = [s.tolist() for s in jaccard_join.shingle_sets(pa.array(texts), 5)]
    finally:
        words.PIECE = old
    assert cut == [s.tolist() for s in jaccard_join.shingle_sets(pa.array(texts), 5)]


def test_words_of_any_length_have_one_hash():
    import pyarrow as pa

    from wavefold.llm import words

    long = "".join(chr(97 + i * i % 23) for i in range(200))
    texts = [f"a b c d {long}", long, f"{long} {'y' * 64} {'Z' * 65} tail", f"one {'q' * 40} two {long}漢 three four five " + "six " * 40, "k" * 64, "w " * 31 + "v" * 63 + " x"]

    def found():
        sets = [s.tolist() for s in jaccard_join.shingle_sets(pa.array(texts), 5)]
        letters = [(w.hashes.tolist(), w.prefixes(6)[1].tolist()) for t in texts for *_, w in words.word_batches(pa.array([t]), words.BY_LETTER)]
        return sets, sum((h for h, _ in letters), []), sum((p for _, p in letters), [])

    whole, old = found(), words.PIECE
    assert len(whole[0][0]) == 1
    try:
        words.PIECE = 64
        assert found() == whole
    finally:
        words.PIECE = old


def test_words_have_mixed_names(spark):
    """A Thue-Morse word and its complement, which polynomial sums modulo 2^64 cannot tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, a[:32]), (4, b[:32]), (5, a)]
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), scratch_dir(spark)).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]


def test_sets_that_share_a_class_name_are_told_apart(spark):
    twins = jaccard_join.twin_classes(spark.createDataFrame([(1, 5), (1, 3), (1, 3), (2, 4), (None, None)], "cls long, check long"))
    assert twins == {1: 3} and jaccard_join._renamed(1, 3, twins) == 1 and jaccard_join._renamed(2, 4, twins) == 2
    assert len({jaccard_join._renamed(1, x, twins) for x in (3, 5, 6)}) == 3
    for k in (0, 1):
        assert len({jaccard_join.class_names(np.array([i, 7], np.uint64))[k] for i in range(1000)}) == 1000


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, scratch_dir(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
