"""The corpus pipeline against what each stage has to keep."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from wavefold.llm import jaccard_join, mixing, token_count
from wavefold.llm.shared import scratch_dir, table, written


def test_stages(spark, sf):
    docs, folder = table(spark, sf, "documents"), scratch_dir(spark)
    bench = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, sf), folder, f"s{n}")
        if n < 4:
            assert out.columns == docs.columns
        if name == "near duplicates":
            c = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs, scratch_dir(spark)).collect()}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, k in c.items() if d == k)
        elif name == "decontamination":
            gone = docs.join(out, "doc_id", "left_anti").collect()
            assert gone and all(any(t in r["text"] for t in bench) for r in gone)
            assert not any(t in (r["text"] or "") for r in out.collect() for t in bench)
        elif name == "mixing":
            want = {r["doc_id"]: r["repetitions"] for r in mixing.mix(mixing.sized(docs)).collect() if r["repetitions"]}
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
        elif name == "token output":
            tok = token_count.load(public_tokenizers.path("word_bpe_49k.json"))
            n_tokens = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
            rows = sorted(out.collect(), key=lambda r: r["start"])
            assert [r["n_tokens"] for r in rows] == [n_tokens[r["doc_id"]] for r in rows]
            assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows][:-1]]).tolist()
            assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in docs.collect())
        docs = out


def test_run_gives_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.filter(F.col("n_tokens") < 1).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, repeated rows, equal and null ids, an empty and a very long text, further columns; then no rows at all."""
    docs = table(spark, sf, "documents")
    rows = [(None, None, None, None, None), (None, "some words of a text without an id", "en", "web", 9), (-5, "", "en", None, 0), (-5, "", "en", None, 0), (-6, "long " * 300_000, None, "web", None), (-7, "one text", "en", "a", 1), (-7, "another text", "en", "a", 1), (-7, "another text", "en", "a", 1)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(kinds[c]) for c in docs.columns])
    extra = {c: F.lit("clash") for c in ("_kept", "near_id", "plan_cut", "toxic", "component_id", "key", "size")}
    for given in (docs.unionByName(odd).withColumns(extra), docs.limit(0).withColumns(extra)):
        now, folder, some = given, scratch_dir(spark), not given.isEmpty()
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = written(stage(spark, now, sf), folder, f"s{n}")
            if n < 4:
                assert out.columns == given.columns, name
            kept = out.filter("doc_id < 0 or doc_id is null").groupBy("doc_id").count().collect() if some else []
            count = {r["doc_id"]: r["count"] for r in kept}
            if name in ("toxicity", "near duplicates", "decontamination") and some:
                # All odd rows are clean; of the two equal texts of -7 one stays, as do all rows without words.
                assert count == {None: 2, -5: 2, -6: 1, -7: 3 if name == "toxicity" else 2}, name
            assert some or out.isEmpty()
            now = out
