"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefold.llm import align, chat, decontaminate, html_text, jaccard_join, merkle, mixing, repeats, search, token_count, token_output, toxicity, url_filter
from wavefold.llm.shared import scratch_dir, table, written

RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    sizes = written(mixing.sized(table(spark, sf_dir, "documents")), folder, "sizes")
    return mixing.mix(sizes, written(mixing.source_plan(sizes), folder, "plan")).select("doc_id", "size", "source_size", "target", "taken")


def token_config() -> token_output.TokenConfig:
    return token_output.TokenConfig(tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark) + "/tokens"
    token_output.write_tokens(table(spark, sf_dir, "documents"), folder, token_config())
    return token_output.read_digests(spark, folder)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard_links(spark, sf_dir).select("doc_id", "n_shingles", "component_id")


def op4_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with class and number of links of each document, which the SQL of the former does not have."""
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), scratch_dir(spark))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch_dir(spark))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.CountConfig(tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit_chain(documents, toxicity_labels(spark, sf_dir), scratch_dir(spark)))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, url_filter.UrlConfig(rules=RULES), scratch_dir(spark))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.read_back(chat.format_conversations(rows)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.digest("doc_id", "source", "lang", "n_chars", lowered)).alias("tampered")
    d = merkle.manifest(documents, scratch_dir(spark), also=(tampered,))
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), "")
    d = d.select("doc_id", "leaf", F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
                 merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = align.AlignConfig(first=public_tokenizers.path("byte_bpe_50k.json"), second=public_tokenizers.path("piece_bpe_32k.model"))
    return align.align_corpus(table(spark, sf_dir, "documents"), scratch_dir(spark), cfg)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeats.remove_repeats(table(spark, sf_dir, "documents"), scratch_dir(spark))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    import corpus_pipeline

    ops = (
        op1_topk_search, op2_mixing, op3_token_output, op4_jaccard_join, op4_jaccard_links, op5_decontamination, op6_token_counts, op7_toxicity, op8_html_text, op9_url_filter, op10_chat_format,
        op11_merkle_manifest, op12_token_alignment, op13_suffix_array_dedup,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x, len(embedding) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.dim = v.dim AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP2 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 3 AS cap,
         1.0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, CASE WHEN lv IS NULL OR lv * weight >= cap THEN cap ELSE lv * weight END AS target
  FROM (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE level * weight <= cap) AS lv FROM l)
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), b AS (
  SELECT d.source, d.key, u.target - u.whole * u.source_size AS share,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), c AS (
  SELECT source, max(key) AS cut FROM b WHERE before + 0.5 < share GROUP BY source
)
SELECT d.doc_id, d.size, u.source_size, CAST(u.target AS DOUBLE) AS target,
       CAST(d.size * least(u.whole + CASE WHEN d.key <= c.cut THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

_OP4 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id
"""

_OP9 = """
WITH p AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), q AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), x AS (
  SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)(co\\.uk|org\\.uk|ac\\.uk|com\\.au|co\\.jp|com\\.br|co\\.in)$')
                 THEN regexp_extract(host, '[^.]*\\.[^.]*$') ELSE regexp_extract(host, '[^.]*$') END AS suffix
  FROM q
), y AS (
  SELECT *, CASE WHEN length(host) - length(suffix) - 1 <= 0 OR host = '.' || suffix THEN host
                 ELSE regexp_extract(left(host, greatest(length(host) - length(suffix) - 1, 0)), '[^.]*$') || '.' || suffix END AS domain
  FROM x
), lab AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, domain, suffix, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM y LEFT JOIN lab ON lab.doc_id = y.page_id GROUP BY host, domain, suffix
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix
), k AS (
  SELECT level, 1 / greatest(0.001, least(0.5, coalesce(CASE WHEN p > 0 AND p < 1 AND room > 0
           THEN ((bbn - b * p) / (p * (1 - p)) - (g - 1)) / room ELSE 0.001 END, 0.001))) - 1 AS strength
  FROM (SELECT level, sum(bad) AS b, sum(bad) / sum(n) AS p, count(*) AS g, sum(bad * bad / n) AS bbn,
               sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room
        FROM (SELECT 's' AS level, n, bad FROM s UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 'h', n, bad FROM h) WHERE n > 0 GROUP BY level)
), kk AS (SELECT coalesce(max(strength) FILTER (level = 's'), 999) AS ks, coalesce(max(strength) FILTER (level = 'd'), 999) AS kd, coalesce(max(strength) FILTER (level = 'h'), 999) AS kh FROM k
), base AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS base FROM s
), sm AS (SELECT suffix, (ks * base + bad) / (ks + n) AS m FROM s, kk, base
), dm AS (SELECT domain, (kd * sm.m + bad) / (kd + n) AS m FROM d JOIN sm USING (suffix), kk
), hm AS (SELECT host, n, (kh * dm.m + bad) / (kh + n) AS m, kh FROM h JOIN dm USING (domain), kk
), j AS (
  SELECT page_id, host, path, m, m - 1.645 * sqrt(m * (1 - m) / (kh + n + 1)) AS bound,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM y JOIN hm USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(m, 6) AS bad_rate, round(bound, 6) AS bad_rate_bound
FROM j
"""

_OP10 = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), l AS (
  SELECT *, max(CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR contains(role, ':') OR contains(role, '### ') OR contains(role, '</turn>')
                     THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS level FROM c
), e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## ') AS t1,
            replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## '), ':', '\\:') AS r1 FROM l
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(10 + sum(CASE WHEN level = 1 THEN length(r1) + length(t1) ELSE length(role) + length(text) END + 14) AS BIGINT) AS formatted_chars,
       true AS round_trip
FROM e GROUP BY conv_id
"""


_OP11 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) for _ in range(8)]), lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))) AS crc
  FROM documents
), e AS (
  SELECT doc_id, source, xor(crc, 4294967295) % 5 = 0 AS changed, text, low,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head
  FROM d
), l AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN changed AND text IS NOT NULL THEN sha256(head || strlen(low) || ':' || low) END AS tampered FROM e
), placed AS (
  SELECT *, 'leaf' AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l
), nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 16, CAST(ceil(n / 16) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16, n
), subs AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, CAST(ceil(n / 16) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
), steps AS (
  SELECT 0 AS tree, source, level, pos,
         coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM nodes WHERE n > 1
  UNION ALL
  SELECT 1, NULL, level, pos,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM tops WHERE n > 1
), fold AS (
  SELECT p.doc_id, p.leaf, p.source, s.pos AS sub_pos, s.subroot, 0 AS tree, 0 AS level, p.pos, coalesce(p.tampered, p.leaf) AS digest, '' AS proof, false AS over
  FROM placed AS p JOIN subs AS s ON s.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT f.doc_id, f.leaf, f.source, f.sub_pos, f.subroot,
         CASE WHEN x.pos IS NULL THEN f.tree + 1 ELSE f.tree END, CASE WHEN x.pos IS NULL THEN 0 ELSE f.level + 1 END,
         CASE WHEN x.pos IS NULL THEN f.sub_pos ELSE f.pos // 16 END,
         CASE WHEN x.pos IS NULL THEN f.digest ELSE sha256(x.lft || f.digest || x.rgt) END, f.proof || coalesce(x.lft || x.rgt, ''), x.pos IS NULL AND f.tree = 1
  FROM fold AS f LEFT JOIN steps AS x ON x.tree = f.tree AND x.level = f.level AND x.pos = f.pos AND (f.tree = 1 OR x.source IS NOT DISTINCT FROM f.source)
  WHERE NOT f.over
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, digest AS folded_root,
       digest = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM fold WHERE over
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _OP11, "op1_topk_search": _OP1, "op2_mixing": _OP2, "op4_jaccard_join": _OP4, "op9_url_filter": _OP9, "op10_chat_format": _OP10}
