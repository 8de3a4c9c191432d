"""Queries of sources, sinks, messages and streams' batch forms (S, P10-P12, T)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavefold.operators import clean, packets
from wavefold.operators.lineage import shared_folder
from wavefold.plans.cleaning import _AX, _S
from wavefold.plans.registry import query, rounded
from wavefold.sources import driver_tables as T
from wavefold.sources import ingest

_R6 = ", ".join(f"round({a}, 6) + 0.0 AS {a}" for a in _AX)
_BACK = _S + f" SELECT measurement_id AS file, CAST(0 AS INTEGER) AS block, sequence_id AS seq, {_R6} FROM samples"


def _back(df):
    return rounded(df.select(F.col("file").cast("long").alias("file"), F.col("block").cast("int").alias("block"), F.col("seq").cast("int").alias("seq"), *_AX), *_AX, digits=6)


def _rendered(spark, d):
    return ingest.render_packets(T.samples(spark, d)).select(F.col("measurement_id").cast("string").alias("file"), "text")


def _lines(spark, d, sep: str):
    line = F.format_string(sep.join(["%.6f"] * 6), *[F.col(a) for a in _AX])
    g = T.samples(spark, d).groupBy("measurement_id").agg(F.sort_array(F.collect_list(F.struct("sequence_id", line.alias("l")))).alias("x"))
    return g.select(F.col("measurement_id").cast("string").alias("file"), F.array_join("x.l", "\n").alias("body"))


@query("s02_parse_packets", _BACK)
def s02(spark, d):
    return _back(ingest.parse_packets(_rendered(spark, d)))


@query("s18_render_packets", _S + " SELECT measurement_id, md5('==== Gesture Packet ====' || chr(10) || 'Sample count: ' || count(*) || chr(10) || 'Idx | gx | gy | gz | ax | ay | az' || chr(10) || string_agg(sequence_id || ' | ' || format('{:.6f} | {:.6f} | {:.6f} | {:.6f} | {:.6f} | {:.6f}', gyro_x, gyro_y, gyro_z, acc_x, acc_y, acc_z), chr(10) ORDER BY sequence_id) || chr(10) || '========================' || chr(10)) AS digest FROM samples GROUP BY measurement_id")
def s18(spark, d):
    return ingest.render_packets(T.samples(spark, d)).select("measurement_id", F.md5("text").alias("digest"))


@query("s03_parse_marked", _BACK)
def s03(spark, d):
    t = _lines(spark, d, ", ").select("file", F.concat(F.lit("9, 9, 9, 9, 9, 9\n t YPR(deg)-X gx\n---\n\n"), "body").alias("text"))
    return _back(ingest.parse_marked(t))


@query("s04_parse_plain", _BACK)
def s04(spark, d):
    return _back(ingest.parse_plain(_lines(spark, d, " ").select("file", F.col("body").alias("text"))))


@query("s05_parse_auto", _S + " SELECT measurement_id AS file, CASE measurement_id % 3 WHEN 0 THEN 'packet' WHEN 1 THEN 'marked' ELSE 'plain' END AS parser, count(*) AS n, round(sum(gyro_x), 4) + 0.0 AS total FROM samples GROUP BY ALL")
def s05(spark, d):
    k = F.col("file").cast("long") % 3
    lines = _lines(spark, d, ",")
    t = _rendered(spark, d).filter(k == 0).unionByName(lines.filter(k == 1).select("file", F.concat(F.lit("YPR(deg)-X\n"), "body").alias("text"))).unionByName(lines.filter(k == 2).select("file", F.col("body").alias("text")))
    p = ingest.parse_auto(t)
    return rounded(p.groupBy(F.col("file").cast("long").alias("file"), "parser").agg(F.count(F.lit(1)).alias("n"), F.sum("gyro_x").alias("total")), "total")


@query("s01_read_samples", _S + f" SELECT measurement_id, sequence_id, label_id, label, {_R6} FROM samples")
def s01(spark, d):
    """The table as CSV files with a further column: checked, cut to its columns, typed."""
    folder = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    T.samples(spark, d).withColumn("more", F.lit("x")).write.option("header", True).csv(folder)
    return rounded(ingest.read_samples(spark, folder), *_AX, digits=6)


@query("s06_label_from_folder", "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) SELECT page_id, host AS label, CAST(dense_rank() OVER (ORDER BY host) - 1 AS INTEGER) AS label_id FROM p")
def s06(spark, d):
    p = T.table(spark, d, "pages").select(F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("/"), F.col("page_id").cast("string")).alias("p0"))
    out = ingest.label_from_folder(p.select(F.concat(F.lit("root/"), "p0").alias("path")), {})
    return out.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("page_id"), "label", "label_id")


@query("s07_zip_wide", "SELECT vec_id AS measurement_id, CAST(s AS INTEGER) AS sequence_id, label AS label_id, " + ", ".join(f"round(CAST(embedding[{8 * i} + s + 1] AS DOUBLE), 6) + 0.0 AS {a}" for i, a in enumerate(_AX)) + " FROM embeddings, range(8) g(s)")
def s07(spark, d):
    e = T.table(spark, d, "embeddings")
    axes = [e.select(F.col("vec_id").alias("line"), F.slice("embedding", 8 * i + 1, 8).cast("array<double>").alias("values")) for i in range(6)]
    return rounded(ingest.zip_wide(axes, e.select(F.col("vec_id").alias("line"), (F.col("label") + 1).alias("label"))), *_AX, digits=6)


@query("s08_import_actions", "WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0), c AS (SELECT id, count(l_orderkey) AS n FROM a LEFT JOIN lineitem ON l_orderkey = id GROUP BY id) SELECT id, n, n >= 5 AS imported FROM c")
def s08(spark, d):
    actions = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), "l_quantity")
    kept, skipped = clean.import_actions(actions, rows, actions.filter("id % 11 = 0"), 5)
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("imported", F.lit(True)).unionByName(skipped.withColumn("imported", F.lit(False)))


@query(
    "s09_manifest",
    """WITH f AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 4 <> 3), o AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS ordinal FROM f)
    SELECT 'data/' || source || '/' || lang || '/clip_' || doc_id || '.wav' AS path, lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id, source,
      'speaker_' || lpad(CAST(ordinal // 5 + 1 AS VARCHAR), 3, '0') AS speaker_local_id, source || '_speaker_' || lpad(CAST(ordinal // 5 + 1 AS VARCHAR), 3, '0') AS speaker_id, CAST(ordinal % 5 + 1 AS INTEGER) AS utterance_id FROM o""",
)
def s09(spark, d):
    ext = F.when(F.col("doc_id") % 4 == 3, ".txt").otherwise(".wav")
    files = T.table(spark, d, "documents").select(F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("/clip_"), F.col("doc_id").cast("string"), ext).alias("path"))
    return ingest.build_manifest(files, "data")


@query("s10_reviewed_roots", "SELECT source AS session, count(*) FILTER (doc_id % 3 = 0) AS samples FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 3 = 0 AND lang = 'de') > 0")
def s10(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "voice").otherwise("gesture")
    files = T.table(spark, d, "documents").select(F.concat_ws("/", "source", kind, "lang", F.col("doc_id").cast("string")).alias("path"))
    return ingest.reviewed_roots(files, "", "voice", ("DE",))


@query("s11_latest_dated", "SELECT strftime(max(o_orderdate), '%Y%m%d') AS latest FROM orders")
def s11(spark, d):
    o = T.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("name"))
    bad = o.limit(1).select(F.explode(F.array(F.lit("99999999"), F.lit("20251301"), F.lit("2025"), F.lit("notadate"))).alias("name"))
    return ingest.latest_dated(o.unionByName(bad))


@query("s12_class_from_name", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'special' WHEN contains(p_name, 'ring') THEN 'Ring' WHEN contains(p_name, 'gear') THEN 'Gear' WHEN contains(p_name, 'red') THEN 'Red' END AS cls FROM part")
def s12(spark, d):
    rows = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for i, (a, c) in enumerate((("ring", "Ring"), ("gear", "Gear"), ("red", "Red")))])
    aliases = spark.range(1).select(F.inline(rows))
    p = T.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "pronunciation_en_special_1.mp3").otherwise(F.col("p_name")).alias("name"))
    return ingest.class_from_name(p, aliases).select("p_partkey", "cls")


@query("s13_review_metadata", "SELECT CAST(event_id AS VARCHAR) AS sample_id, CASE i WHEN 0 THEN 'click' ELSE 'view' END AS label, CAST(i AS INTEGER) AS \"index\", CASE i WHEN 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS probability, event_type = 'click' AS is_correct FROM events, range(2) g(i)")
def s13(spark, d):
    prob = lambda name, i, p: F.struct(F.lit(name).alias("label"), F.lit(i).alias("index"), F.lit(p).alias("probability"))
    rec = F.struct(
        F.col("event_id").cast("string").alias("sample_id"), F.lit("voice").alias("kind"), F.unix_timestamp("ts").cast("double").alias("created_at"),
        F.struct(F.lit("click").alias("label"), F.lit(0.75).alias("confidence"), F.array(prob("click", 0, 0.75), prob("view", 1, 0.25)).alias("probabilities")).alias("prediction"),
        F.struct(F.lit("reviewed").alias("status"), (F.col("event_type") == "click").alias("is_correct")).alias("review"),
    )
    out = ingest.read_review_metadata(T.table(spark, d, "events").select(F.to_json(rec).alias("json")))
    return out.select("sample_id", "label", "index", "probability", "is_correct")


@query("s14_run_summaries", "SELECT 'tag' || user_id AS tag, arg_max(value, ts) AS gesture_accuracy, arg_max(value / 2, ts) AS gesture_total_mean_ms, arg_max(value * 2, ts) AS voice_accuracy, CAST(NULL AS DOUBLE) AS voice_total_mean_ms FROM events GROUP BY user_id")
def s14(spark, d):
    e = T.table(spark, d, "events")
    summary = F.struct(
        F.struct(F.struct(F.col("value").alias("accuracy"), (F.col("value") / 2).alias("total_mean_ms")).alias("summary")).alias("gesture"),
        F.struct(F.struct((F.col("value") * 2).alias("accuracy")).alias("summary")).alias("voice"),
    )
    return ingest.run_summaries(e.select(F.concat(F.lit("tag"), F.col("user_id").cast("string")).alias("tag"), F.col("ts").alias("modified"), F.to_json(summary).alias("json")))


@query("s17_append_measurements", _S + ", n AS (SELECT *, (SELECT max(measurement_id) + 1 FROM samples) + dense_rank() OVER (ORDER BY measurement_id) - 1 AS id FROM samples WHERE measurement_id % 2 = 1) SELECT measurement_id, sequence_id FROM samples UNION ALL SELECT id, sequence_id FROM n")
def s17(spark, d):
    s = T.samples(spark, d).select("measurement_id", "sequence_id")
    return clean.append_measurements(s, s.filter("measurement_id % 2 = 1"))


def _messages(spark, d):
    e = T.table(spark, d, "events")
    k, v = F.col("event_id") % 8, F.col("value").cast("string")
    axis = lambda a, x: F.concat(F.lit(f'"{a}":'), x)
    s = F.concat(F.lit("{"), F.concat_ws(",", axis("gx", v), *[axis(a, F.lit("1.5")) for a in ("gy", "gz", "ax", "ay")], axis("az", F.when(k == 3, "true").otherwise("9.8"))), F.lit("}"))
    imu = lambda n: F.concat(F.lit('{"type":"imu","data":{"samples":['), s, F.lit(","), s, F.lit(f'],"count":{n}}}}}'))
    conf = F.concat(F.lit('{"type":"action","data":{"label":"x","confidence":'), (F.col("value") / 100).cast("string"), F.lit("}}"))
    payload = F.when(k.isin(0, 3), imu(2)).when(k == 1, imu(5)).when(k == 2, '{"type":"imu","data":{"samples":[],"count":0}}').when(k == 4, conf).when(k == 5, '{"type":"other","data":{}}').when(k == 6, '{"data":{}}').otherwise('{"type":"imu","data":3}')
    return e.select("event_id", payload.alias("payload"))


@query("p10_validate_packets", "SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'count_mismatch' WHEN 2 THEN 'no_samples' WHEN 3 THEN 'sample_type' WHEN 4 THEN CASE WHEN value > 100 THEN 'confidence_range' END WHEN 5 THEN 'unknown_type' WHEN 6 THEN 'type' WHEN 7 THEN 'data' END AS reason FROM events")
def p10(spark, d):
    return packets.validate_packets(_messages(spark, d)).select("event_id", "reason")


@query("p11_route_payloads", "SELECT event_id, ['imu_list', 'imu_packet', 'imu_nested', 'mfcc_packet', 'mfcc_nested', 'chunk', 'base64_file', 'raw_bytes', 'error'][event_id % 9 + 1] AS route FROM events")
def p11(spark, d):
    texts = ['[{"gx":1}]', '{"type":"imu","data":{"samples":[]}}', '{"samples":[{"gx":1}]}', '{"type":"voice_mfcc","data":{"shape":[40,50]}}', '{"data":{"features":[]}}', '{"id":"a","index":0,"total":1,"data":"00"}', '{"audio_base64":"AAAA"}', "RIFF....", '{"x":1}']
    kinds = ["imu", "imu", "imu", "voice", "voice", "voice", "voice", "voice", "imu"]
    at = (F.col("event_id") % 9 + 1).cast("int")
    e = T.table(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(t) for t in texts]), at).alias("payload"), F.element_at(F.array(*[F.lit(k) for k in kinds]), at).alias("kind"))
    return packets.route_payload(e).select("event_id", "route")


@query("p12_readable_split", "SELECT page_id, length(url) % 7 = 0 AS dropped FROM pages")
def p12(spark, d):
    p = T.table(spark, d, "pages").select("page_id", F.when(F.length("url") % 7 == 0, "undecodable").alias("error"))
    keep, drop = packets.split_readable(p)
    return keep.withColumn("dropped", F.lit(False)).unionByName(drop.select("page_id", F.lit(True).alias("dropped")))


def chunk_rows(spark, d):
    """Turns of conversations as chunks, one a second; every fifth conversation lacks its last chunk."""
    from pyspark.sql import Window

    c = T.table(spark, d, "conversations").filter("text is not null")
    w = Window.partitionBy("conv_id")
    c = c.withColumn("index", F.row_number().over(w.orderBy("turn", "text")) - 1).withColumn("total", F.count(F.lit(1)).over(w).cast("int"))
    c = c.filter(~((F.col("conv_id") % 5 == 0) & (F.col("index") == F.col("total") - 1)))
    return c.select(F.col("conv_id").cast("string").alias("id"), "index", "total", F.encode("text", "UTF-8").alias("data"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("index")).alias("ts"))


@query("t02_reassemble", "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS total, md5(string_agg(text, '' ORDER BY turn, text)) AS digest FROM conversations WHERE text IS NOT NULL AND conv_id % 5 <> 0 GROUP BY conv_id")
def t02(spark, d):
    return packets.reassemble(chunk_rows(spark, d)).select("id", "total", F.md5("data").alias("digest"))


@query("t05_progress", "WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE text IS NOT NULL) SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS received, CAST(max(total) AS INTEGER) AS total FROM c WHERE NOT (conv_id % 5 = 0 AND i = total - 1) GROUP BY conv_id")
def t05(spark, d):
    return packets.progress(chunk_rows(spark, d))


@query(
    "t04_arbitrate",
    """WITH RECURSIVE s AS (SELECT user_id AS device, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ts_ms, value / 40 > 1.2 AS m, (event_id % 10) / 100 > 0.045 AS v FROM events),
    w AS (SELECT device, ts_ms, CASE WHEN m AND NOT v THEN 'gesture' WHEN v AND NOT m THEN 'voice' WHEN m AND v THEN 'gesture' ELSE 'none' END AS wanted FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts_ms, wanted) AS k FROM w WHERE wanted <> 'none'),
    f(device, k, ts_ms, last, route) AS (SELECT device, k, ts_ms, ts_ms, wanted FROM o WHERE k = 1
      UNION ALL SELECT o.device, o.k, o.ts_ms, CASE WHEN o.ts_ms - f.last >= 40000000 THEN o.ts_ms ELSE f.last END, CASE WHEN o.ts_ms - f.last >= 40000000 THEN o.wanted ELSE 'none' END FROM f JOIN o ON o.device = f.device AND o.k = f.k + 1)
    SELECT device, ts_ms, route FROM f UNION ALL SELECT device, ts_ms, wanted FROM w WHERE wanted = 'none'""",
)
def t04(spark, d):
    return packets.arbitrate(arbitration_rows(spark, d), voice_threshold=0.045, cooldown_ms=40000000.0)


def arbitration_rows(spark, d):
    e = T.table(spark, d, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    return e.select(F.col("user_id").alias("device"), ms.alias("ts_ms"), (F.col("value") / 40).alias("motion"), ((F.col("event_id") % 10) / 100).alias("voice"))


@query(
    "t07_session_stats",
    "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, epoch_us(min(ts)) AS start_us FROM s GROUP BY user_id, s",
)
def t07(spark, d):
    s = packets.session_stats(T.table(spark, d, "events"), "user_id", "ts", "value", "6 hours")
    return rounded(s.select("user_id", "n", "mean", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us")), "mean")


@query("s20_result_packets", "SELECT 'results/dev' || user_id || '/action' AS topic, event_type AS label, least(1.0, value / 100) AS confidence FROM events")
def s20(spark, d):
    e = T.table(spark, d, "events").select(F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("device"), F.lit("action").alias("kind"), F.col("event_type").alias("label"), (F.col("value") / 100).alias("confidence"), F.lit("esp32/imu").alias("source_topic"))
    r = packets.result_packets(e)
    return r.select("topic", F.get_json_object("value", "$.data.label").alias("label"), F.get_json_object("value", "$.data.confidence").cast("double").alias("confidence"))
