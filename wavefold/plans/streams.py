"""Queries that run streams to their end over the driver's tables; their SQL is that of the batch forms."""

from __future__ import annotations

import uuid
from contextlib import nullcontext

from pyspark.sql import functions as F

from wavefold.operators import motion, review
from wavefold.operators.lineage import shared_folder
from wavefold.plans.ingestion import arbitration_rows, chunk_rows
from wavefold.plans.models import motion_samples
from wavefold.plans.registry import ORACLES, query, rounded
from wavefold.schemas import SAMPLE_COLUMNS
from wavefold.sources import driver_tables as T
from wavefold.sources import ingest
from wavefold.streaming import jobs


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, parts, folder, fmt="parquet"):
    """A stream over the rows of each part, one a batch; parts are written one after the other, which is their order."""
    for part in parts:
        part.coalesce(1).write.mode("append").format(fmt).save(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).format(fmt).load(folder)


def _ended(writer, folder, seconds=600, store=jobs.map_store):
    with store(writer._spark):
        q = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if q.awaitTermination(seconds) is False:  # None: without a limit, it has ended
        q.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")


def _appended(spark, df, folder, **ended):
    """What a stream in append mode has written at its end."""
    _ended(df.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder, **ended)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("t03_motion_stream", ORACLES["w18_motion_segments"])
def t03(spark, d):
    s = motion_samples(spark, d).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") / 50))
    folder = _folder(spark)
    parts = [s.filter(F.col("seq").between(a, b)) for a, b in ((0, 19), (20, 47), (48, 1 << 30))]
    found = jobs.segment_motion_stream(_stream(spark, parts, f"{folder}/in"), motion.MotionConfig(rate=10, start_z=1.0, end_z=0.5, start_count=2, end_count=3))
    return _appended(spark, found, folder)


@query("t02_reassemble_stream", ORACLES["t02_reassemble"])
def t02_stream(spark, d):
    c, folder = chunk_rows(spark, d), _folder(spark)
    parts = [c.filter(f"index % 2 = {k}") for k in (0, 1)]  # the odd chunks come last
    return _appended(spark, jobs.reassemble_stream(_stream(spark, parts, f"{folder}/in")), folder).select("id", "total", F.md5("data").alias("digest"))


@query("t05_progress_stream", ORACLES["t05_progress"])
def t05_stream(spark, d):
    c, folder = chunk_rows(spark, d).select("id", F.col("index").cast("int").alias("index"), "total"), _folder(spark)
    parts = [c.filter("index < 1"), c.filter("index < 2"), c.filter("index >= 2")]  # some chunks come twice
    p = jobs.progress_stream(_stream(spark, parts, f"{folder}/in"))
    _ended(p.writeStream.foreachBatch(jobs.latest_sink(f"{folder}/out", "id", every=2)).outputMode("update"), folder)
    return jobs.read_latest(spark, f"{folder}/out", "id").select("id", F.col("received").cast("long").alias("received"), "total")


@query("s21_latest_stream", ORACLES["s21_latest_state"])
def s21_stream(spark, d):
    """The last event of each kind, kept by an update-mode stream; the parts come out of order."""
    e, folder = T.table(spark, d, "events").select("event_type", "event_id", "value", "ts"), _folder(spark)
    parts = [e.filter(f"event_id % 5 = {k}") for k in (3, 0, 4, 1, 2)]
    last = review.latest_state(_stream(spark, parts, f"{folder}/in"), "event_type", "ts")
    _ended(last.writeStream.foreachBatch(jobs.latest_sink(f"{folder}/out", "event_type", every=2)).outputMode("update"), folder)
    return jobs.read_latest(spark, f"{folder}/out", "event_type").select("event_type", "event_id", "value")


@query("t04_arbitrate_stream", ORACLES["t04_arbitrate"])
def t04_stream(spark, d):
    """Arbitration of a device's events as they come, in order of time; the stream stops behind each part and goes on from its checkpoint.

    A quantile sketch marks the ends of the parts: where they lie is of no matter to the routes.
    """
    e, folder = arbitration_rows(spark, d).withColumn("ts", F.timestamp_millis(F.col("ts_ms").cast("long"))), _folder(spark)
    a, b = e.agg(F.percentile_approx("ts_ms", F.array(F.lit(0.4), F.lit(0.7)))).first()[0] or (0.0, 0.0)
    for part in (F.col("ts_ms") <= a, (F.col("ts_ms") > a) & (F.col("ts_ms") <= b), F.col("ts_ms") > b):
        e.filter(part).write.mode("append").parquet(f"{folder}/in")
        out = jobs.arbitrate_stream(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), voice_threshold=0.045, cooldown_ms=40000000.0)
        found = _appended(spark, out, folder, seconds=None, store=nullcontext)  # all files of the part are one batch; a row of state a bucket needs no map
    return found.select(F.col("device").cast(e.schema["device"].dataType).alias("device"), "ts_ms", "route")


@query("t06_late_chunks", ORACLES["t02_reassemble"].replace("conv_id % 5 <> 0", "conv_id % 5 <> 0 AND conv_id % 7 <> 0"))
def t06(spark, d):
    """Every seventh conversation's last chunk comes behind the watermark and is dropped, so its message never ends."""
    c, folder = chunk_rows(spark, d), _folder(spark)
    last, late = F.col("index") == F.col("total") - 1, F.col("id").cast("long") % 7 == 0
    clock = lambda n: c.limit(1).select(F.lit("clock").alias("id"), F.lit(n).alias("index"), F.lit(3).alias("total"), "data", F.timestamp_seconds(F.lit(1_700_010_000)).alias("ts"))
    # Rows are late by the watermark of the batch before, so the clock is seen twice.
    parts = [c.filter(~last), c.filter(last & ~late), clock(0), clock(1), c.filter(last & late)]
    return _appended(spark, jobs.reassemble_stream(_stream(spark, [p.select(c.columns) for p in parts], f"{folder}/in")), folder).select("id", "total", F.md5("data").alias("digest"))


def _messages(spark, d):
    """Events as messages (topic, value, ts) of all kinds, and some on a topic that nobody asks for."""
    e = T.table(spark, d, "events")
    k, v = F.col("event_id") % 10, F.col("value").cast("string")
    sample = F.concat(F.lit('{"gx":'), v, F.lit(',"gy":1,"gz":2,"ax":3,"ay":4,"az":9.8}'))
    chunk = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","index":0,"total":1,"data":"'), F.hex(F.encode(v, "UTF-8")), F.lit('"}'))
    payload = (
        F.when(k == 0, F.concat(F.lit('{"type":"imu","data":{"samples":['), sample, F.lit('],"count":1}}'))).when(k == 1, F.concat(F.lit("["), sample, F.lit(","), sample, F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"data":{"samples":['), sample, F.lit("]}}"))).when(k == 3, F.concat(F.lit('{"type":"imu","data":{"samples":['), sample, F.lit('],"count":3}}')))
        .when(k == 4, '{"type":"voice_mfcc","data":{"shape":[40,49],"features":[]}}').when(k == 5, chunk)
        .when(k == 6, F.concat(F.lit('{"audio_base64":"'), F.base64(F.encode(v, "UTF-8")), F.lit('"}'))).when(k == 7, F.concat(F.lit("RIFF"), v)).when(k == 8, "{}").otherwise("x")
    )
    topic = F.concat(F.lit("esp32/dev"), F.col("user_id").cast("string"), F.when(k.isin(4, 5, 6, 7), "/viz/mic").when(k == 9, "/state/battery").otherwise("/sensor/imu"))
    return e.select(topic.alias("topic"), F.encode(payload, "UTF-8").alias("value"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _message_stream(spark, d, folder):
    m = _messages(spark, d)
    for part in (m.filter("event_id % 3 = 0"), m.filter("event_id % 3 <> 0")):
        ingest.write_messages(part.coalesce(1), f"{folder}/in")
    return ingest.message_stream(spark, "json", f"{folder}/in", "^esp32/[^/]+/(sensor/imu|viz/mic)$", maxFilesPerTrigger="1")


_M = "WITH m AS (SELECT *, event_id % 10 AS k, 'esp32/dev' || user_id || CASE WHEN event_id % 10 IN (4, 5, 6, 7) THEN '/viz/mic' ELSE '/sensor/imu' END AS topic FROM events WHERE event_id % 10 <> 9)"


@query(
    "t01_serve",
    _M + """ SELECT topic, 'action' AS outcome, CAST(CASE k WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS size, count(*) AS n FROM m WHERE k IN (0, 1, 2) GROUP BY ALL
    UNION ALL SELECT topic, 'keyword', CAST(length(CAST(value AS VARCHAR)) + CASE k WHEN 7 THEN 4 ELSE 0 END AS BIGINT), count(*) FROM m WHERE k IN (6, 7) GROUP BY ALL
    UNION ALL SELECT topic, CASE k WHEN 3 THEN 'count_mismatch' WHEN 4 THEN 'shape' ELSE 'route' END, -1, count(*) FROM m WHERE k IN (3, 4, 8) GROUP BY ALL""",
)
def t01(spark, d):
    """The whole loop: messages of all routes come in, results and errors go out. The handlers give sizes, which stand for classes here."""
    folder = _folder(spark)
    answer = lambda rows, kind, size: rows.select("device", F.lit(kind).alias("kind"), size.cast("string").alias("label"), F.lit(1.0).alias("confidence"), F.col("topic").alias("source_topic"))
    handlers = {
        "imu": lambda r: answer(r, "action", F.size(F.from_json(F.get_json_object("packet", "$.data.samples"), "array<string>"))),
        "clip": lambda r: answer(r, "keyword", F.length("data")),
    }
    q = jobs.serve(_message_stream(spark, d, folder), handlers, f"{folder}/results", f"{folder}/errors", f"{folder}/checkpoint", availableNow=True)
    if not q.awaitTermination(600):
        q.stop()
        raise TimeoutError("the loop did not end")
    done = spark.read.schema("topic string, value string").json(f"{folder}/results/*").select(F.from_json("value", "type string, data struct<label: string, source_topic: string>").alias("v"))
    done = done.select(F.col("v.data.source_topic").alias("topic"), F.col("v.type").alias("outcome"), F.col("v.data.label").cast("long").alias("size"))
    bad = spark.read.schema("topic string, payload string, reason string").json(f"{folder}/errors/*").select("topic", F.col("reason").alias("outcome"), F.lit(-1).cast("long").alias("size"))
    return done.unionByName(bad).groupBy("topic", "outcome", "size").agg(F.count(F.lit(1)).alias("n"))


@query("t01_chunk_clips", _M + " SELECT CAST(event_id AS VARCHAR) AS id, md5(CAST(value AS VARCHAR)) AS digest FROM m WHERE k = 5")
def t01_chunks(spark, d):
    """Chunk messages of the loop, put together by the stateful stream."""
    folder = _folder(spark)
    # A day of patience: the events of a user lie days apart, and none of them is late.
    clips = jobs.reassemble_stream(jobs.chunk_messages(_message_stream(spark, d, folder)), ttl_s=400 * 86400)
    return _appended(spark, clips, folder).select("id", F.md5("data").alias("digest"))


@query("s15_message_stream", _M + " SELECT topic, count(*) AS n, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us FROM m GROUP BY topic")
def s15(spark, d):
    folder = _folder(spark)
    m = _appended(spark, _message_stream(spark, d, folder), folder)
    return m.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_us"))


@query(
    "s19_capture",
    _M + """ SELECT 'dev' || user_id AS device, strftime(ts, '%Y%m%d') AS day, CASE WHEN k IN (4, 5, 6, 7) THEN 'mic' ELSE 'imu' END AS kind, count(*) AS raw,
    count(*) FILTER (k IN (0, 1, 2)) AS processed FROM m GROUP BY ALL""",
)
def s19(spark, d):
    folder = _folder(spark)
    good = lambda rows: jobs.packets.validate_packets(jobs.typed_messages(rows).filter("route like 'imu%'"), "packet").filter("reason is null").select("stem", "device", "day", "packet")
    _ended(_message_stream(spark, d, folder).writeStream.foreachBatch(jobs.capture_sink(f"{folder}/kept", "s1", good)), folder)
    raw = spark.read.parquet(f"{folder}/kept/raw").filter("session = 's1'")
    done = spark.read.parquet(f"{folder}/kept/processed").groupBy("device", "day").agg(F.count(F.lit(1)).alias("done"))
    g = raw.groupBy("device", F.col("day").cast("string").alias("day"), "kind").agg(F.count(F.lit(1)).alias("raw"))
    return g.join(done, ["device", "day"], "left").select("device", "day", "kind", "raw", F.when(F.col("kind") == "imu", F.coalesce("done", F.lit(0))).otherwise(0).cast("long").alias("processed"))


_R = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SAMPLE_COLUMNS[4:])


@query("s16_write_read", "WITH " + T.SAMPLES_SQL + f" SELECT measurement_id, sequence_id, label_id, label, {_R} FROM samples")
def s16(spark, d):
    """Samples written as CSV, by label, and read again with their columns checked."""
    folder = _folder(spark)
    ingest.write_samples(T.samples(spark, d).withColumn("part", F.col("label")), f"{folder}/csv", "csv", ("part",))
    return rounded(ingest.read_samples(spark, f"{folder}/csv"), *SAMPLE_COLUMNS[4:], digits=6)
