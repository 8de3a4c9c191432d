"""Messages: validation with reasons, routing by payload kind, chunk reassembly, arbitration.

The batch forms here and the stateful ones in wavefold.streaming give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefold.operators.lineage import cut, follow

#: What any packet holds, read by one parse; numbers stay texts until they are checked.
PACKET = "type string, data struct<samples: array<map<string, string>>, count: string, shape: array<string>, features: array<array<string>>, label: string, confidence: string>"
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _int(x: Column) -> Column:
    return x.rlike(r"^-?\d+$")


def validate_packets(df: DataFrame, payload: str = "payload", results: tuple[str, ...] = ("action", "keyword")) -> DataFrame:
    """Rows with reason: null for a good packet, else the first rule that fails (by packet type).

    ``results`` are the types of classification packets.
    """
    packet = F.from_json(payload, PACKET)
    kind, data = packet["type"], packet["data"]
    samples, count, shape, rows, conf = data["samples"], data["count"], data["shape"], data["features"], data["confidence"]
    axes = ("gx", "gy", "gz", "ax", "ay", "az")
    bad_axis = F.exists(samples, lambda s: F.array_contains(F.array(*[F.coalesce(F.element_at(s, a), F.lit("")).rlike(_NUMBER) for a in axes]), False))
    n = F.size(samples)
    imu = (
        F.when(samples.isNull() | (n <= 0), "no_samples").when(~F.coalesce(_int(count), F.lit(False)), "count_type").when(bad_axis, "sample_type").when(count.try_cast("int") != n, "count_mismatch")
    )
    mfcc = (
        F.when(F.coalesce(F.size(shape), F.lit(-1)) != 2, "shape").when(F.array_join(shape, ",") != "40,50", "shape").when(rows.isNull(), "features_type")
        .when(F.size(rows) != 40, "row_count").when(F.exists(rows, lambda r: F.size(r) != 50), "row_length").when(F.exists(F.flatten(rows), lambda v: ~F.coalesce(v, F.lit("")).rlike(_NUMBER)), "value_type")
    )
    cls = (
        F.when(F.trim(F.coalesce(data["label"], F.lit(""))) == "", "label").when(~F.coalesce(conf.rlike(_NUMBER), F.lit(False)), "confidence_type")
        .when(~conf.try_cast("double").between(0.0, 1.0), "confidence_range")
    )
    reason = (
        F.when(kind.isNull(), "type").when(data.isNull(), "data").when(kind == "imu", imu).when(kind == "voice_mfcc", mfcc).when(kind.isin(*results), cls).otherwise("unknown_type")
    )
    return df.withColumn("reason", reason)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null")


def split_readable(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, dropped rows with their error) of a manifest whose decoding reported errors."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def route_payload(df: DataFrame, payload: str = "payload", kind: str = "kind") -> DataFrame:
    """Rows with route, in the order in which payloads are told apart."""
    j = lambda p: F.get_json_object(payload, p)
    text = F.trim(payload)
    is_list, is_object = text.startswith("[") & F.try_parse_json(F.col(payload)).isNotNull(), text.startswith("{") & F.try_parse_json(F.col(payload)).isNotNull()
    nested = F.coalesce(j("$.data"), F.lit("")).startswith("{")
    has = lambda k: F.when(nested, j(f"$.data.{k}")).otherwise(j(f"$.{k}")).isNotNull()
    imu = F.when(is_list, "imu_list").when(~is_object, "error").when((j("$.type") == "imu") & nested, "imu_packet").when(has("samples"), "imu_nested").otherwise("error")
    chunk = has("id") & has("index") & has("total") & has("data")
    encoded = has("audio_base64") | has("base64") | has("audio")
    voice = (
        F.when(is_object & (j("$.type") == "voice_mfcc") & nested, "mfcc_packet").when(is_object & has("features"), "mfcc_nested").when(is_object & chunk, "chunk").when(is_object & encoded, "base64_file").otherwise("raw_bytes")
    )
    return df.withColumn("route", F.when(F.col(kind) == "imu", imu).otherwise(voice))


def reassemble(chunks: DataFrame, ttl_s: float = 30.0) -> DataFrame:
    """(id, message, total, data): messages whose chunks 0..total-1 all came.

    ``chunks`` has id, index, total, data (binary) and ts. Chunks with a bad index
    or total do not count. A gap of more than ``ttl_s`` between chunks of an id
    starts a new message, as does the chunk behind a complete one; of a repeated
    index the last counts; chunks whose total differs from the message's first
    are left out.
    """
    c = chunks.filter("id is not null and trim(id) <> '' and total > 0 and index >= 0 and index < total and data is not null")
    w = Window.partitionBy("id").orderBy("ts", "index")
    gap = (F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")) > ttl_s
    c = c.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("message", F.sum("_new").over(w))
    m = Window.partitionBy("id", "message")
    c = c.withColumn("_total", F.first("total").over(m.orderBy("ts", "index"))).filter("total = _total")
    last = c.withColumn("_r", F.row_number().over(Window.partitionBy("id", "message", "index").orderBy(F.desc("ts")))).filter("_r = 1")
    g = last.groupBy("id", "message", "_total").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("index", "data"))).alias("x")).filter("n = _total")
    joined = F.aggregate("x.data", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return g.select("id", "message", F.col("_total").alias("total"), joined.alias("data"))


def progress(chunks: DataFrame) -> DataFrame:
    """id, received, total of each message so far."""
    return chunks.groupBy("id").agg(F.countDistinct("index").alias("received"), F.max("total").alias("total"))


def arbitrate(df: DataFrame, key: str = "device", motion_threshold: float = 1.2, voice_threshold: float = 0.015, priority: str = "gesture", cooldown_ms: float = 150.0) -> DataFrame:
    """(key, ts_ms, route): none within the cooldown of the last dispatch, else gesture, voice, priority if both, or none.

    Rows that ask for a route are candidates. One whose candidate before it is at
    least the cooldown away dispatches in any case; from there each dispatch leads to the first
    candidate at least the cooldown behind it, which lies within two cooldowns.
    These chains are followed by doubling steps, so a device of any length has no
    task of its own. Of candidates at one time the first by name can dispatch.
    """
    m, v = F.col("motion") > motion_threshold, F.col("voice") > voice_threshold
    wanted = F.when(m & ~v, "gesture").when(v & ~m, "voice").when(m & v, priority).otherwise("none")
    d = df.select(key, F.col("ts_ms").cast("double").alias("ts_ms"), wanted.alias("wanted"))
    asks, idle = d.filter("wanted <> 'none'"), d.filter("wanted = 'none'").select(key, "ts_ms", F.col("wanted").alias("route"))
    if cooldown_ms <= 0:
        return asks.select(key, "ts_ms", F.col("wanted").alias("route")).unionByName(idle)
    times = asks.select(F.col(key).alias("_key"), F.col("ts_ms").alias("at")).distinct()
    reach = f"min(at) over (partition by _key order by at range between {float(cooldown_ms)!r}D following and {2 * float(cooldown_ms)!r}D following)"
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("_key").orderBy("at"))
    nodes = cut(times.select("_key", "at", F.expr(reach).alias("to"), (F.coalesce(gap, F.lit(cooldown_ms)) >= cooldown_ms).alias("root")))
    sent = follow(nodes, nodes.filter("root"), ["_key"])
    rank = F.row_number().over(Window.partitionBy(key, "ts_ms").orderBy("wanted"))
    j = asks.withColumn("_rank", rank).join(sent, F.col(key).eqNullSafe(F.col("_key")) & (F.col("ts_ms") == F.col("at")), "left")
    return j.select(key, "ts_ms", F.when(F.col("at").isNotNull() & (F.col("_rank") == 1), F.col("wanted")).otherwise("none").alias("route")).unionByName(idle)


def session_stats(events: DataFrame, key: str, ts: str, value: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key: start, end, rows and mean value; works on batches and streams with a watermark."""
    s = events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "mean")


def result_packets(df: DataFrame) -> DataFrame:
    """Result messages (topic, value JSON) of classified rows (device, kind, label, confidence, source_topic)."""
    data = F.struct("label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), F.col("device").alias("device_id"), "source_topic")
    return df.select(F.concat(F.lit("results/"), "device", F.lit("/"), "kind").alias("topic"), F.to_json(F.struct(F.col("kind").alias("type"), data.alias("data"))).alias("value"))


def error_packets(df: DataFrame) -> DataFrame:
    """Error messages (topic, value JSON) of dead letters (topic, payload, reason), on the topic they came from below errors."""
    data = F.struct(F.col("reason"), F.col("topic").alias("source_topic"), F.col("payload"))
    return df.select(F.concat(F.lit("errors/"), "topic").alias("topic"), F.to_json(F.struct(F.lit("error").alias("type"), data.alias("data"))).alias("value"))
