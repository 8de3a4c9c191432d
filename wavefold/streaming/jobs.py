"""Streaming jobs: stateful chunk reassembly, motion segments, arbitration, capture and result sinks.

State uses event-time timeouts with a watermark, so bounded runs (availableNow)
end, and idle keys are dropped once the watermark passes their time to live.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from wavefold.operators import packets
from wavefold.operators.motion import MotionConfig


#: The setting of a state store that holds maps and timers, which ``reassemble_stream`` needs.
MAP_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def map_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside have a state store for maps; the session's setting is put back."""
    before = spark.conf.get(MAP_STORE[0], None)
    spark.conf.set(*MAP_STORE)
    try:
        yield
    finally:
        spark.conf.unset(MAP_STORE[0]) if before is None else spark.conf.set(MAP_STORE[0], before)


class _Reassembler(StatefulProcessor):
    """Chunks of a message in a map of their own, so that a chunk is written once however many come."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", "total int, seen double, received int")
        self.parts = handle.getMapState("parts", "index int", "data binary")

    def _forget(self) -> None:
        self.message.clear()
        self.parts.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total, seen, received = self.message.get() if self.message.exists() else (0, 0.0, 0)
        new: dict[int, bytes] = {}  # chunks of this batch that are not written yet
        kept = received > 0  # whether earlier ones are
        done = []
        frame = pd.concat(list(rows)).sort_values(["ts", "index"], kind="stable")
        times = [t.timestamp() for t in frame["ts"]]
        for at, index, of, data in zip(times, frame["index"], frame["total"], frame["data"], strict=True):
            if received and at - seen > self.ttl_s:
                if kept:
                    self.parts.clear()
                new, received, kept = {}, 0, False
            if not received:
                total = int(of)
            if of != total or not 0 <= index < of or data is None:
                continue
            index, seen = int(index), at
            received += index not in new and not (kept and self.parts.containsKey((index,)))
            new[index] = bytes(data)
            if received == total:
                old = {k[0]: bytes(v[0]) for k, v in self.parts.iterator()} if kept else {}
                done.append((key[0], total, b"".join((old | new)[i] for i in range(total))))
                if kept:
                    self.parts.clear()
                new, received, kept = {}, 0, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if received:
            for index, data in new.items():
                self.parts.updateValue((index,), (data,))
            self.message.update((total, seen, received))
            self.handle.registerTimer(int(max(seen * 1000, timerValues.getCurrentWatermarkInMs()) + self.ttl_s * 1000))
        else:
            self._forget()
        if done:
            yield pd.DataFrame(done, columns=["id", "total", "data"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._forget()
        return iter(())

    def close(self) -> None:
        pass


def reassemble_stream(chunks: DataFrame, ttl_s: int = 30) -> DataFrame:
    """(id, total, data) of each message once all its chunks are there.

    ``chunks`` has id, index, total, data and ts. As in the batch form the last
    chunk of an index counts, a changed total is passed over, and an id that is
    idle beyond ``ttl_s`` starts anew. The session's state store must be one that takes
    maps (``MAP_STORE``), set before the stream starts.
    """
    d = chunks.withWatermark("ts", f"{ttl_s} seconds")
    return d.groupBy("id").transformWithStateInPandas(_Reassembler(ttl_s), "id string, total int, data binary", "Append", "EventTime")


_AXES = ["gx", "gy", "gz", "ax", "ay", "az"]
_MOTION_STATE = "n long, ema array<double>, calm array<double>, levels array<double>, tail array<double>, opened long, free long"


def _energies(x: np.ndarray, ema: np.ndarray, first: bool, cfg: MotionConfig) -> tuple[np.ndarray, np.ndarray]:
    """Energies of samples and the moving average behind them; averages of 256 samples at once are one matrix product."""
    acc, out = x[:, 3:], np.empty((len(x), 3))
    lag = np.subtract.outer(np.arange(256), np.arange(256))
    weights = np.where(lag >= 0, cfg.alpha * (1 - cfg.alpha) ** np.maximum(lag, 0), 0.0)
    if first and len(acc):
        ema = acc[0]  # as if it had always been so
    for at in range(0, len(acc), 256):
        part = acc[at : at + 256]
        out[at : at + 256] = weights[: len(part), : len(part)] @ part + (1 - cfg.alpha) ** np.arange(1, len(part) + 1)[:, None] * ema
        ema = out[at + len(part) - 1]
    return np.linalg.norm(x[:, :3], axis=1) + cfg.beta * np.linalg.norm(acc - out, axis=1), ema


def _ends_of_runs(marks: np.ndarray, count: int) -> np.ndarray:
    """Positions whose last ``count`` marks are all set."""
    total = np.r_[0, np.cumsum(marks)]
    return count - 1 + np.flatnonzero(total[count:] - total[:-count] == count) if len(marks) >= count else np.zeros(0, np.int64)


def motion_step(state: tuple | None, x: np.ndarray, cfg: MotionConfig) -> tuple[list[tuple[int, int]], tuple]:
    """Segments (first, samples) that end in the samples x of a device, and the state behind them.

    The state holds the moving average, the calibration or the two levels, the few
    energies that a run of samples can still reach back to, the sample that opened
    a segment (-1: none) and the one from which a run can open the next.
    """
    n, ema, calm, levels, tail, opened, free = state or (0, [0.0] * 3, [], [], [], -1, 0)
    energy, ema = _energies(x, np.array(ema), n == 0, cfg)
    wanted = cfg.calibration - len(calm) if not levels else 0
    calm, energy, end = [*calm, *energy[:wanted].tolist()], energy[wanted:], n + len(x)
    if not levels:
        if len(calm) < cfg.calibration:
            return [], (end, ema.tolist(), calm, [], [], -1, 0)
        mean, sd = float(np.mean(calm)), float(np.std(calm)) + 1e-6
        levels, calm, free = [mean + cfg.start_z * sd, mean + cfg.end_z * sd], [], cfg.calibration
    e = np.r_[tail, energy]
    base = end - len(e)
    opens, closes = base + _ends_of_runs(e > levels[0], cfg.start_count), base + _ends_of_runs(e < levels[1], cfg.end_count)
    found = []
    while True:  # once a segment
        if opened < 0:
            at = np.searchsorted(opens, free + cfg.start_count - 1)
            if at == len(opens):
                break
            opened = int(opens[at])
        pre = min(opened + 1, cfg.pre_roll)
        at = np.searchsorted(closes, opened + 1)
        last = min(opened + cfg.most - pre, int(closes[at]) if at < len(closes) else 1 << 60)
        if last >= end:
            break
        length = pre + last - opened
        if length >= min(cfg.most, cfg.least):
            found.append((opened - pre + 1, length))
        opened, free = -1, last + 1
    keep = max(cfg.start_count, cfg.end_count) - 1
    return found, (end, ema.tolist(), calm, levels, e[max(0, len(e) - keep) :].tolist(), opened, free)


def segment_motion_stream(df: DataFrame, cfg: MotionConfig = MotionConfig(), ttl: str = "30 seconds") -> DataFrame:
    """Streaming form of motion.segment_motion on rows with ts and seq in order by device."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        found, after = motion_step(state.get if state.exists else None, rows[_AXES].to_numpy(float), cfg)
        state.update(after)
        state.setTimeoutTimestamp(int(max(rows["ts"].max().timestamp() * 1000, state.getCurrentWatermarkMs())) + 3_600_000)
        if found:
            yield pd.DataFrame([(key[0], *s) for s in found], columns=["device", "first", "samples"])

    return df.withWatermark("ts", ttl).groupBy("device").applyInPandasWithState(step, "device string, first long, samples long", _MOTION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_ARBITRATION_STATE = "device array<string>, last array<double>, until array<long>"


def arbitrate_stream(df: DataFrame, motion_threshold: float = 1.2, voice_threshold: float = 0.015, priority: str = "gesture", cooldown_ms: float = 150.0, buckets: int = 1024) -> DataFrame:
    """Streaming form of arbitrate on rows (device, ts, ts_ms, motion, voice); the last dispatch of a device is kept for the cooldown at least.

    Devices are dealt to buckets by a hash, and the state of a bucket has its devices that have dispatched and are not idle since. So
    a batch costs one call for each bucket that it touches, however many the devices are.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = {name: (last, until) for name, last, until in zip(*state.get, strict=True)} if state.exists else {}
        rows, watermark = pd.concat(list(frames), ignore_index=True), state.getCurrentWatermarkMs()
        device, names = pd.factorize(rows["device"].to_numpy(object), use_na_sentinel=False)
        names = np.where(pd.isna(names), None, names)
        m, v = rows["motion"].to_numpy() > motion_threshold, rows["voice"].to_numpy() > voice_threshold
        route, time = np.select([m & ~v, v & ~m, m & v], ["gesture", "voice", priority], "none"), rows["ts_ms"].to_numpy(float)
        asks = np.flatnonzero((route != "none") & ~np.isnan(time))
        asks = asks[np.lexsort((route[asks], time[asks], device[asks]))]
        times, edges = time[asks].tolist(), np.searchsorted(device[asks], np.arange(len(names) + 1)).tolist()
        newest = np.full(len(names), watermark)
        np.maximum.at(newest, device, rows["at"].to_numpy())
        sent = []
        for k, (name, seen) in enumerate(zip(names.tolist(), newest.tolist(), strict=True)):
            last = known[name][0] if name in known else float("-inf")
            at = bisect_left(times, last + cooldown_ms, edges[k], edges[k + 1])
            while at < edges[k + 1]:  # once a dispatch
                sent.append(at)
                last = times[at]
                at = bisect_left(times, last + cooldown_ms, at + 1, edges[k + 1])
            known[name] = last, int(seen + max(60_000, cooldown_ms))
        kept = [(name, last, until) for name, (last, until) in known.items() if until > watermark and last > float("-inf")]
        if kept:
            state.update(tuple(map(list, zip(*kept, strict=True))))
            state.setTimeoutTimestamp(max(until for _, _, until in kept))
        elif state.exists:
            state.remove()
        dispatched = np.zeros(len(rows), bool)
        dispatched[asks[sent]] = True
        yield pd.DataFrame({"device": names[device], "ts_ms": time, "route": np.where(dispatched, route, "none").astype(object)})

    d = df.withWatermark("ts", "30 seconds").withColumn("bucket", F.pmod(F.xxhash64("device"), F.lit(buckets))).withColumn("device", F.col("device").cast("string"))
    d = d.select("bucket", "device", "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at"), "ts_ms", "motion", "voice")
    return d.groupBy("bucket").applyInPandasWithState(step, "device string, ts_ms double, route string", _ARBITRATION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress_stream(chunks: DataFrame) -> DataFrame:
    """Update-mode stream of id, received (different chunks so far) and total of each message.

    The state of an id is the numbers of its chunks, so it is bounded by their total.
    """
    return chunks.groupBy("id").agg(F.size(F.collect_set("index")).alias("received"), F.max("total").alias("total"))


def latest_sink(path: str, key: str, order: str | None = None, every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps the last row of each key; ``read_latest`` reads them.

    A row is newer if its batch is or, with ``order``, if that column is greater (ties to the later batch). A batch has a folder of its
    own, which a repeated batch replaces. Each ``every``-th batch is written together with the generation
    before it and the batches since then as a new generation, and what lies behind the generation before is
    deleted. So at most two generations and 2 * ``every`` batches lie there, however long the stream runs.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _last(batch.withColumn("batch", F.lit(number).cast("long")), key, order)
        if number % every:
            last.write.mode("overwrite").parquet(f"{path}/rows={number}")
            return
        before = [f for f in _folders(spark, path) if f[1] < number]
        start = max((n for kind, n in before if kind == "all"), default=-1)
        parts = [f"{path}/{kind}={n}" for kind, n in before if n >= start and (kind == "all" or n > start)]
        if parts:
            last = _last(spark.read.schema(last.schema).parquet(*parts).unionByName(last), key, order)
        last.write.mode("overwrite").parquet(f"{path}/all={number}")
        for kind, n in before:  # a reader may still be at the generation before
            if n < start:
                _delete(spark, f"{path}/{kind}={n}")

    return write


def _last(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    newest = F.struct("batch") if order is None else F.struct(F.col(order), F.col("batch"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(key, "r.*")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Finished generations ("all") and batches ("rows") of a sink with their numbers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(p) if fs.exists(p) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in ("all", "rows") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((kind, int(number)))
    return found


def read_latest(spark: SparkSession, path: str, key: str, order: str | None = None) -> DataFrame:
    """The last row of each key from the newest generation of ``latest_sink`` and the batches behind it."""
    found = _folders(spark, path)
    start = max((n for kind, n in found if kind == "all"), default=-1)
    parts = [f"{path}/{kind}={n}" for kind, n in found if kind == "all" and n == start or kind == "rows" and n > start]
    return _last(spark.read.parquet(*parts), key, order).drop("batch")


def capture_sink(path: str, session: str, processed: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps messages of a session: raw ones, and what ``processed`` makes of them.

    Records lie in ``raw`` and ``processed`` by session, batch and, raw ones, kind of sensor (last part of the topic) and day;
    ``stem`` names one by its time, device and topic. A batch has folders of its own,
    so a repeated one replaces itself. ``processed`` maps rows (stem, kind, device,
    ts, topic, value) to its own columns, stem among them.
    """
    from wavefold.functions.scalar import device_of_topic, path_safe

    def write(batch: DataFrame, number: int) -> None:
        d = batch.withColumn("device", path_safe(F.coalesce(device_of_topic(F.col("topic")), F.lit("unknown")))).withColumn("day", F.date_format("ts", "yyyyMMdd"))
        d = d.withColumn("kind", path_safe(F.element_at(F.split("topic", "/"), -1)))
        d = d.withColumn("stem", F.concat_ws("-", F.date_format("ts", "HHmmssSSS"), "device", path_safe(F.col("topic"))))
        folder = f"session={session}/batch={number}"
        d.write.mode("overwrite").partitionBy("kind", "day").parquet(f"{path}/raw/{folder}")
        if processed is not None:
            processed(d).write.mode("overwrite").parquet(f"{path}/processed/{folder}")

    return write


def typed_messages(messages: DataFrame) -> DataFrame:
    """Rows of messages with device, kind (imu or voice, by topic), payload, route and packet.

    packet is the payload as a typed packet: a bare list or untyped object of
    samples and an untyped object of features are put into one.
    """
    from wavefold.functions.scalar import device_of_topic

    d = messages.withColumn("payload", F.col("value").cast("string")).withColumn("device", F.coalesce(device_of_topic(F.col("topic")), F.lit("unknown")))
    d = packets.route_payload(d.withColumn("kind", F.when(F.col("topic").rlike("/imu$"), "imu").otherwise("voice")))
    data = F.coalesce(F.get_json_object("payload", "$.data"), F.col("payload"))
    samples = F.when(F.col("route") == "imu_list", F.col("payload")).otherwise(F.get_json_object(data, "$.samples"))
    count = F.coalesce(F.get_json_object(data, "$.count"), F.size(F.from_json(samples, "array<string>")).cast("string"))
    imu = F.concat(F.lit('{"type":"imu","data":{"samples":'), samples, F.lit(',"count":'), count, F.lit("}}"))
    mfcc = F.concat(F.lit('{"type":"voice_mfcc","data":'), data, F.lit("}"))
    r = F.col("route")
    return d.withColumn("packet", F.when(r.isin("imu_list", "imu_nested"), imu).when(r == "mfcc_nested", mfcc).when(r.isin("imu_packet", "mfcc_packet"), F.col("payload")))


def chunk_messages(messages: DataFrame) -> DataFrame:
    """(id, index, total, data, ts) of the chunk messages of a stream; ``reassemble_stream`` makes clips of them."""
    d = typed_messages(messages).filter("route = 'chunk'").select("ts", F.coalesce(F.get_json_object("payload", "$.data"), F.lit("")).alias("inner"), "payload")
    one = F.from_json(F.when(F.col("inner").startswith("{"), F.col("inner")).otherwise(F.col("payload")), "id string, index int, total int, data string")
    return d.select(one.alias("c"), "ts").select("c.id", "c.index", "c.total", F.unhex("c.data").alias("data"), "ts")


def send(rows: DataFrame, target: str | dict[str, str], number: int) -> None:
    """Writes the rows of a batch as JSON to a folder of their own below ``target``, which a repeated batch replaces.

    With a dict, messages (topic, value) go to a sink of Spark with these options: a broker unless ``format`` names
    another. A broker gets a repeated batch twice.
    """
    if isinstance(target, str):
        rows.write.mode("overwrite").json(f"{target}/batch={number}")
    else:
        options = {k: v for k, v in target.items() if k != "format"}
        rows.select("topic", "value").write.format(target.get("format", "kafka")).options(**options).mode("append").save()


def serve(messages: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], results: str | dict[str, str], errors: str | dict[str, str], checkpoint: str, **trigger):
    """Routes messages, checks packets, classifies them and writes results and errors (dead letters) as JSON or to a broker (see ``send``).

    ``handlers`` has a function for "imu" and "mfcc" (rows with packet) and for
    "clip" (rows with data, the bytes of a file); each maps rows (device, topic, ...) to
    (device, kind, label, confidence, source_topic). A message whose handler is
    missing is an error, as is one that no route or rule takes. Chunks are left to
    ``chunk_messages``. ``trigger`` is that of the stream, such as
    processingTime="1 second" or availableNow=True; by default batches follow each other.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = typed_messages(batch).filter("route <> 'chunk'").persist()
        typed = packets.validate_packets(rows.filter("packet is not null"), "packet")
        encoded = F.coalesce(*[F.get_json_object("payload", f"$.{p}{k}") for p in ("", "data.") for k in ("audio_base64", "base64", "audio")])
        files = rows.filter(F.col("route").isin("base64_file", "raw_bytes"))
        files = files.withColumn("data", F.when(F.col("route") == "base64_file", F.try_to_binary(encoded, F.lit("base64"))).otherwise(F.col("value")))
        taken = {"imu": typed.filter("reason is null and route like 'imu%'"), "mfcc": typed.filter("reason is null and route like 'mfcc%'"), "clip": files.filter("data is not null")}
        bad = typed.filter("reason is not null").select("topic", "payload", "reason")
        bad = bad.unionByName(rows.filter("route = 'error'").select("topic", "payload", F.lit("route").alias("reason")))
        bad = bad.unionByName(files.filter("data is null").select("topic", "payload", F.lit("base64").alias("reason")))
        done = None
        for name, part in taken.items():
            if name in handlers:
                out = packets.result_packets(handlers[name](part))
                done = out if done is None else done.unionByName(out)
            else:
                bad = bad.unionByName(part.select("topic", "payload", F.lit("unhandled").alias("reason")))
        if done is not None:
            send(done, results, number)
        send(bad if isinstance(errors, str) else packets.error_packets(bad), errors, number)
        rows.unpersist()

    w = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
