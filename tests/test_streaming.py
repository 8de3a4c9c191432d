"""Streaming operators give the rows of their batch forms."""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import functions as F

from wavefold import plans
from wavefold.operators import motion, packets
from wavefold.plans import streams
from wavefold.sources.ingest import message_stream
from wavefold.streaming import jobs


def stream(spark, *parts, folder):
    """A stream that reads one of the parts a batch."""
    df = parts[0]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(sdf, name, tmp_path):
    with jobs.map_store(sdf.sparkSession):
        q = started(sdf, name, tmp_path)
    assert q.awaitTermination(120)
    return sdf.sparkSession.table(name)


def started(sdf, name, tmp_path):
    return sdf.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / ("c" + name))).trigger(availableNow=True).start()


def test_reassembly(spark, tmp_path):
    rows = [("a", 1, 2, b"B", 1), ("a", 0, 2, b"A", 2), ("b", 0, 3, b"x", 1), ("b", 2, 3, b"z", 2), ("c", 0, 1, b"q", 3)]
    d = spark.createDataFrame(rows, "id string, index int, total int, data binary, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    got = run(jobs.reassemble_stream(stream(spark, d, folder=str(tmp_path / "in"))), "chunks", tmp_path)
    key = lambda df: {(r["id"], r["total"], bytes(r["data"])) for r in df.select("id", "total", "data").collect()}
    assert key(got) == key(packets.reassemble(d)) == {("a", 2, b"AB"), ("c", 1, b"q")}


def test_chunks_over_many_batches(spark, tmp_path):
    """Repeated, changed, late and missing chunks of messages that come apart: what the batch form says, and each chunk in a row of its own."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        total = 1 + i % 7
        for index in rng.permutation(np.r_[np.arange(total), rng.integers(0, total, 3)]).tolist():
            rows.append((f"m{i}", index, total if rng.random() < 0.9 else total + 1, f"{i}:{index}".encode(), len(rows) / 20))
        if i % 3 == 0:
            rows = [r for r in rows if r[0] != f"m{i}" or r[1]]  # the first chunk is lost
    d = spark.createDataFrame(rows, "id string, index int, total int, data binary, s double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
    third = len(rows) / 60
    parts = [d.filter(F.col("s").between(k * third, (k + 1) * third - 1e-9)).drop("s") for k in range(3)] + [d.filter(F.col("s") >= 3 * third).drop("s")]
    got = run(jobs.reassemble_stream(stream(spark, *parts, folder=str(tmp_path / "in"))), "many", tmp_path)
    key = lambda df: sorted((r["id"], r["total"], bytes(r["data"])) for r in df.select("id", "total", "data").collect())
    want = key(packets.reassemble(d.drop("s")))
    assert set(want) <= set(key(got)) and {r[0] for r in key(got)} == {r[0] for r in want}


def test_latest_rows_are_kept_in_few_folders(spark, tmp_path):
    path, last = str(tmp_path / "out"), {}
    write = jobs.latest_sink(path, "k", "at", every=3)
    for n in range(11):
        rows = [(k, 100 - n if k == 0 else n, f"{k}:{n}") for k in range(5) if (k + n) % 2 or k == 0]
        for k, at, v in rows:
            if k not in last or at >= last[k][0]:
                last[k] = (at, v)
        d = spark.createDataFrame(rows, "k int, at int, v string")
        write(d, n)
        if n % 4 == 0:
            write(d, n)  # a batch that is done again
        got = {r["k"]: (r["at"], r["v"]) for r in jobs.read_latest(spark, path, "k", "at").collect()}
        assert got == last
        assert len(jobs._folders(spark, path)) <= 2 + 2 * 3


def plain_segments(x, cfg):
    """Segments of one device, sample by sample from the rules."""
    ema, found, energy, opened, run_up, run_down = x[0, 3:], [], [], None, 0, 0
    for row in x:
        ema = 0.95 * ema + 0.05 * row[3:] if energy else row[3:]
        energy.append(np.linalg.norm(row[:3]) + cfg.beta * np.linalg.norm(row[3:] - ema))
    calm = np.array(energy[: cfg.calibration])
    if len(calm) < cfg.calibration:
        return []
    high, low = (calm.mean() + z * (calm.std() + 1e-6) for z in (cfg.start_z, cfg.end_z))
    for n in range(cfg.calibration, len(x)):
        if opened is None:
            run_up = run_up + 1 if energy[n] > high else 0
            if run_up == cfg.start_count:
                opened, run_up, run_down = n - min(n + 1, cfg.pre_roll) + 1, 0, 0
            continue
        run_down = run_down + 1 if energy[n] < low else 0
        length = n - opened + 1
        if length >= cfg.most or run_down == cfg.end_count:
            if length >= min(cfg.most, cfg.least):
                found.append((opened, length))
            opened = None
    return found


def test_motion_segments(spark, tmp_path):
    rng = np.random.default_rng(0)
    cfg, rows, want = motion.MotionConfig(), [], set()
    for dev in "mnopq":
        x = rng.normal(0, 0.1, (700, 6)) + np.array([0, 0, 0, 0, 0, 9.8])
        if dev in "mn":
            x[120:170, 0] += 100
            x[220:260, 0] += 100
        elif dev == "o":  # never rests: cut again and again, with gaps in which nothing opens
            x[60:, 0] += np.where(rng.random(640) < 0.9, 50, 0)
        elif dev == "p":
            x[60:, 0] += np.repeat(np.where(rng.random(64) < 0.5, 50, 0), 10)
        else:
            x = x[:30]
        rows += [(dev, i, *map(float, v)) for i, v in enumerate(x)]
        want |= {(dev, *s) for s in plain_segments(x, cfg)}
    d = spark.createDataFrame(rows, "device string, seq long, gx double, gy double, gz double, ax double, ay double, az double")
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") / 50))
    batch = {tuple(r) for r in motion.segment_motion(d).collect()}
    assert batch == want and len([s for s in want if s[0] == "o"]) > 4
    for block in (5, 64):  # blocks that end inside of runs, segments and calm stretches
        assert {tuple(r) for r in motion.segment_motion(d.repartition(3), motion.MotionConfig(block=block)).collect()} == want
    parts = [d.filter(F.col("seq").between(a, b)) for a, b in ((0, 29), (30, 126), (127, 500), (501, 700))]
    got = {tuple(r) for r in run(jobs.segment_motion_stream(stream(spark, *parts, folder=str(tmp_path / "in"))), "motion", tmp_path).collect()}
    assert got == batch


def test_arbitration(spark, tmp_path):
    d = spark.range(60).select((F.col("id") % 3).cast("string").alias("device"), (F.col("id") * 20.0).alias("ts_ms"), (F.col("id") % 5).cast("double").alias("motion"), ((F.col("id") % 4) / 50).alias("voice"))
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ts_ms") / 1000)).coalesce(1)
    got = run(jobs.arbitrate_stream(stream(spark, d, folder=str(tmp_path / "in"))), "arb", tmp_path)
    key = lambda df: {(r["device"], r["ts_ms"], r["route"]) for r in df.collect()}
    assert key(got) == key(packets.arbitrate(d))


def test_serve_routes_results_and_errors(spark, tmp_path):
    """60 samples in, one reply out; what cannot be read is a dead letter with its reason."""
    sample = dict.fromkeys(("gx", "gy", "gz", "ax", "ay", "az"), 1.0)
    window = json.dumps({"type": "imu", "data": {"samples": [sample] * 60, "count": 60}})
    (tmp_path / "in").mkdir()
    sent = [("esp32/d1/sensor/imu", window), ("esp32/d1/sensor/imu", "{}"), ("esp32/d2/sensor/imu", json.dumps([sample])), ("phone/p/viz/mic", json.dumps({"base64": "!!"})), ("phone/p/viz/mic", "RIFFx"), ("esp32/d1/other", "x")]
    lines = [{"topic": t, "value": base64.b64encode(v.encode()).decode(), "ts": "2024-01-01T00:00:00"} for t, v in sent]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    m = message_stream(spark, "json", str(tmp_path / "in"), "^(esp32/[^/]+/sensor/imu|phone/[^/]+/viz/mic)$")
    n = F.size(F.from_json(F.get_json_object("packet", "$.data.samples"), "array<string>")).cast("string")
    handle = lambda d: d.select("device", F.lit("action").alias("kind"), n.alias("label"), F.lit(1.0).alias("confidence"), F.col("topic").alias("source_topic"))
    q = jobs.serve(m, {"imu": handle}, str(tmp_path / "r"), str(tmp_path / "e"), str(tmp_path / "c"), availableNow=True)
    assert q.awaitTermination(120)
    got = [json.loads(r["value"])["data"] for r in spark.read.json(str(tmp_path / "r")).collect()]
    assert sorted((g["device_id"], g["label"]) for g in got) == [("d1", "60"), ("d2", "1")]
    assert sorted(r["reason"] for r in spark.read.json(str(tmp_path / "e")).collect()) == ["base64", "route", "unhandled"]
    # The same as messages to a sink with options, as to a broker.
    sink = lambda name: {"format": "json", "path": str(tmp_path / name)}
    m = message_stream(spark, "json", str(tmp_path / "in"), "^(esp32/[^/]+/sensor/imu|phone/[^/]+/viz/mic)$")
    assert jobs.serve(m, {"imu": handle}, sink("r2"), sink("e2"), str(tmp_path / "c2"), availableNow=True).awaitTermination(120)
    assert {r["topic"] for r in spark.read.json(str(tmp_path / "r2")).collect()} == {"results/d1/action", "results/d2/action"}
    errors = [(r["topic"], json.loads(r["value"])) for r in spark.read.json(str(tmp_path / "e2")).collect()]
    assert sorted((t, e["type"], e["data"]["reason"]) for t, e in errors) == [("errors/esp32/d1/sensor/imu", "error", "route"), ("errors/phone/p/viz/mic", "error", "base64"), ("errors/phone/p/viz/mic", "error", "unhandled")]


def test_capture_writes_by_session_kind_and_device(spark, tmp_path):
    d = spark.createDataFrame([("esp32/d1/sensor/imu", b"x", 0), ("a/b", b"y", 0)], "topic string, value binary, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    sink = jobs.capture_sink(str(tmp_path / "cap"), "s7", lambda rows: rows.select("stem", F.length("value").alias("n")))
    sink(d, 0)
    sink(d, 0)  # a repeated batch replaces itself
    raw = spark.read.parquet(str(tmp_path / "cap/raw/session=s7/batch=0")).collect()
    assert sorted((r["kind"], r["device"], r["stem"]) for r in raw) == [("b", "unknown", "000000000-unknown-a_b"), ("imu", "d1", "000000000-d1-esp32_d1_sensor_imu")]
    assert {r["n"] for r in spark.read.parquet(str(tmp_path / "cap/processed/session=s7/batch=0")).collect()} == {1}


def test_arbitration_of_long_chains(spark):
    rng = np.random.default_rng(1)
    rows = [(dev, float(t), float(m), float(v)) for dev in "ab" for t, m, v in zip(np.cumsum(rng.integers(0, 90, 400)), rng.random(400) * 2, rng.random(400) / 30, strict=True)]
    d = spark.createDataFrame(rows, "device string, ts_ms double, motion double, voice double")
    want, last = [], {}
    for dev, t, m, v in sorted(rows, key=lambda r: (r[0], r[1], "gesture" if r[2] > 1.2 else "voice")):
        route = "gesture" if m > 1.2 else "voice" if v > 0.015 else "none"
        if route != "none" and t - last.get(dev, -1e9) < 150:
            route = "none"
        last[dev] = t if route != "none" else last.get(dev, -1e9)
        want.append((dev, t, route))
    assert sorted(map(tuple, packets.arbitrate(d).collect())) == sorted(want)


def test_arbitration_by_buckets(spark, tmp_path):
    """Many devices (one without a name) over several batches: what a plain loop gives, from a row of state a bucket."""
    rng = np.random.default_rng(3)
    rows = [(f"d{dev}" if dev else None, float(t), float(m), float(v)) for dev in range(90) for t, m, v in zip(np.cumsum(rng.integers(0, 400, 12)), rng.random(12) * 2, rng.random(12) / 30, strict=True)]
    d = spark.createDataFrame(rows, "device string, ts_ms double, motion double, voice double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ts_ms") / 1000))
    parts = [d.filter(F.col("ts_ms").between(a, b)) for a, b in ((0, 599), (600, 1499), (1500, 9999))]
    found = jobs.arbitrate_stream(stream(spark, *parts, folder=str(tmp_path / "in")), buckets=4)
    q = started(found, "arb_buckets", tmp_path)
    assert q.awaitTermination(120)
    want, last = [], {}
    for dev, at, m, v in sorted(rows, key=lambda r: (r[0] or "", r[1], "gesture" if r[2] > 1.2 else "voice" if r[3] > 0.015 else "none")):
        route = "gesture" if m > 1.2 else "voice" if v > 0.015 else "none"
        if route != "none" and at - last.get(dev, -1e9) < 150:
            route = "none"
        last[dev] = at if route != "none" else last.get(dev, -1e9)
        want.append((dev or "", at, route))
    assert sorted((r["device"] or "", r["ts_ms"], r["route"]) for r in spark.table("arb_buckets").collect()) == sorted(want)
    named = d.filter("device is not null")
    assert {tuple(r) for r in spark.table("arb_buckets").filter("device is not null").collect()} == {tuple(r) for r in packets.arbitrate(named).collect()}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4


def test_arbitration_in_another_time_zone(spark, tmp_path):
    """A device that a batch passes over is still in its cooldown, wherever the session is."""
    d = spark.createDataFrame([("a", 0.0), ("b", 50.0), ("a", 100.0), ("a", 200.0)], "device string, ts_ms double").withColumn("motion", F.lit(2.0)).withColumn("voice", F.lit(0.0))
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ts_ms") / 1000))
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = run(jobs.arbitrate_stream(stream(spark, *[d.filter(F.col("ts_ms") == t) for t in (0, 50, 100, 200)], folder=str(tmp_path / "in"))), "arb_zone", tmp_path).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {(r["device"], r["ts_ms"]): r["route"] for r in got} == {("a", 0.0): "gesture", ("b", 50.0): "gesture", ("a", 100.0): "none", ("a", 200.0): "gesture"}


def test_arbitration_query_in_pieces(spark, sf, duck, same, tmp_path, monkeypatch):
    """Neither all times nor a whole part of the stream go through one task."""
    monkeypatch.setattr(streams.F, "percentile", None)  # it holds all different values
    monkeypatch.setattr(streams, "shared_folder", lambda spark: str(tmp_path / "shared"))
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    files = {p.name for p in (tmp_path / "events.parquet").glob("*.parquet")}
    assert len(files) == 4
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task a file
    try:
        same(plans.QUERIES["t04_arbitrate_stream"](spark, str(tmp_path)), duck.sql(plans.ORACLES["t04_arbitrate_stream"]))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "shared").glob("stream-*/in/*.parquet"))) == 12  # three parts
