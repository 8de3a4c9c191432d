from __future__ import annotations

from pyspark.sql import functions as F

from wavefold.functions import scalar
from wavefold.operators import clean, packets
from wavefold.schemas import SAMPLE_SCHEMA
from wavefold.sources import ingest


def texts(spark, *items):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(items)], "file string, text string")


GOOD = "==== Gesture Packet ====\r\nSample count: 2\r\nIdx | gx | gy | gz | ax | ay | az\r\n0 | 1 | 2 | 3 | .1 | .2 | 9.8\r\n1 | 1.5 | 2 | 3 | .1 | .2 | 9.8\r\n"


def test_packets_skip_and_drop(spark):
    t = texts(spark, "﻿" + GOOD + GOOD, GOOD + "2 | x | 2 | 3 | 4 | 5 | 6\n3 | 1 | 2 | 3 | 4\n", "==== Gesture Packet ====\n\n")
    got = ingest.parse_packets(t).groupBy("file", "block").count().collect()
    assert {tuple(r) for r in got} == {("f0", 0, 2), ("f0", 1, 2), ("f1", 0, 2)}
    assert {r["file"] for r in ingest.parse_packets(t, "drop_file").collect()} == {"f0"}


def test_marked_ignores_rows_before_header(spark):
    t = texts(spark, "1,2,3,4,5,6\nx YPR(deg)-X y\n---\n1,2,3,4,5,6\n\n2,2,3,4,5,6\nYPR(deg)-X\n3,2,3,4,5,6\n")
    got = ingest.parse_marked(t).orderBy("block", "seq").collect()
    assert [(r["block"], r["seq"], r["gyro_x"]) for r in got] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]


def test_plain_reshape_and_nan(spark):
    t = texts(spark, " ".join(str(i) for i in range(12)), "1,2,3,4,5,6\n7, 8,9,10,11,12", "1,2,3,4,5,nan", "1 2 3", "")
    got = ingest.parse_plain(t).groupBy("file").count().collect()
    assert {tuple(r) for r in got} == {("f0", 2), ("f1", 2)}


def test_auto_takes_first_parser(spark):
    t = texts(spark, GOOD, "YPR(deg)-X\n1,2,3,4,5,6", "1 2 3 4 5 6", "nothing")
    got = ingest.parse_auto(t).select("file", "parser").distinct().collect()
    assert {tuple(r) for r in got} == {("f0", "packet"), ("f1", "marked"), ("f2", "plain")}


def test_render_parse_is_identity(spark):
    rows = [(m, s, 0, "Raise", float(s), -1.25, 0.5, 2.0, 3.0, 9.8) for m in range(3) for s in range(12)]
    d = spark.createDataFrame(rows, SAMPLE_SCHEMA)
    back = ingest.parse_packets(ingest.render_packets(d).select(F.col("measurement_id").cast("string").alias("file"), "text"))
    assert {(int(r["file"]), r["seq"], r["gyro_x"], r["acc_z"]) for r in back.collect()} == {(r[0], r[1], r[4], r[9]) for r in rows}


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 2, "Chop", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], SAMPLE_SCHEMA)
    ingest.write_samples(d, str(tmp_path / "x"), "csv")
    assert ingest.read_samples(spark, str(tmp_path / "x")).collect() == d.collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text(GOOD)
    assert ingest.parse_packets(ingest.read_text(spark, str(tmp_path / "t"))).count() == 2
    assert ingest.list_files(spark, str(tmp_path / "t"), "*.txt").count() == 1


def test_folder_labels_prefer_known_sets(spark):
    f = spark.createDataFrame([("r/walk/1.txt",), ("r/sit/2.txt",)], "path string")
    ids = lambda d: {r["label"]: r["label_id"] for r in d.collect()}
    assert ids(ingest.label_from_folder(f, {})) == {"sit": 0, "walk": 1}
    assert ids(ingest.label_from_folder(f, {"walk": 7, "sit": 3})) == {"sit": 3, "walk": 7}
    assert ids(ingest.label_from_folder(f, {"walk": 7, "sit": 3}, {"walk": 1, "sit": 4})) == {"sit": 4, "walk": 1}
    assert ids(ingest.label_from_folder(f, {"walk": 7})) == {"sit": 0, "walk": 1}


def test_topics_and_payloads(spark):
    d = spark.createDataFrame([("esp32/d1/sensor/imu",), ("phone/p/viz/mic",), ("a/b/c/d",), ("a/b",), (None,)], "t string")
    assert [r[0] for r in d.select(scalar.device_of_topic(F.col("t"))).collect()] == ["d1", "p", None, None, None]
    assert [r[0] for r in d.select(scalar.topic_matches(F.col("t"), "esp32/+/sensor/imu")).collect()] == [True, False, False, False, None]
    h = spark.createDataFrame([("0aFF", "hex"), ("0a1", "hex"), ("zz", "hex"), ("AAE=", "base64"), ("***", "base64")], "d string, k string")
    assert [None if r[0] is None else bytes(r[0]) for r in h.select(scalar.decode_payload(F.col("d"), F.col("k"))).collect()] == [b"\x0a\xff", None, None, b"\x00\x01", None]


def test_reassembly_cases(spark):
    rows = [("a", 1, 2, b"B", 1), ("a", 0, 2, b"A", 2), ("b", 0, 2, b"x", 1), ("b", 0, 2, b"y", 2), ("b", 1, 2, b"z", 3), ("c", 0, 2, b"1", 1), ("c", 1, 3, b"2", 2), ("d", 0, 2, b"1", 1), ("d", 1, 2, b"2", 60), ("e", 5, 2, b"", 1)]
    d = spark.createDataFrame(rows, "id string, index int, total int, data binary, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r["id"]: bytes(r["data"]) for r in packets.reassemble(d).collect()}
    assert got == {"a": b"AB", "b": b"yz"}


def test_arbitration_cooldown(spark):
    d = spark.createDataFrame([("x", 0.0, 2.0, 0.0), ("x", 100.0, 2.0, 0.0), ("x", 150.0, 0.0, 1.0), ("x", 200.0, 0.0, 0.0), ("x", 301.0, 2.0, 1.0)], "device string, ts_ms double, motion double, voice double")
    assert [r["route"] for r in packets.arbitrate(d).orderBy("ts_ms").collect()] == ["gesture", "none", "voice", "none", "gesture"]


def test_appended_measurements_are_written_behind(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(5, 0), (5, 1), (9, 0)], "measurement_id long, sequence_id int")
    for _ in range(3):
        clean.write_appended(rows, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(5, 0), (5, 1), (9, 0), (10, 0), (10, 1), (11, 0), (12, 0), (12, 1), (13, 0)]


def test_runs_are_read_from_folders(spark, tmp_path):
    import json
    import os

    for day, tag, accuracy, at in (("d1", "base", 0.5, 1_700_000_000), ("d2", "base", 0.75, 1_700_000_500), ("d1", "wide", 0.9, 1_700_000_100)):
        folder = tmp_path / day / tag
        folder.mkdir(parents=True)
        (folder / "summary.json").write_text(json.dumps({"gesture": {"summary": {"accuracy": accuracy}}}, indent=1))
        (folder / "notes.txt").write_text("x")
        os.utime(folder / "summary.json", (at, at))
    got = {r["tag"]: r["gesture_accuracy"] for r in ingest.run_summaries(ingest.read_runs(spark, str(tmp_path))).collect()}
    assert got == {"base": 0.75, "wide": 0.9}
    late = ingest.run_summaries(ingest.read_runs(spark, str(tmp_path)), F.timestamp_seconds(F.lit(1_700_000_200))).collect()
    assert [r["tag"] for r in late] == ["base"]
