"""Sources and sinks: log text formats, manifests, folders, actions, streams, files.

Text parsers take rows (file, text) and give long rows (file, block, seq, six values);
one pass of native expressions, no Python a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefold.schemas import AXES, SAMPLE_COLUMNS, SAMPLE_SCHEMA, require_columns

#: Fixed texts of the formats.
PACKET_MARK = "==== Gesture Packet ===="
PACKET_END = "========================"
SERIES_MARK = "YPR(deg)-X"
AUDIO_SUFFIXES = ("wav", "m4a", "mp3")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A sample table from CSV: required columns checked, fixed order and types."""
    raw = require_columns(spark.read.option("header", True).csv(path), SAMPLE_COLUMNS)
    kinds = dict(x.split() for x in SAMPLE_SCHEMA.split(", "))
    return raw.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in SAMPLE_COLUMNS])


def write_samples(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    w.option("header", True).format(fmt).save(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\\x00|^\ufeff", ""), "\r\n?", "\n")


def _six(parts: Column) -> list[Column]:
    return [F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(a) for i, a in enumerate(AXES)]


def _numbered(rows: DataFrame, on_bad: str = "skip") -> DataFrame:
    """Rows (file, block, line, parts) as samples with seq from 0; rows of bad numbers are skipped, fail, or drop their file."""
    d = rows.select("file", "block", "line", *_six(F.col("parts")))
    bad = sum(F.col(a).isNull().cast("int") for a in AXES) > 0
    if on_bad == "fail":
        d = d.withColumn(AXES[0], F.when(bad, F.raise_error(F.concat(F.lit("not a number in "), "file")).cast("double")).otherwise(F.col(AXES[0])))
    elif on_bad == "drop_file":
        d = d.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy("file"))).filter("_bad = 0").drop("_bad")
    else:
        d = d.filter(~bad)
    # Blocks are numbered over those that have samples, samples inside their block.
    w = Window.partitionBy("file").orderBy("block")
    d = d.withColumn("_b", F.dense_rank().over(w) - 1)
    return d.select("file", F.col("_b").alias("block"), (F.row_number().over(Window.partitionBy("file", "_b").orderBy("line")) - 1).alias("seq"), *AXES)


def parse_packets(texts: DataFrame, on_bad: str = "skip") -> DataFrame:
    """Packet logs: blocks at the packet mark, lines ``index | six values``."""
    b = texts.select("file", F.posexplode(F.split(_clean(F.col("text")), "\\Q" + PACKET_MARK + "\\E")).alias("block", "body"))
    # All lines of a block at once, already in order; those of other shapes are not there.
    lines = F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]*\d+[ \t]*\|([^|\n]*(?:\|[^|\n]*){5})$"), 1)
    line = b.select("file", "block", F.posexplode(lines).alias("line", "raw"))
    return _numbered(line.select("file", "block", "line", F.split("raw", r"\|").alias("parts")), on_bad)


def parse_marked(texts: DataFrame, marker: str = SERIES_MARK) -> DataFrame:
    """Logs whose blocks follow lines that hold the marker; lines of six values between commas."""
    b = texts.select("file", F.posexplode(F.split(_clean(F.col("text")), "\\n?[^\\n]*\\Q" + marker + "\\E[^\\n]*")).alias("block", "body")).filter("block > 0")
    line = b.select("file", "block", F.posexplode(F.split("body", "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    line = line.filter((F.col("raw") != "") & ~F.col("raw").startswith("---"))
    return _numbered(line.withColumn("parts", F.split("raw", ",")).filter(F.size("parts") == 6))


def parse_plain(texts: DataFrame, width: int = 6) -> DataFrame:
    """One window a file: rows of ``width`` values, or one row of a multiple of them; commas or spaces.

    A file with a cell that is no number, a NaN, or rows of another width gives nothing.
    """
    t = texts.select("file", F.filter(F.transform(F.split(_clean(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")).alias("lines"))
    cells = F.transform("lines", lambda x: F.split(F.regexp_replace(x, r"\s*,\s*", ","), F.when(F.contains(x, F.lit(",")), ",").otherwise(r"\s+")))
    t = t.withColumn("cells", cells)
    single = (F.size("cells") == 1) & (F.size(F.get("cells", F.lit(0))) % width == 0)
    regular = F.forall("cells", lambda r: F.size(r) == width)
    flat = F.transform(F.flatten("cells"), lambda x: x.try_cast("double"))
    t = t.filter((F.size("cells") > 0) & (single | regular)).withColumn("flat", flat).filter(F.forall("flat", lambda v: v.isNotNull() & ~F.isnan(v)))
    c = t.select("file", F.posexplode("flat").alias("p", "v")).withColumn("seq", F.floor(F.col("p") / width).cast("int"))
    row = c.groupBy("file", "seq").agg(*[F.max(F.when(F.col("p") % width == i, F.col("v"))).alias(a) for i, a in enumerate(AXES[:width])])
    return row.select("file", F.lit(0).alias("block"), "seq", *AXES[:width])


def parse_auto(texts: DataFrame, order: tuple[str, ...] = ("packet", "marked", "plain")) -> DataFrame:
    """For each file the first parser of ``order`` that finds a block."""
    parsers = {"packet": parse_packets, "marked": parse_marked, "plain": parse_plain}
    out = None
    for n, name in enumerate(order):
        part = parsers[name](texts).withColumn("parser", F.lit(name)).withColumn("_prio", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("_best", F.min("_prio").over(Window.partitionBy("file"))).filter("_prio = _best").drop("_prio", "_best")


def render_packets(df: DataFrame, key: str = "measurement_id", seq: str = "sequence_id") -> DataFrame:
    """(key, text): one packet each, values with six decimals; parse_packets reads it back."""
    line = F.format_string("%d | " + " | ".join(["%.6f"] * 6), F.col(seq), *[F.col(a) for a in AXES])
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), line.alias("l")))).alias("x"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit(PACKET_MARK + "\nSample count: "), F.col("n").cast("string"), F.lit("\nIdx | gx | gy | gz | ax | ay | az\n"))
    return g.select(key, F.concat(head, F.array_join("x.l", "\n"), F.lit("\n" + PACKET_END + "\n")).alias("text"))


def label_from_folder(files: DataFrame, aliases: dict[str, int], known: dict[str, int] | None = None) -> DataFrame:
    """(path, label, label_id) with the parent folder as label.

    Ids come from ``known`` if all folders are in it, else from ``aliases`` if all
    are in that, else from the sorted distinct names.
    """
    d = files.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).filter("label <> ''")
    names = d.select("label").distinct().withColumn("sorted", F.dense_rank().over(Window.orderBy("label")) - 1)  # one row a folder
    out = F.col("sorted")
    for ids in (aliases, known or {}):
        if ids:
            mapped = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
            every = F.min(F.lower("label").isin(*ids)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            out = F.when(every, F.element_at(mapped, F.lower("label"))).otherwise(out)
    return d.join(names.select("label", out.cast("int").alias("label_id")), "label").select("path", "label", "label_id")


def zip_wide(axes: list[DataFrame], labels: DataFrame) -> DataFrame:
    """(measurement_id, sequence_id, label_id, axes) from one table an axis (line, values) and labels (line, label 1..n), joined by line."""
    d = labels.select("line", (F.col("label") - 1).alias("label_id"))
    for a, t in zip(AXES, axes, strict=False):
        d = d.join(t.select("line", F.col("values").alias(a)), "line")
    names = AXES[: len(axes)]
    return d.select(F.col("line").alias("measurement_id"), "label_id", F.posexplode(F.arrays_zip(*names)).alias("sequence_id", "x")).select("measurement_id", "sequence_id", "label_id", *[F.col(f"x.{a}") for a in names])


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modified, size) of all files below ``root``, contents unread."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return d.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def below(path: str | Column, root: str) -> Column:
    """The parts of a path below ``root``, whatever scheme (``file:/``, ``hdfs://host/``) either has; null for other paths."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "^/+|/+$", "")
    p, r = plain(F.col(path) if isinstance(path, str) else path), plain(F.lit(root))
    inside = (r == "") | p.startswith(F.concat(r, F.lit("/")))
    return F.when(inside, F.split(F.when(r == "", p).otherwise(F.substr(p, F.length(r) + 2)), "/"))


def build_manifest(files: DataFrame, root: str, clips_per_speaker: int = 5) -> DataFrame:
    """Clip manifest from paths ``root/source/label/[folder/]name`` as ``list_files`` gives them; ordinals in natural order inside a folder."""
    from wavefold.operators.clean import speaker_ids

    d = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*AUDIO_SUFFIXES)).withColumn("_parts", below("path", root))
    parts = F.col("_parts")
    d = d.filter(F.size(parts) >= 3).select("path", F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("label"), F.when(F.size(parts) > 3, F.get(parts, F.lit(2))).alias("folder"))
    ids = d.select("label").distinct().withColumn("label_id", F.dense_rank().over(Window.orderBy("label")) - 1)  # one row a class
    out = speaker_ids(d.join(ids, "label"), clips_per_speaker)
    return out.select("path", "label", "label_id", "source", "speaker_local_id", "speaker_id", "utterance_id")


def reviewed_roots(files: DataFrame, root: str, kind: str, required: tuple[str, ...]) -> DataFrame:
    """Sessions of paths ``root/session/kind/label/name`` with a sample of one of the required labels."""
    parts = F.col("_parts")
    d = files.withColumn("_parts", below("path", root)).select(F.get(parts, F.lit(0)).alias("session"), F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).alias("label"), F.size(parts).alias("depth")).filter((F.col("kind") == kind) & (F.col("depth") >= 4))
    g = d.groupBy("session").agg(F.collect_set(F.lower("label")).alias("labels"), F.count(F.lit(1)).alias("samples"))
    return g.filter(F.arrays_overlap("labels", F.array(*[F.lit(r.lower()) for r in required]))).select("session", "samples")


def latest_dated(files: DataFrame, name: str = "name") -> DataFrame:
    """Newest name of eight digits that is a date."""
    d = files.filter(F.col(name).rlike(r"^\d{8}$")).withColumn("_d", F.try_to_timestamp(F.col(name), F.lit("yyyyMMdd")).cast("date")).filter("_d is not null")
    return d.agg(F.max_by(name, "_d").alias("latest"))


def class_from_name(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Rows with cls: the ``pronunciation_en_`` class of a file name, else the alias of best priority inside its letters and digits."""
    exact = F.nullif(F.regexp_extract(F.lower(name), r"^pronunciation_en_([a-z]+)", 1), F.lit(""))
    token = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    table = aliases.agg(F.sort_array(F.collect_list(F.struct("priority", "alias", "canonical"))).alias("_aliases"))  # one row
    d = df.crossJoin(F.broadcast(table)).withColumn("_hit", F.get(F.filter("_aliases", lambda a: F.contains(token, a["alias"])), F.lit(0)))
    return d.withColumn("cls", F.coalesce(exact, F.col("_hit.canonical"))).drop("_aliases", "_hit")


REVIEW_SCHEMA = (
    "sample_id string, kind string, created_at double, source string, filename string, content_type string, "
    "prediction struct<label: string, confidence: double, probabilities: array<struct<label: string, index: int, probability: double>>>, sample_rate int, "
    "review struct<status: string, is_correct: boolean, predicted_label: string, correct_label: string, reviewed_at: double>"
)


def read_review_metadata(records: DataFrame, column: str = "json") -> DataFrame:
    """One row a class probability of each review record (JSON text)."""
    r = records.select(F.from_json(column, REVIEW_SCHEMA).alias("r")).select("r.*").withColumn("created_at", F.timestamp_millis((F.col("created_at") * 1000).cast("long")))
    keep = r.select("sample_id", "kind", "created_at", F.col("prediction.label").alias("predicted"), "review.status", "review.is_correct", "review.correct_label", F.col("prediction.probabilities").alias("p"))
    return keep.select(*[c for c in keep.columns if c != "p"], F.inline_outer("p"))


def read_runs(spark: SparkSession, root: str, name: str = "summary.json") -> DataFrame:
    """Rows (tag, modified, json) of the run files below ``root``: the folder that each lies in, its file time and its text."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    return d.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("tag"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("json"))


def run_summaries(runs: DataFrame, after: Column | None = None) -> DataFrame:
    """Newest run of each tag: rows (tag, modified, json) with accuracy and mean latency of both kinds."""
    d = runs if after is None else runs.filter(F.col("modified") > after)
    d = d.groupBy("tag").agg(F.max_by("json", "modified").alias("json"))
    j = lambda p: F.get_json_object("json", p).cast("double")
    return d.select("tag", *[j(f"$.{k}.summary.{m}").alias(f"{k}_{m}") for k in ("gesture", "voice") for m in ("accuracy", "total_mean_ms")])


#: Message times in JSON: written by default, Spark cuts them to milliseconds.
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_messages(df: DataFrame, path: str) -> None:
    """Appends (topic, value binary, ts) as JSON that ``message_stream`` reads back with all of its digits."""
    df.select("topic", F.base64("value").alias("value"), "ts").write.mode("append").option("timestampFormat", MICROSECONDS).json(path)


def message_stream(spark: SparkSession, fmt: str, path: str | None = None, topics: str | None = None, **options: str) -> DataFrame:
    """Streaming rows (topic, value binary, ts) from Kafka or from JSON files of (topic, value base64, ts)."""
    if fmt == "kafka":
        return spark.readStream.format("kafka").options(subscribePattern=topics, **options).load().select("topic", "value", F.col("timestamp").alias("ts"))
    raw = spark.readStream.schema("topic string, value string, ts timestamp").options(**options).json(path)
    d = raw.select("topic", F.unbase64("value").alias("value"), "ts")
    return d.filter(F.col("topic").rlike(topics)) if topics else d

