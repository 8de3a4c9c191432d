"""Chat formatting with a grammar round trip (operator 10, native expressions only).

Grammar of a formatted conversation::

    conversation := "#format " level "\n" turn*
    turn         := "### " role ": " body "</turn>\n"

Level 0 holds texts as they are. The deterministic parser reads every rendered
turn back; if one of a conversation does not give its source again (a text holds
``</turn>`` or ``### ``, a role holds ``:``), the whole conversation is escaped
(level 1): a backslash is doubled and one is put inside each control string, so
that none can appear and ``\\(.)`` -> ``\1`` restores the text. Level 1 always
round-trips; ``round_trip`` reports the comparison made on the final output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK, END = "### ", "</turn>"
_HEAD_RAW = r"(?s)^### ([^:]*): (.*)$"
_HEAD_ESCAPED = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"


def _replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape_text(col: Column) -> Column:
    return _replace(_replace(_replace(col, "\\", "\\\\"), END, "<\\/turn>"), MARK, "#\\## ")


def escape_role(col: Column) -> Column:
    return _replace(escape_text(col), ":", "\\:")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(MARK), role, F.lit(": "), body, F.lit(END + "\n"))


def _turn_of(piece: Column, level: Column) -> Column:
    """role and text of one turn without its end, null where the grammar does not fit."""
    fits = piece.startswith(MARK) & ~F.contains(F.substr(piece, F.lit(2)), F.lit(MARK)) & ~F.contains(piece, F.lit(END))
    raw = F.struct(F.regexp_extract(piece, _HEAD_RAW, 1).alias("role"), F.regexp_extract(piece, _HEAD_RAW, 2).alias("text"))
    escaped = F.struct(
        unescape(F.regexp_extract(piece, _HEAD_ESCAPED, 1)).alias("role"),
        unescape(F.regexp_extract(piece, _HEAD_ESCAPED, 2)).alias("text"),
    )
    return F.when(fits & (level == 0) & piece.rlike(_HEAD_RAW), raw).when(fits & (level == 1) & piece.rlike(_HEAD_ESCAPED), escaped)


def parse_turns(body: Column, level: Column) -> Column:
    """Array of (role, text) read from the turns of a formatted text."""
    pieces = F.split(body, r"\Q" + END + r"\E\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: _turn_of(p, level))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, level, loss_spans, source_turns.

    ``loss_spans`` are (start, length) in code points of the formatted text, from
    0, that cover each assistant body in order. Rows are ordered by turn, ties by
    role and text, null turns first; repeated rows are repeated turns. Null role
    or text counts as empty; a null conv_id is a conversation of its own. Only
    conv_id, turn, role and text are used, so further columns cannot clash. An
    empty table gives no rows. A conversation is one output value, so its size
    is bounded by what one string holds.
    """
    t = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Turn by turn first: render, parse again, compare.
    again = parse_turns(render_turn(F.col("role"), F.col("text")), F.lit(0))
    source = F.array(F.struct("role", "text"))
    t = t.withColumn("conflict", ~again.eqNullSafe(source))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", F.max(F.col("conflict").cast("int")).over(whole))
    t = t.withColumn("head", F.concat(F.lit(MARK), F.when(F.col("level") == 1, escape_role(F.col("role"))).otherwise(F.col("role")), F.lit(": ")))
    t = t.withColumn("body", F.when(F.col("level") == 1, escape_text(F.col("text"))).otherwise(F.col("text")))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    first_line = F.concat(F.lit("#format "), F.col("level").cast("string"), F.lit("\n"))
    t = t.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length(first_line))
    one = F.struct(
        "start", "piece", "role", "text",
        F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")).alias("span"),
    )
    g = t.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return g.select(
        "conv_id",
        F.concat(first_line, F.array_join(F.col("turns.piece"), "")).alias("formatted"),
        "level",
        F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["span"]).alias("loss_spans"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations and takes the text under their loss mask.

    Adds parsed (role and text of each turn), loss_text and round_trip (parsed
    equals the source turns).
    """
    level = F.substr(F.col("formatted"), F.lit(9), F.lit(1)).cast("int")
    d = formatted.withColumn("parsed", parse_turns(F.substr(F.col("formatted"), F.lit(11)), level))
    cut = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    plain = F.transform(cut, lambda x: F.when(F.col("level") == 1, unescape(x)).otherwise(x))
    return d.withColumn("loss_text", F.array_join(plain, "")).withColumn("round_trip", F.col("parsed").eqNullSafe(F.col("source_turns")))


def digest(read: DataFrame) -> DataFrame:
    """Lengths and digests of conversations read back; one that differs from its source fails the job."""
    turns = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.when(F.col("round_trip"), True).otherwise(F.raise_error(F.concat(F.lit("not read back as written: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean")).alias("round_trip"),
    )
