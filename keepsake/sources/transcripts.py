"""Chat transcripts as JSON lines -> messages and tool calls.

Parsers take a table of lines (path, line_no, value), so they run on files of
any number and size, and on lines from any other source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators.ordering import with_position

BLOCK = "array<struct<type:string,text:string,name:string>>"
# --- fixed values ---
ERROR_WORDS = ["error", "exception", "traceback", "failed", "not found", "permission denied", "timeout", "command not found"]
MIN_TURNS = 2
# --- end of fixed values ---


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under ``path``, numbered from 0 along each file, also when it is read in splits."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    return with_position(lines, ["path"], [F.col("_row")], F.col("_block"), "line_no").select("path", "line_no", "value")


def _events(lines: DataFrame) -> DataFrame:
    schema = (
        "type string, id string, toolUseResult string, sourceToolAssistantUUID string, "
        "message struct<role:string,content:string>"
    )
    return lines.select("path", "line_no", F.from_json("value", schema).alias("e")).filter(F.col("e").isNotNull())


def _texts(content, with_strings: bool = False):
    """Text blocks of a content column joined by line ends; plain content as it is."""
    blocks = F.from_json(content, BLOCK)
    items = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    joined = F.array_join(F.transform(items, lambda b: b["text"]), "\n")
    if with_strings:
        raw = F.from_json(content, "array<string>")
        text_of = lambda x: F.when(
            x.startswith("{"), F.when(F.get_json_object(x, "$.type") == "text", F.get_json_object(x, "$.text"))
        ).otherwise(x)
        joined = F.array_join(F.filter(F.transform(raw, text_of), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    return tx.strip(F.when(F.ltrim(content).startswith("["), joined).otherwise(content))


def messages_a(lines: DataFrame, project: str = "") -> DataFrame:
    """Format A: ``user`` events that are no tool callbacks, and text of ``assistant`` events."""
    e = _events(lines)
    content = F.col("e.message.content")
    own = (F.col("e.type") == "user") & F.col("e.toolUseResult").isNull() & F.col("e.sourceToolAssistantUUID").isNull()
    user_text = tx.drop_memory_blocks(_texts(content))
    text = F.when(own, user_text).when(F.col("e.type") == "assistant", _texts(content))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1)
    return (
        e.select(
            F.concat(F.lit(f"claudecode:{project}:"), stem).alias("session_id"),
            F.col("line_no").alias("seq"),
            F.col("e.type").alias("role"),
            text.alias("content"),
        )
        .filter(F.coalesce("content", F.lit("")) != "")
    )


def messages_b(lines: DataFrame) -> DataFrame:
    """Format B: ``message`` events of users and assistants; the id comes from the file's ``session`` event."""
    e = _events(lines)
    ids = e.filter("e.type = 'session' AND e.id IS NOT NULL").groupBy("path").agg(F.max_by("e.id", "line_no").alias("header_id"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1)
    text = tx.drop_memory_blocks(_texts(F.col("e.message.content"), with_strings=True))
    return (
        e.filter("e.type = 'message' AND e.message.role IN ('user', 'assistant')")
        .join(ids, "path", "left")
        .select(
            F.coalesce("header_id", stem).alias("session_id"),
            F.col("line_no").alias("seq"),
            F.col("e.message.role").alias("role"),
            text.alias("content"),
        )
        .filter("content <> ''")
    )


def tool_calls(lines: DataFrame) -> DataFrame:
    """Names of ``tool_use`` blocks in order: (path, line_no, block_no, tool)."""
    e = _events(lines)
    return (
        e.select("path", "line_no", F.posexplode(F.from_json("e.message.content", BLOCK)).alias("block_no", "b"))
        .filter("b.type = 'tool_use' AND b.name <> ''")
        .select("path", "line_no", "block_no", F.col("b.name").alias("tool"))
    )


def outcome(output):
    """True unless the lower-cased output holds one of the error words."""
    low = F.lower(F.coalesce(output, F.lit("")))
    bad = F.lit(False)
    for word in ERROR_WORDS:
        bad = bad | low.contains(word)
    return ~bad


def new_sessions(messages: DataFrame, processed: DataFrame, min_turns: int = MIN_TURNS) -> DataFrame:
    """Messages of sessions not in ``processed`` (session_id) with at least ``min_turns`` messages."""
    fresh = messages.join(processed.select("session_id").distinct(), "session_id", "left_anti")
    long_enough = fresh.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_turns)
    return fresh.join(long_enough.select("session_id"), "session_id", "left_semi")
