"""Message content: nested blocks to plain text, and size windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions import text as tx

SILENT_BLOCKS = ["tool_use", "tool_result", "thinking"]  # fixed values
SHORT_TEXT = 280
SUMMARY_CHARS = 180
EPISODE_CHARS = 2000
EMBED_CHARS = 500


# Levels of blocks in blocks that are opened. A block as text inside a block's text doubles
# its escapes with each level, so deeper ones do not occur.
DEPTH = 10


def flatten(content: Column, depth: int = DEPTH) -> Column:
    """Plain text of a string that may hold a block or a list of blocks as JSON.

    Blocks of tools and thinking are dropped. Text inside a block may again be
    structured, down to ``depth`` levels.
    """
    raw = tx.strip(F.coalesce(content, F.lit("")))
    if depth == 0:
        return raw

    def part(x: Column) -> Column:
        silent = F.lower(F.coalesce(F.get_json_object(x, "$.type"), F.lit(""))).isin(SILENT_BLOCKS)
        inner = F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.content"), F.lit(""))
        return F.when(~x.startswith("{"), tx.strip(x)).when(silent, "").otherwise(flatten(inner, depth - 1))

    def plain(r: Column) -> Column:
        wrapped = F.when(r.startswith("["), r).when(r.startswith("{"), F.concat(F.lit("["), r, F.lit("]")))
        joined = lambda items: F.trim(F.array_join(F.filter(F.transform(items, part), lambda t: t != ""), " "))
        return tx.let(F.from_json(wrapped, "array<string>"), lambda items: F.coalesce(joined(items), r))

    return tx.let(raw, plain)


def summary_fallback(text: Column) -> Column:
    """Short texts stay; of longer ones the head is kept."""
    return F.when(F.length(text) <= SHORT_TEXT, text).otherwise(F.substring(text, 1, SUMMARY_CHARS))


def shrink_markdown(text: Column, limit: int = 120) -> Column:
    """Headings, links and fences stay; lines over 20 characters are cut and marked; blank lines go."""
    def line(x: Column) -> Column:
        t = tx.strip(x)
        kept = t.startswith("#") | t.startswith("http") | t.startswith("```")
        return F.when(kept, x).when(F.length(t) > 20, F.concat(F.substring(t, 1, limit), F.lit("…"))).when(t != "", x)

    lines = F.filter(F.transform(F.split(text, "\n"), line), lambda x: x.isNotNull())
    return F.array_join(lines, "\n")


def observation_text(tool: Column, given: Column, result: Column) -> Column:
    part = lambda label, c, n: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.substring(c, 1, n)))
    return F.concat_ws("\n", part("Tool: ", tool, 1_000_000), part("Input: ", given, 2000), part("Output: ", result, 4000))
