"""Markdown files: sections of memory notes, and skill descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text as tx

# --- fixed values ---
MIN_SECTION_CHARS = 80
SKILL_DOMAINS = {
    "coding": "software-dev", "research": "research", "data_analysis": "analysis", "security": "devops",
    "communication": "general", "automation": "devops", "agentic": "software-dev", "productivity": "general",
    "common_mistakes": "general", "general": "general",
}
# --- end of fixed values ---


def sections(files: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    """Sections of (source, text) files: (source, section_no, topic, content, priority).

    Split before second-level headings; short and injected sections go.
    ``priorities`` holds (source, priority), one row per source.
    """
    parts = files.select("source", F.posexplode(F.split(tx.strip(F.col("text")), r"\n(?=## )")).alias("section_no", "_s"))
    body = tx.strip(F.col("_s"))
    first = F.element_at(F.split(body, "\n"), 1)
    out = parts.filter((F.length(body) >= MIN_SECTION_CHARS) & ~tx.is_injected(body)).select(
        "source",
        "section_no",
        F.substring(tx.strip(F.regexp_replace(first, "^#+", "")), 1, 120).alias("topic"),
        F.substring(body, 1, 2000).alias("content"),
    )
    return out.join(priorities, "source", "left") if priorities is not None else out


def _field(front: Column, name: str) -> Column:
    return tx.strip(F.regexp_extract(front, rf"(?m)^\s*{name}\s*:[ \t]*(.*?)\s*$", 1))


def skills(files: DataFrame) -> DataFrame:
    """Procedures from (path, text) skill files with front matter; rows without name or description go."""
    front = F.regexp_extract("text", r"(?s)^---(.*?)\n---", 1)
    body = tx.strip(F.regexp_replace("text", r"(?s)^---.*?\n---", ""))
    rows = files.filter(F.col("text").rlike(r"(?s)^---.*?\n---")).select(
        "path",
        _field(front, "name").alias("name"),
        _field(front, "description").alias("description"),
        _field(front, "category").alias("_c"),
        body.alias("_body"),
    )
    category = F.when(F.col("_c") == "", "general").otherwise(F.col("_c"))
    domain_map = F.create_map(*[F.lit(x) for kv in SKILL_DOMAINS.items() for x in kv])
    return rows.filter("name <> '' AND description <> ''").select(
        "path",
        "name",
        "description",
        category.alias("category"),
        F.concat(F.lit("[skill:"), "name", F.lit("] "), "description").alias("task"),
        F.when(F.col("_body") != "", F.col("_body")).otherwise(F.col("description")).alias("procedure"),
        F.coalesce(F.element_at(domain_map, category), F.lit("general")).alias("domain"),
    )
