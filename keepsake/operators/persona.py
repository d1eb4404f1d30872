"""The profile of a person: best few entries per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators.similarity import word_jaccard
from keepsake.session import cut

# --- fixed values: fields, limits and reject patterns ---
FIELD_OF = {
    "identity": "name", "work": "work", "location": "location", "preference": "preferences", "rule": "rules",
    "skill": "skills", "deadline": "deadlines",
}
FIELD_ORDER = ["name", "work", "location", "preferences", "rules", "skills", "deadlines"]
MAX_ENTRIES, MAX_FIELD_CHARS, MIN_ENTRY_CHARS, OVERLAP = 5, 500, 12, 0.60
ASSISTANT_TALK = (
    r"(?i)(the assistant|claude|i'?m (the|a|an|running|using|ready|sorry|not able|claude)|identifies itself as|model made by"
    r"|made by anthropic|running on claude|i am running|i am claude|i'm claude code|as claude|anthropic)"
)
NOISE = (
    r"(?i)(tool_use_id|is_error|toolu_|'role':|'content':|\"role\":|\"content\":|\{.*?:.*?\}|subagent context|depth \d+/\d+)"
)
STATUS = (
    r"(?i)(nodes? (m\d+|jetson|win\d+)|gitee backup|proxy service|proxy is down|gateway is live|no new crashes"
    r"|disconnected from the network|status alert|re-pairing with openclaw|has been recovered)"
)
KEYWORD_SECRET = r"(?i)" + tx.LEFT + tx.SECRET_KEYWORD + tx.RIGHT + r"\s*(?:is|=|:|for\s+[^:\n]{1,80}?\s+is)\s*['\"]?[^'\"\s;,\n]+"
BAD_NAME = r"(?i)(^我的名字是\s*$|^my name is\s*$|^name\s*$|^unnamed\s*$|^unknown\s*$|^user\s*$|^test\s*$|^example\s*$|^placeholder\s*$)"
NAME_INTRO = r"(?i)(?:my name is|i(?:'m| am)|我叫|我的名字是)\s+([^\s，。！\n]{1,30})"
# --- end of fixed values ---


def entry_words(text: Column) -> Column:
    return F.array_distinct(tx.all_matches(F.lower(text), r"[a-zA-Z\x{4e00}-\x{9fff}]{3,}"))


def rejected(text: Column) -> Column:
    return (
        (F.length(text) < MIN_ENTRY_CHARS) | text.rlike(ASSISTANT_TALK) | text.rlike(NOISE) | text.rlike(STATUS)
        | text.rlike(tx.SECRET_RULES["github_token"]) | text.rlike(tx.SECRET_RULES["api_key"])
        | text.rlike(tx.SECRET_RULES["active_token"]) | text.rlike(KEYWORD_SECRET)
    )


def rejected_name(text: Column, owner: Column) -> Column:
    """Fragments, and introductions of somebody other than the owner."""
    who = F.lower(owner)
    named = F.filter(F.transform(tx.all_matches(text, NAME_INTRO, 1), F.lower), lambda n: ~n.contains(who))
    return text.rlike(BAD_NAME) | (text.contains("我的名字是") & ~F.lower(text).contains(who)) | (F.size(named) > 0)


def entries(facts: DataFrame, owner: Column) -> DataFrame:
    """Usable entries (subject, field, entry) of facts (subject, category, content)."""
    mapping = F.create_map(*[F.lit(x) for kv in FIELD_OF.items() for x in kv])
    line = tx.strip(F.translate("content", "\n\r", "  "))
    rows = facts.select("subject", F.element_at(mapping, F.col("category")).alias("field"), line.alias("entry"), owner.alias("_owner"))
    ok = ~rejected(F.col("entry")) & ((F.col("field") != "name") | ~rejected_name(F.col("entry"), F.col("_owner")))
    return rows.filter(F.col("field").isNotNull() & ok).select("subject", "field", "entry").distinct()


def build(facts: DataFrame, owner: Column) -> DataFrame:
    """(subject, field, rank, entry): longest first, entries that overlap a better one left out, five kept.

    Five rounds. Each takes the best open entry of every field by a combined
    maximum and drops what overlaps it, so no field is ever gathered in one place.
    """
    open_rows = cut(entries(facts, owner).withColumn("w", entry_words(F.col("entry"))))
    kept = None
    for rank in range(1, MAX_ENTRIES + 1):
        best = open_rows.groupBy("subject", "field").agg(
            F.min_by(F.struct("entry", "w"), F.struct(-F.length("entry"), "entry")).alias("b")
        ).select("subject", "field", F.col("b.entry").alias("entry"), F.col("b.w").alias("bw"))
        best = cut(best)
        layer = best.select("subject", "field", F.lit(rank).alias("rank"), "entry")
        kept = layer if kept is None else kept.unionByName(layer)
        if rank == MAX_ENTRIES or best.isEmpty():
            break
        left = open_rows.join(best.withColumnRenamed("entry", "_e"), ["subject", "field"])
        open_rows = cut(
            left.filter((F.col("entry") != F.col("_e")) & (word_jaccard(F.col("w"), F.col("bw")) < OVERLAP)).select("subject", "field", "entry", "w")
        )
    return kept


def profile(persona: DataFrame) -> DataFrame:
    """One value per field; at most five entries each."""
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("rank", "entry")))["entry"], "; ")
    return persona.groupBy("subject", "field").agg(F.substring(joined, 1, MAX_FIELD_CHARS).alias("value"))


def profile_text(fields: DataFrame) -> DataFrame:
    """Text block per subject, fields in fixed order."""
    place = F.array_position(F.array(*[F.lit(f) for f in FIELD_ORDER]), F.col("field"))
    line = F.concat(F.lit("- "), "field", F.lit(": "), "value")
    return fields.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), line.alias("l")))).alias("_l")).select(
        "subject", F.concat(F.lit("## User Profile\n"), F.array_join("_l.l", "\n")).alias("text")
    )
