"""Which turns are kept, and what happens to a fact that resembles a stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text as tx

# --- fixed values: patterns, weights and thresholds ---
ADMISSION_CHARS = 400
THRESHOLD = 0.40
WEIGHTS = {"novelty": 0.25, "entity": 0.15, "fact": 0.20, "time": 0.10, "type": 0.30}
ENTITY = [
    tx.LEFT + r"[A-Z][a-z]{1,}" + tx.RIGHT,
    tx.LEFT + r"\d{4}[-/]\d{2}[-/]\d{2}" + tx.RIGHT,
    tx.LEFT + r"[A-Z]{2,}" + tx.RIGHT,
    tx.LEFT + r"[\p{L}\p{N}_]+\.(?:py|js|ts|sh|json|md)" + tx.RIGHT,
    r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]{2,}",
]
DATE_WORDS = (
    "today|tomorrow|yesterday|monday|tuesday|wednesday|thursday|friday|january|february|march|april|may|june|july"
    "|august|september|october|november|december"
)
DATE_ZH = r"\d{4}年\d{1,2}月(?:\d{1,2}日)?|(?:昨天|今天|明天|上周|下周|上个月|下个月)"
FACT_WORDS = (
    "is|are|was|were|has|have|had|will|prefer|prefers|preferred|use|uses|used|using|like|likes|liked|work|works"
    "|worked|working|live|lives|lived|need|needs|needed|always|never|must|should|remember|remembers|note|notes"
    "|default|workspace|directory|repo|repository|branch|shell|tool|stack|my|our"
)
FACT_ZH = "(?:是|有|在|住|工作|喜欢|需要|记住|总是|从不|必须|应该|我的)"
VALUE_WORDS = (
    "my name|i am|i'm|i work|i live|i prefer|i like|i use|i always|i never|always use|never use|uses|prefers"
    "|default shell|package manager|workspace|directory|repo|repository|branch|project|tool|stack|deadline|remember"
    "|important|rule:|note:|prefer|password|token|key|api|model"
)
VALUE_ZH = "(?:我叫|我是|我在|我住|我喜欢|总是用|截止|记住|重要|密码|令牌)"
OPPOSITES = [
    ("is not", "is"), ("does not", "does"), ("cannot", "can"), ("will not", "will"), ("has no", "has"), ("no longer", ""),
]
SKIP_FACT, SKIP_EPISODE, SKIP_PROCEDURE, CHECK_FACT = 0.95, 0.95, 0.90, 0.80
# --- end of fixed values ---

ENTITY_RE = "|".join(ENTITY)
# The words once more with the first letter in front, as most places hold none of them: at any place at most one of them matches.
_any = lambda words: tx.any_of(words.split("|"))
DATE_RE = "(?i)" + tx.LEFT + r"\d{4}[-/]\d{2}[-/]\d{2}" + tx.RIGHT + "|" + tx.LEFT + _any(DATE_WORDS) + tx.RIGHT + "|" + DATE_ZH
FACT_RE = "(?i)" + tx.LEFT + _any(FACT_WORDS) + tx.RIGHT + "|" + _any(FACT_ZH[3:-1])
# Some of these end in a colon, so the boundary itself is needed here.
VALUE_RE = r"(?iU)\b" + _any(VALUE_WORDS) + rf"\b|{_any(VALUE_ZH[3:-1])}"


def factors(text: Column, novelty: Column) -> dict[str, Column]:
    """The five admission factors, each 0 to 1. ``novelty`` is 1 minus the best stored score."""
    head = F.substring(text, 1, ADMISSION_CHARS)
    zh = F.length(F.regexp_replace(head, r"[^\x{4e00}-\x{9fff}]+", ""))
    words = F.greatest(tx.word_count(head), F.lit(1)) + F.floor(zh / 2)
    one = F.lit(1.0)
    return {
        "novelty": novelty,
        "entity": F.least(one, F.size(F.array_distinct(tx.all_matches(head, ENTITY_RE))) / 4),
        "fact": F.least(one, tx.match_count(head, FACT_RE) / F.greatest(words * 0.15, one)),
        "time": F.least(one, tx.match_count(head, DATE_RE) / 2),
        "type": F.least(one, tx.match_count(head, VALUE_RE) * 0.5),
    }


def admit(turns: DataFrame, text_col: str, best_score: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the factors, ``admission`` and ``admitted``. A null best score means nothing is stored yet."""
    novelty = F.when(F.col(best_score).isNull(), 1.0).otherwise(1 - F.col(best_score))
    parts = factors(F.col(text_col), novelty)
    out = turns.select("*", *[v.alias(f"f_{k}") for k, v in parts.items()])
    total = sum((w * F.col(f"f_{k}") for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("admission", total).withColumn("admitted", F.col("admission") >= threshold)


def ingest_action(best_score: Column, skip: float = SKIP_FACT, check: float | None = CHECK_FACT) -> Column:
    """skip above ``skip``, check above ``check``, else insert."""
    out = F.when(best_score > skip, "skip")
    if check is not None:
        out = out.when(best_score > check, "check")
    return out.otherwise("insert")


def evolve(facts: DataFrame, matches: DataFrame, max_keywords: int = 12) -> DataFrame:
    """Matched facts gain the keywords of the new ones, and a longer topic.

    ``matches``: (fact_id, keywords, topic) of new facts that met a stored one.
    """
    from keepsake.operators.ordering import top_per_group

    members = matches.select("fact_id", F.explode("keywords").alias("_k")).distinct()
    # Only as many new words as can be kept are gathered per fact.
    top = top_per_group(members, ["fact_id"], [F.asc("_k")], max_keywords, "_r")
    words = top.groupBy("fact_id").agg(F.collect_list("_k").alias("_new"))
    topics = matches.filter("topic <> ''").groupBy("fact_id").agg(
        F.max_by("topic", F.struct(F.length("topic"), "topic")).alias("_topic")
    )
    have = F.coalesce("keywords", F.array().cast("array<string>"))
    united = F.slice(F.array_sort(F.array_union(have, F.col("_new"))), 1, max_keywords)
    longer = F.length("_topic") > F.length(F.coalesce("topic", F.lit("")))
    return (
        facts.join(words, "fact_id", "left")
        .join(topics, "fact_id", "left")
        .withColumn("topic", F.when(F.col("_new").isNotNull() & longer, F.substring("_topic", 1, 100)).otherwise(F.col("topic")))
        .withColumn("keywords", F.when(F.col("_new").isNotNull(), united).otherwise(F.col("keywords")))
        .drop("_new", "_topic")
    )


def contradicts(old: Column, new: Column, old_entities: Column, new_entities: Column) -> Column:
    """A shared entity, and one text holds a negation whose positive the other holds."""
    low = lambda a: F.transform(a, F.lower)
    shared = F.arrays_overlap(low(old_entities), low(new_entities))
    a, b = F.lower(old), F.lower(new)
    opposed = F.lit(False)
    for negative, positive in OPPOSITES:
        opposed = opposed | (a.contains(negative) & b.contains(positive)) | (b.contains(negative) & a.contains(positive))
    return F.coalesce(shared, F.lit(False)) & opposed


def contradiction_results(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (old_id, old, new, old_entities, new_entities): superseded ids, and edges between differing entities, both ways.

    Entity lists are capped by the fact schema, so a pair yields few edges.
    """
    hits = pairs.filter(contradicts(F.col("old"), F.col("new"), F.col("old_entities"), F.col("new_entities")))
    gone = hits.select("old_id").distinct().select(
        F.col("old_id").alias("fact_id"), F.lit("contradicted").alias("by"), F.lit("contradicted").alias("reason")
    )
    crossed = hits.select(F.explode("old_entities").alias("src"), "new_entities").select("src", F.explode("new_entities").alias("dst"))
    both = crossed.unionByName(crossed.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = both.filter(F.lower("src") != F.lower("dst")).distinct().select("src", "dst", F.lit("contradicts").alias("type"), F.lit(0.9).alias("confidence"))
    return gone, edges
