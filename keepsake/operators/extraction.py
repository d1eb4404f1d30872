"""Facts out of text: rule matches, structured model output, types, chains and procedures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import decay
from keepsake.functions import text as tx
from keepsake.operators.ordering import with_next, with_previous

W = r"\p{L}\p{N}_"  # members of a word, inside a character class

# --- fixed values: extraction patterns (category, pattern) in order; (?i) marks case-blind ones ---
FACT_RULES = [
    ("identity", r"(?i)(?:my name is|I am|I'm)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"),
    ("work", r"(?i)(?:I (?:work|am working) (?:at|for)|I work as)\s+(.+?)(?:\.|,|$)"),
    ("work", r"(?i)I'?m (?:a|an)\s+([^,.]+?)\s+(?:at|for|in)\s+(.+?)(?:\.|,|$)"),
    ("work", r"(?i)I'?m (?:a|an)\s+([A-Za-z][" + W + r"\s]{3,30})(?:\.|,|$)"),
    ("work", r"(?i)I(?:'ve been| have been) (?:working|teaching|practicing|researching)\s+(?:at|for|as|in)\s+(.+?)(?:\.|,|$)"),
    ("work", r"(?i)I(?:'ve been| have been) (?:a|an)\s+([^,.]+?)\s+for\s+(\d+\s+[" + W + r"]+)"),
    ("work", r"(?i)(?:at|for)\s+([A-Z][A-Za-z\s&]{2,40}),?\s+(?:I(?:'m| am)|my role)"),
    ("location", r"(?i)(?:I (?:live|am|stay) in|I'm from|I'm based in)\s+(.+?)(?:\.|,|$)"),
    ("location", r"(?i)(?:I (?:bought|rent|own|moved to))\s+(?:a\s+[" + W + r"]+\s+in|to)\s+(.+?)(?:\.|,|$)"),
    ("location", r"(?i)\b(?:bought|purchased|own|renting|rented|moved to)\s+(?:a|an|my)\s+[" + W + r"]+\s+in\s+([A-Z][A-Za-z\s]{2,30}?)(?:\s+(?:last|this|two|three|four)|[.,]|$)"),
    ("personal", r"(?i)I (?:studied|went to|graduated from|did my (?:PhD|degree|masters?|MBA|MFA|BA|BS) at)\s+(.+?)(?:\.|,|$)"),
    ("personal", r"(?i)my (?:PhD|degree|masters?|MFA|MBA|BA|BS)\s+(?:is|was|from)\s+(?:at\s+)?(.+?)(?:\.|,|$)"),
    ("personal", r"(?i)(?:I've been|I have been)\s+(.+?)\s+for\s+([" + W + r"]+\s+(?:years?|months?|weeks?))"),
    ("preference", r"(?i)(?:I (?:like|love|prefer|enjoy|hate|dislike))\s+(.+?)(?:\.|,|$)"),
    ("personal", r"(?i)(?:my (?:partner|wife|husband|sister|brother|friend|coworker|colleague|neighbor))\s+([A-Z][a-z]+)"),
    ("personal", r"(?i)(?:my (?:phone|email|address|birthday|goal|project) is)\s+(.+?)(?:\.|,|$)"),
    ("reminder", r"(?i)(?:remember|note|important):\s*(.+?)(?:\.|$)"),
    ("rule", r"(?i)(?:always|never|always use|never use)\s+(.+?)(?:\.|,|$)"),
    ("credential", r"(?i)(?:the (?:api|key|token|secret|password) (?:is|for .+ is))\s+(\S+)"),
    ("deadline", r"(?i)(?:deadline|due date|by)\s+([" + W + r"\s,]+\d{4}|\d{4}-\d{2}-\d{2})"),
    ("tool_use", r"(?i)(?:I (?:used|ran|executed|called|invoked)|using|via)\s+([" + W + r"\-]+(?:\s+tool|command)?)\s+to\s+(.+?)(?:\.|,|$)"),
    ("capability_gained", r"(?i)(?:installed|added|enabled|activated)\s+(.+?)\s+(?:tool|plugin|skill|extension|mcp)"),
    ("env_change", r"(?i)(?:switched to|now using|changed to|upgrade to)\s+(.+?)(?:\.|,|$)"),
    ("env_context", r"(?i)(?:the (?:current|active) (?:environment|env|dir|directory|branch|project|workspace) is)\s+(.+?)(?:\.|,|$)"),
    ("procedure", r"(?i)(?:to (?:fix|solve|handle|do|implement|run|search|find|create|build))\s+(.+?),?\s+(?:I|you should|we|use|run|try)\s+(.+?)(?:\.|$)"),
    ("procedure", r"(?i)(?:the (?:best|correct|right) way to)\s+(.+?)\s+is\s+(?:to\s+)?(.+?)(?:\.|$)"),
    ("procedure", r"(?i)(?:workflow|steps?|process) (?:for|to)\s+(.+?):\s*(.+?)(?:\.|$)"),
    ("procedure", r"(?i)(?:always|when)\s+(.+?),\s+(?:use|run|call|execute)\s+(.+?)(?:\.|,|$)"),
    ("identity", r"(?:我叫|我的名字是)\s*(.{1,20}?)(?:[，。！\n]|$)"),
    ("work", r"我在([^\s，。！？]{2,30}?)(?:工作|上班)(?:[，。！\n]|$)"),
    ("work", r"我(?:是|做)(?:一名|一个)?\s*([^\s，。！？]{2,20}?)(?:[，。！\n]|$)"),
    ("work", r"我的(?:工作|职位|职业|岗位)是\s*(.{1,30}?)(?:[，。！\n]|$)"),
    ("location", r"我(?:住在|居住在|定居在|在.{0,3}住|来自|生活在)\s*(.{1,30}?)(?:[，。！\n]|$)"),
    ("location", r"我(?:现在|目前)在\s*(.{1,20}?)(?:[，。！\n]|$)"),
    ("personal", r"我(?:在|毕业于|就读于|读书于)\s*(.{2,30}?)(?:读书|学习|毕业)?(?:[，。！\n]|$)"),
    ("personal", r"我的学校(?:是|叫)\s*(.{2,30}?)(?:[，。！\n]|$)"),
    ("personal", r"我(?:已经|已)?(.{2,20}?)[了]?\s*(\d+\s*(?:年|个月|周))(?:[，。！\n]|$)"),
    ("preference", r"我(?:喜欢|热爱|爱好|偏好|不喜欢|讨厌)\s*(.{1,40}?)(?:[，。！\n]|$)"),
    ("personal", r"我的(?:伴侣|妻子|丈夫|老婆|老公|姐姐|妹妹|哥哥|弟弟|朋友|同事|邻居)\s*(.{1,10}?)(?:[，。！是叫\n]|$)"),
    ("reminder", r"(?:记住|注意|重要)[：:]\s*(.{1,100}?)(?:[。！\n]|$)"),
    ("rule", r"(?:总是|始终|永远|绝对不|从不)\s*(.{1,60}?)(?:[，。！\n]|$)"),
    ("deadline", r"(?:截止|截止日期|deadline)[是为：:]\s*(.{1,30}?)(?:[，。！\n]|$)"),
]
# Of these words (lower case) every match of the rule holds one. In the order of the rules.
RULE_WORDS = dict(zip((p for _, p in FACT_RULES), [
    ["my name is", "i am", "i'm"],
    ["i work", "i am working"],
    ["im a", "i'm a"],
    ["im a", "i'm a"],
    ["i've been", "i have been"],
    ["i've been", "i have been"],
    ["i'm", "i am", "my role"],
    ["i live in", "i am in", "i stay in", "i'm from", "i'm based in"],
    ["i bought", "i rent", "i own", "i moved to"],
    ["bought", "purchased", "own", "rent", "moved to"],
    ["i studied", "i went to", "i graduated from", "i did my"],
    ["my "],
    ["i've been", "i have been"],
    ["i like", "i love", "i prefer", "i enjoy", "i hate", "i dislike"],
    ["my partner", "my wife", "my husband", "my sister", "my brother", "my friend", "my coworker", "my colleague", "my neighbor"],
    ["my phone is", "my email is", "my address is", "my birthday is", "my goal is", "my project is"],
    ["remember:", "note:", "important:"],
    ["always", "never"],
    ["the api", "the key", "the token", "the secret", "the password"],
    ["deadline", "due date", "by"],
    ["i used", "i ran", "i executed", "i called", "i invoked", "using", "via"],
    ["installed", "added", "enabled", "activated"],
    ["switched to", "now using", "changed to", "upgrade to"],
    ["the current", "the active"],
    ["to fix", "to solve", "to handle", "to do", "to implement", "to run", "to search", "to find", "to create", "to build"],
    ["the best way to", "the correct way to", "the right way to"],
    ["workflow", "step", "process"],
    ["always", "when"],
    ["我叫", "我的名字是"],
    ["我在"],
    ["我是", "我做"],
    ["我的"],
    ["我"],
    ["我现在", "我目前"],
    ["我在", "我毕业于", "我就读于", "我读书于"],
    ["我的学校"],
    ["我"],
    ["我"],
    ["我的"],
    ["记住", "注意", "重要"],
    ["总是", "始终", "永远", "绝对不", "从不"],
    ["截止", "deadline"],
], strict=True))
IMPORTANCE_FLOOR = {
    "identity": 0.80, "rule": 0.80, "preference": 0.75, "work": 0.65, "personal": 0.65, "reminder": 0.65,
    "decision": 0.60, "procedure": 0.55, "location": 0.55, "capability_gained": 0.55, "env_change": 0.50,
    "tool_use": 0.45, "env_context": 0.40, "context": 0.35, "general": 0.30,
}
DEFAULT_FLOOR = 0.35
KNOWN_TOOLS = [
    "bash", "glob", "grep", "read", "edit", "write", "websearch", "webfetch", "agent", "task", "notebook",
    "notebookedit", "mcp", "skill",
]
EPISODE_TYPES = [
    ("decision", ["decision"]),
    ("procedure", ["procedure"]),
    ("feature", ["capability_gained"]),
    ("change", ["env_change"]),
    ("discovery", ["identity", "work", "personal", "location"]),
    ("preference", ["preference", "rule", "reminder"]),
    ("context", ["tool_use"]),
]
# --- end of fixed values ---


def rule_matches(text: Column) -> Column:
    """Array of (category, content): every match of every rule, a snippet once, by its first rule.

    A rule is only tried on a text that holds, in any case, one of the words each of its matches has.
    """
    none = F.array().cast("array<string>")

    def hits(low: Column, category: str, pattern: str) -> Column:
        as_fact = lambda m: F.struct(F.lit(category).alias("category"), F.substring(tx.strip(m), 1, 200).alias("content"))
        held = reduce(lambda a, b: a | b, [low.contains(w) for w in RULE_WORDS[pattern]])
        # The other way round, so that a null text stays null.
        return F.transform(F.when(~held, none).otherwise(tx.all_matches(text, pattern)), as_fact)

    def first_only(all_hits: Column) -> Column:
        texts = F.transform(all_hits, lambda y: y["content"])
        return tx.let(texts, lambda ts: F.filter(all_hits, lambda x, i: F.array_position(ts, x["content"]) == i + 1))

    found = tx.let(F.lower(text), lambda low: F.concat(*[hits(low, c, p) for c, p in FACT_RULES]))
    return tx.let(F.filter(found, lambda x: x["content"] != ""), first_only)


def drop_contained(facts: Column) -> Column:
    """In order, a fact whose lower-cased content holds or is held by a kept one is dropped."""
    start = F.slice(facts, F.lit(1), F.lit(0))

    def add(kept, x):
        low = F.lower(x["content"])
        same = F.exists(kept, lambda y: F.lower(y["content"]).contains(low) | low.contains(F.lower(y["content"])))
        return F.when(same, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(facts, start, add)


def rule_facts(turns: DataFrame, id_col: str, text_col: str = "text", dedup: bool = True) -> DataFrame:
    """One row per extracted fact: (id, fact_no, category, content, confidence).

    The work of a turn stays in its row: no shuffle. The match array is put in
    its own column first, so that it is computed once.
    """
    found = turns.select(id_col, rule_matches(F.col(text_col)).alias("_f"))
    kept = drop_contained(F.col("_f")) if dedup else F.col("_f")
    # The outer form: for the other one the planner repeats the whole match expression in a filter on its size.
    return found.select(id_col, F.posexplode_outer(kept).alias("fact_no", "_x")).where("fact_no is not null").select(
        id_col, "fact_no", "_x.category", "_x.content", F.lit(0.8).alias("confidence")
    )


MODEL_FACT = (
    "array<struct<lossless_restatement:string,content:string,category:string,importance:double,"
    "keywords:array<string>,persons:array<string>,entities:array<string>,topic:string,location:string,"
    "triple:struct<s:string,p:string,o:string>>>"
)
# Possessive throughout: the branches exclude each other, and a long answer needs no stack.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = r'\{(?:[^{}"]++|' + _STRING + r")*+\}"
_OBJECT = r'\{(?:[^{}"]++|' + _STRING + "|" + _FLAT + r")*+\}"


def parse_array(raw: Column) -> Column:
    """JSON array text of a model answer: fences off, and a broken tail cut after the last whole object."""
    bare = lambda t: F.when(
        t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```[^`]*$", "")
    ).otherwise(raw)

    def found(body: Column) -> Column:
        prefix = F.regexp_extract(body, r"(?s)\[\s*(" + _OBJECT + r"(?:\s*+,\s*+" + _OBJECT + r")*+)", 1)
        cut_off = tx.let(prefix, lambda p: F.when(p != "", F.concat(F.lit("["), p, F.lit("]"))))
        whole = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
        return tx.let(whole, lambda w: F.when((w != "") & F.try_parse_json(w).isNotNull(), w).otherwise(cut_off))

    return tx.let(tx.let(tx.strip(raw), bare), found)


def model_facts(answers: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """Structured facts of model output: short texts and credentials dropped, importance clamped and floored."""
    rows = answers.select(id_col, F.posexplode(F.from_json(parse_array(F.col(raw_col)), MODEL_FACT)).alias("fact_no", "x"))
    body = F.coalesce(F.when(F.col("x.lossless_restatement") != "", F.col("x.lossless_restatement")), F.col("x.content"), F.lit(""))
    category = F.coalesce("x.category", F.lit("general"))
    floor = decay.lookup(category, IMPORTANCE_FLOOR, DEFAULT_FLOOR)
    importance = F.greatest(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.importance", F.lit(0.5)))), floor)
    part = lambda c: F.coalesce(F.col(f"x.triple.{c}"), F.lit(""))
    whole = (part("s") != "") & (part("p") != "") & (part("o") != "")
    cut = lambda c, n: F.when(whole, F.substring(tx.strip(part(c)), 1, n))
    return (
        rows.filter((F.length(tx.strip(body)) >= 10) & (category != "credential"))
        .select(
            id_col, "fact_no", F.substring(tx.strip(body), 1, 500).alias("content"), category.alias("category"),
            F.lit(0.9).alias("confidence"), importance.alias("importance"), "x.keywords", "x.persons", "x.entities",
            "x.topic", "x.location", cut("s", 100).alias("triple_s"), cut("p", 100).alias("triple_p"), cut("o", 200).alias("triple_o"),
        )
    )


def episode_type(categories: Column) -> Column:
    """The first type of the list whose categories occur."""
    out = F.lit("general")
    for name, members in reversed(EPISODE_TYPES):
        out = F.when(F.arrays_overlap(categories, F.array(*[F.lit(m) for m in members])), name).otherwise(out)
    return out


def type_episodes(facts: DataFrame, id_col: str) -> DataFrame:
    """Type per episode; at most one row per category reaches the second step."""
    return facts.groupBy(id_col).agg(F.collect_set("category").alias("_c")).select(id_col, episode_type(F.col("_c")).alias("ep_type"))


def chain_episodes(episodes: DataFrame, chunk: Column) -> DataFrame:
    """Adds the previous and next episode of the session, by time and id."""
    back = with_previous(episodes, ["session_id"], ["ts", "episode_id"], chunk, ["episode_id"])
    both = with_next(back, ["session_id"], ["ts", "episode_id"], chunk, ["episode_id"])
    return both.withColumn("prev_episode_id", F.col("previous.episode_id")).withColumn(
        "next_episode_id", F.col("following.episode_id")
    ).drop("previous", "following")


def procedure_facts(facts: DataFrame) -> DataFrame:
    """Facts of category procedure as procedures, with the known tools they name."""
    low = F.lower("content")
    tools = F.filter(F.array(*[F.lit(t) for t in KNOWN_TOOLS]), lambda t: low.contains(t))
    return facts.filter("category = 'procedure'").withColumn("task", F.substring("content", 1, 300)).withColumn(
        "procedure", F.substring("content", 1, 1000)
    ).withColumn("tools_used", F.slice(tools, 1, 8))
