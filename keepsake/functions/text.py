"""Column expressions for message text. Each takes and returns a Column.

Word boundaries are written as look-arounds over Unicode letters and digits,
so that they do not fall inside accented words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
LEFT = rf"(?<!{WORD})"
RIGHT = rf"(?!{WORD})"

# --- fixed values: patterns that must equal the reference's for the same results ---
GITHUB_TOKEN = r"gh[pousr]_[A-Za-z0-9_]{12,}"
API_KEY = r"sk-[A-Za-z0-9_-]{10,}"
ACTIVE_TOKEN = r"token-active-\d+"
SECRET_KEYWORD = r"(password|token|api[_ -]?key|secret)"
SECRET_JOINER = r"(\s*(?:is|=|:|for\s+[^:\n]{1,80}?\s+is)\s*)"
INJECTED_HEADINGS = [
    "## Long-Term Memory",
    "## Recent Relevant Episodes",
    "## Current Session Context",
    "## User Profile",
    "[cron:",
]
GREETING = (
    r"(hi+|hello+|hey+|yo+|ok+|okay|sure|thanks?|thx|bye+|good\s*(morning|night|day)|"
    r"好的|嗯|哦|呵|哈|谢谢|再见|早|晚安|你好|您好|ji+|test+|ping)[\s!?.。！？]*"
)
MEMORY_BLOCK = r"<cross_session_memory>.*?</cross_session_memory>"
REPLY_TAG = r"\[\[reply_to_current\]\]|\[\[reply_to:[^\]]*\]\]"
COMPLEX_SIGNALS = (
    r"(?:what|when|where|who|how|why|which|compare|difference|between|all|every|list"
    r"|什么|怎么|哪|为什么|比较|区别|所有|每个|列出)"
)
MIN_MESSAGE_CHARS = 15
# --- end of fixed values ---

SECRET_RULES = {
    "github_token": LEFT + GITHUB_TOKEN + RIGHT,
    "api_key": LEFT + API_KEY + RIGHT,
    "active_token": "(?i)" + LEFT + ACTIVE_TOKEN + RIGHT,
    "keyword_value": (
        "(?i)" + LEFT + SECRET_KEYWORD + RIGHT + SECRET_JOINER + r"(['\"]?)([^'\"\s;,\n]+)\3"
    ),
}
REDACTIONS = [
    ("github_token", "[REDACTED_GITHUB_TOKEN]"),
    ("api_key", "[REDACTED_API_KEY]"),
    ("active_token", "[REDACTED_TOKEN]"),
    ("keyword_value", "$1$2[REDACTED]"),
]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(words: list[str]) -> str:
    """A pattern of the words with common beginnings written once; it looks at the first letter before anything else.

    For words of which at most one matches where a boundary follows: then their order does not matter.
    """

    def tails(items: list[str]) -> str:
        firsts = dict.fromkeys(w[0] for w in items if w)
        parts = [re.escape(c) + tails([w[1:] for w in items if w and w[0] == c]) for c in firsts]
        if "" in items:
            return f"(?:{'|'.join(parts)})?" if parts else ""
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    words = list(dict.fromkeys(words))
    return f"(?=[{''.join(dict.fromkeys(re.escape(w[0]) for w in words))}])" + tails(words)


def strip(text: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_noise(text: Column) -> Column:
    no_block = F.regexp_replace(text, r"(?is)^\s*" + MEMORY_BLOCK + r"\s*", "")
    return strip(F.regexp_replace(no_block, "(?i)" + REPLY_TAG, ""))


def drop_memory_blocks(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)" + MEMORY_BLOCK, ""))


def only_noise(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?is)^\s*" + MEMORY_BLOCK + r"\s*(HEARTBEAT[^\n]*)?\s*$")


def is_trivial(text: Column, min_chars: int = MIN_MESSAGE_CHARS) -> Column:
    return let(strip(text), lambda t: (F.length(t) < min_chars) | t.rlike("(?i)^" + GREETING + "$"))


def is_injected(text: Column) -> Column:
    def opens(t: Column) -> Column:
        hit = F.lit(False)
        for heading in INJECTED_HEADINGS:
            hit = hit | t.startswith(heading)
        return hit

    return let(strip(text), opens)


def contains_secret(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in SECRET_RULES.values():
        hit = hit | text.rlike(pattern)
    return hit


def secret_hits(text: Column, rule: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SECRET_RULES[rule]), F.lit(0)))


def redact(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for rule, replacement in REDACTIONS:
        out = F.regexp_replace(out, SECRET_RULES[rule], replacement)
    return out


def word_count(text: Column) -> Column:
    """Whitespace word count, used as the token estimate."""
    t = strip(text)
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("bigint")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def match_count(text: Column, pattern: str) -> Column:
    return F.size(all_matches(text, pattern))


def slug(name: Column) -> Column:
    """Lower case, spaces to underscores, all marks but CJK letters removed."""
    joined = F.regexp_replace(strip(F.lower(name)), r"\s+", "_")
    return F.regexp_replace(joined, r"[^\p{L}\p{N}_]", "")


def tool_key(name: Column) -> Column:
    return F.substring(F.translate(F.lower(name), " /", "__"), 1, 64)


def search_tokens(text: Column) -> Column:
    """Lower-case Latin words of three letters or more, then runs of two or more CJK letters."""
    low = F.lower(text)
    return F.concat(
        all_matches(low, LEFT + r"[a-z]{3,}" + RIGHT),
        all_matches(low, r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]{2,}"),
    )


# Each word ends at its boundary, so nothing has to be tried again: possessive, a run of very many words needs no stack.
_CAPITALISED = r"[A-Z][a-z]++" + RIGHT
CAPITALISED = LEFT + _CAPITALISED + r"(?:\s++" + _CAPITALISED + ")*+"


def capitalised_entities(text: Column) -> Column:
    """Capitalised phrases, then ISO dates, distinct in order of appearance."""
    return F.array_distinct(
        F.concat(
            all_matches(text, CAPITALISED),
            all_matches(text, LEFT + r"\d{4}-\d{2}-\d{2}" + RIGHT),
        )
    )


def word_set(text: Column) -> Column:
    """Distinct lower-cased white-space words."""
    t = strip(F.lower(text))
    return F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
