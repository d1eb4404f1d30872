"""Language, domain and tool-category tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions import text as tx

# --- fixed values: word lists and thresholds that must equal the reference's ---
CJK_SHARE = 0.12
DOMAIN_WORDS = {
    "trading": ["股票", "交易", "a股", "行情", "买入", "卖出", "涨停", "跌停", "接口", "华宝", "证券",
                "trade", "stock", "market", "portfolio", "equity", "ticker", "forex"],
    "coding": ["python", "javascript", "typescript", "golang", "rust", "java", "swift",
               "function", "class", "bug", "api", "backend", "frontend", "refactor", "test",
               "代码", "函数", "接口", "调试", "bug", "编程"],
    "devops": ["docker", "redis", "nginx", "systemd", "ssh", "port", "tunnel", "deploy",
               "kubernetes", "server", "cron", "launchd", "plist", "部署", "服务器"],
    "ai": ["model", "llm", "embedding", "vector", "prompt", "agent", "rag", "claude",
           "gpt", "minimax", "glm", "openai", "fine-tune", "inference", "模型", "向量", "嵌入"],
    "finance": ["revenue", "profit", "roi", "invest", "fund", "vc", "startup", "raise",
                "收入", "利润", "投资", "融资", "估值"],
    "capability": ["tool", "skill", "plugin", "mcp", "resource", "ability", "capability",
                   "what can you", "what tools", "do you have", "can you use", "help me with",
                   "工具", "技能", "插件", "能力", "你能", "你会", "有什么功能"],
}
TOOL_WORDS = {
    "file": ["read", "write", "glob", "grep", "edit", "find", "ls", "cat"],
    "system": ["bash", "shell", "exec", "terminal", "process", "command"],
    "search": ["web", "search", "fetch", "browse", "scrape", "lookup"],
    "code": ["run", "test", "lint", "format", "debug", "compile", "build"],
    "ai": ["llm", "embed", "prompt", "model", "inference", "agent", "claude"],
    "data": ["sql", "query", "database", "redis", "csv", "json", "parse"],
    "git": ["commit", "push", "branch", "diff", "merge", "repo"],
    "web": ["http", "api", "rest", "graphql", "webhook", "request"],
    "memory": ["recall", "store", "remember", "forget", "summarize"],
    "skill": ["skill", "slash", "command", "workflow", "task"],
    "mcp": ["mcp", "server", "resource", "tool", "protocol"],
}
CAPABILITY_QUERY = (
    r"(?:what\s+(?:can|tools?|skills?|plugin|ability|abilities|capabilities?|commands?|resources?)"
    r"|do\s+you\s+have\s+a?\s*(?:tool|skill|way|command|ability)"
    r"|can\s+you\s+(?:use|run|execute|search|read|write|fetch|access)"
    r"|how\s+do\s+i\s+(?:use|run|execute)"
    r"|list\s+(?:all\s+)?(?:tools?|skills?|commands?|capabilities?)"
    r"|你(?:能|会|有)(?:什么|哪些|工具|技能|命令|插件)"
    r"|有什么(?:工具|技能|功能|命令))"
)
# --- end of fixed values ---


def language(text: Column) -> Column:
    total = F.greatest(F.length(text), F.lit(1))
    zh = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    ja = F.length(F.regexp_replace(text, r"[^\x{3040}-\x{30ff}]", ""))
    return F.when(zh / total > CJK_SHARE, "zh").when(ja / total > CJK_SHARE, "ja").otherwise("en")


def best_label(text: Column, words: dict[str, list[str]], default: str = "general") -> Column:
    """Label with most of its words inside the text; the first of equals, ``default`` if none is found."""
    table = F.array(
        *[
            F.struct(F.lit(-i).alias("order"), F.lit(label).alias("label"), F.array(*[F.lit(w) for w in items]).alias("words"))
            for i, (label, items) in enumerate(words.items())
        ]
    )
    found = lambda low, row: F.size(F.filter(row["words"], lambda w: low.contains(w)))
    scored = lambda low: F.transform(table, lambda r: F.struct(found(low, r).alias("n"), r["order"].alias("order"), r["label"].alias("label")))
    best = tx.let(F.lower(text), lambda low: F.array_max(scored(low)))
    return tx.let(best, lambda b: F.when(b["n"] > 0, b["label"]).otherwise(F.lit(default)))


def domain(text: Column) -> Column:
    return best_label(text, DOMAIN_WORDS)


def tool_category(name: Column, description: Column) -> Column:
    return best_label(F.concat_ws(" ", name, description), TOOL_WORDS)


def asks_capability(text: Column) -> Column:
    return text.rlike("(?i)" + tx.LEFT + CAPABILITY_QUERY + tx.RIGHT)
