"""How many rows a query asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions import text as tx


def complexity(text: Column) -> Column:
    """0 for a trivial query to 1 for a complex one."""
    words = tx.word_count(text)
    signals = tx.match_count(text, "(?i)" + tx.LEFT + tx.COMPLEX_SIGNALS + tx.RIGHT)
    return F.least(F.lit(1.0), words / 30 + signals * 0.2)


def facts_wanted(text: Column, limit: Column) -> Column:
    base = F.greatest(F.lit(1), F.floor(limit / 2))
    return F.greatest(F.lit(1), F.floor(base * (1 + 0.8 * complexity(text)))).cast("bigint")


def episodes_wanted(text: Column, limit: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(limit * (1 + 0.8 * complexity(text) * 0.5))).cast("bigint")
