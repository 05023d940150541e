"""Rules by pattern over texts: one scan for all rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_hits(texts: DataFrame, patterns: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Rows of ``texts`` by rule: one scan with an alternation as a pre-filter, then a row per rule
    that matches. ``patterns``: (rule, pattern)."""
    anything = "|".join(f"(?:{p})" for _, p in patterns)
    found = F.array(*[F.when(F.col(text).rlike(p), F.lit(rule)) for rule, p in patterns])
    hits = F.filter(found, lambda r: r.isNotNull())
    return texts.where(F.col(text).rlike(anything)).withColumn("rule", F.explode(hits))
