"""Scanning the lines of texts for patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..shared import spread

#: Rules in order: name, pattern of a line. The last one only for long runs of base64.
LINE_RULES = (
    ("secret", r"(?i)(token|secret|password|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{12,}"), ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("license", r"(?i)licensed under"),
    ("ip_address", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"), ("base64", r"[A-Za-z0-9+/=]{220}"),
)


#: What a line must hold for a rule's pattern to be tried at all.
GUARDS = {"secret": lambda t: t.contains("=") | t.contains(":"), "license": lambda t: F.lower(t).contains("licensed under"), "email": lambda t: t.contains("@"), "ip_address": lambda t: t.contains("."), "base64": lambda t: F.length(t) >= 220}


def line_pattern_scan(docs: DataFrame, rules: Sequence[tuple[str, str]] = LINE_RULES, cap: int | None = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rule, doc_id, line, text): lines that match, by the first rule that does, as 200 characters; at most `cap` a rule (the report's size)."""
    lines = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        hit = F.col("t").rlike(pattern)
        rule = F.when(GUARDS[name](F.col("t")) & hit if name in GUARDS else hit, name).otherwise(rule)
    found = lines.withColumn("rule", rule).filter("rule is not null").select("rule", "doc_id", (F.col("line") + 1).alias("line"), F.substring("t", 1, 200).alias("text"))
    if cap is None:
        return found
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("doc_id", "line"))
    return found.withColumn("_n", nth).filter(F.col("_n") <= cap).drop("_n")


def line_pattern_counts(docs: DataFrame, rules: Sequence[tuple[str, str]] = LINE_RULES) -> DataFrame:
    return line_pattern_scan(docs, rules, None).groupBy("rule").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("docs"))
