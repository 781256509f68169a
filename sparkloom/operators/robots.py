"""robots.txt rules as tables: parsing and deciding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import trimmed


def parse_robots(df: DataFrame, agent: str) -> DataFrame:
    """(host, section, allow, path) of (host, content): the rules of sections for * or for a name that `agent` holds.

    Every User-agent line begins a section of its own; lines before the first and empty paths don't count.
    """
    lines = df.select("host", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line", trimmed(F.col("line"))).filter("line != '' and not startswith(line, '#')")
    low = F.lower("line")
    head = low.startswith("user-agent:")
    value = lambda n: trimmed(F.substring("line", n + 1, 1 << 30))
    upto = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_ua", F.when(head, F.lower(value(11)))).withColumn("section", F.sum(head.cast("int")).over(upto)).withColumn("_ua", F.last("_ua", True).over(upto))
    path = F.when(low.startswith("allow:"), value(6)).when(low.startswith("disallow:"), value(9))
    rows = rows.withColumn("allow", low.startswith("allow:")).withColumn("path", path)
    mine = (F.col("_ua") == "*") | F.lit(agent.lower()).contains(F.col("_ua"))
    return rows.filter(mine & F.col("path").isNotNull() & (F.col("path") != "")).select("host", F.col("section").cast("int").alias("section"), "allow", "path")


def rule_matches(path: Column, rule: Column) -> Column:
    """A rule is a prefix; * in it stands for any text, all else for itself."""
    quoted = F.regexp_replace(F.regexp_replace(rule, r"([.+?^$\{\}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.when(rule.contains("*"), F.regexp_like(path, F.concat(F.lit("^"), quoted))).otherwise(path.startswith(rule))


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) with allowed: the longest matching rule of the first section with any match; ties allow, none allows."""
    size = F.length(F.regexp_replace("path", r"\*", ""))
    each = F.struct((-F.col("section")).alias("section"), size.alias("size"), F.col("allow").cast("int").alias("allow"), "path")
    of_host = rules.groupBy(F.col("host").alias("_h")).agg(F.collect_list(each).alias("_rules"))  # one robots.txt a host
    hits = F.filter("_rules", lambda r: rule_matches(F.col("path"), r["path"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["section"].alias("section"), r["size"].alias("size"), r["allow"].alias("allow"))))
    rows = urls.join(of_host, F.col("host") == F.col("_h"), "left")
    return rows.withColumn("allowed", F.coalesce(best["allow"] == 1, F.lit(True))).drop("_h", "_rules")
