"""Running totals and trailing counts over ordered rows of which one key may hold most."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import stored


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with each sum's running total within `by` in ascending `order`, and its total over the group as <name>_total.

    A prefix scan: rows are dealt to ranges of (by, order), each range is summed on its own, and what the ranges before it
    hold of the same group is added as an offset. A group that holds most rows is many ranges, so no task has it whole.
    Nulls come first and are a group of their own; rows that tie in `order` follow in the order they are read, and ties
    of any size are dealt to several ranges. Null summands count as 0. An empty table gives no rows.
    """
    values = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    rows = df.withColumns({**values, "_row": F.monotonically_increasing_id()})
    keys = [*[F.asc_nulls_first(c) for c in (*by, *order)], F.asc("_row")]
    rows = stored(rows.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_slice", *by).orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: F.sum(v).over(here) for name, v in zip(sums, values)})
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_slice", *by).agg(*[F.sum(v).alias(v) for v in values])
    parts = parts.select(F.col("_slice").alias("_s"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values], *[F.sum(v).over(group).alias(f"{v}_all") for v in values])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.col("_slice") == F.col("_s"))
    out = local.join(parts, same)
    return out.select(*df.columns, *[(F.col(name) + F.col(f"{v}_before")).alias(name) for name, v in zip(sums, values)], *[F.col(f"{v}_all").alias(f"{name}_total") for name, v in zip(sums, values)])


def upper_median(df: DataFrame, by: Sequence[str], value: str, n: str | None = None) -> DataFrame:
    """(by, value): each group's upper median, the value of rank floor(n / 2) from 0; nulls don't count, a group of nulls has no row.

    With `n` a row stands for so many. Equal values are counted before the shuffle and ranks come from running(), so a
    group with any number of distinct values is no single task's.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n") if n is None else F.sum(n).alias("_n"))
    ranked = running(counts, by, [value], {"_upto": F.col("_n")})
    half = F.floor(F.col("_upto_total") / 2)
    return ranked.filter((F.col("_upto") > half) & (F.col("_upto") - F.col("_n") <= half)).select(*by, value)


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """left joined with right on `by`, where null equals null."""
    names = {c: f"_r{i}" for i, c in enumerate(by)}
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def trailing(df: DataFrame, key: str, at: Column, spans: dict[str, int]) -> DataFrame:
    """df with, for each name, how many rows of the key lie in the last `span` units of the long `at`, its own included.

    Rows are first counted by (key, at). Counts are dealt to buckets as long as the longest span, each bucket also gets the
    counts of the one before it, and windows look back inside buckets: a task holds two buckets of one key, which have at
    most two spans of different times, however many rows there are. Rows without a time count those without a time; null
    keys are a key. An empty table gives no rows.
    """
    size = max(spans.values())
    rows = df.withColumn("_at", at.cast("long"))
    counts = rows.groupBy(F.col(key).alias("_key"), "_at").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.floor(F.col("_at") / size))
    both = counts.withColumn("_own", F.lit(True)).union(counts.filter("_at is not null").withColumn("_bucket", F.col("_bucket") + 1).withColumn("_own", F.lit(False)))
    back = lambda span: Window.partitionBy("_key", "_bucket").orderBy("_at").rangeBetween(-(span - 1), 0)
    seen = both.withColumns({name: F.sum("_n").over(back(span)) for name, span in spans.items()}).filter("_own").select("_key", F.col("_at").alias("_when"), *spans)
    return rows.drop(*spans).join(seen, F.col(key).eqNullSafe(F.col("_key")) & F.col("_at").eqNullSafe(F.col("_when"))).drop("_key", "_when", "_at")
