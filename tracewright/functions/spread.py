"""Exact medians and percentiles by rank, without holding a group in memory.

Values are counted first (combined before the shuffle). Ranks come from counts
per bin of ``width`` and then per value inside a bin, so that even the one group
"everything" is ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle


def ranked_values(df: DataFrame, by: Sequence[str], value: str, width: float = 86400.0) -> DataFrame:
    """(by..., value, c, n, lo, hi): ``value`` holds the 0-based ranks lo .. hi-1 of its group of n."""
    return ranked_counts(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")), by, value, width)


def ranked_counts(counts: DataFrame, by: Sequence[str], value: str, width: float = 86400.0) -> DataFrame:
    """The same from values that are counted already (column ``c``)."""
    by = list(by)
    # both the bins and the values need the counts: written once, so that what feeds them runs once
    counts = settle(counts.withColumn("__bin", F.floor(F.col(value) / F.lit(float(width)))), "value-counts")
    group = by or [F.lit(1)]
    order = Window.partitionBy(*group).orderBy("__bin")
    bins = counts.groupBy(*by, "__bin").agg(F.sum("c").alias("__in_bin"))
    bins = bins.select(
        *by, "__bin",
        F.coalesce(F.sum("__in_bin").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__in_bin").over(Window.partitionBy(*group)).alias("n"))
    same = F.lit(True)
    for c in [*by, "__bin"]:
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = counts.alias("v").join(bins.alias("b"), same).select("v.*", "b.__before", "b.n")
    inside = Window.partitionBy(*by, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("hi", F.col("__before") + F.sum("c").over(inside))
    return joined.withColumn("lo", F.col("hi") - F.col("c")).drop("__bin", "__before")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate: the value at a 0-based rank of its group."""
    return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col(value)))


def median(value: str) -> Column:
    """Aggregate over ranked values: middle value, or the mean of the middle two."""
    n = F.col("n")
    return (at_rank(value, F.floor((n - 1) / 2)) + at_rank(value, F.floor(n / 2))) / F.lit(2.0)


def p90_round(value: str) -> Column:
    """Value at round(0.9 (n-1)), ties of the rounding to the even rank."""
    return at_rank(value, F.rint(F.lit(0.9) * (F.col("n") - 1)))


def p90_ceil(value: str) -> Column:
    """Value at ceil(0.9 n) counted from one."""
    return at_rank(value, F.least(F.col("n") - 1, F.greatest(F.lit(0), F.ceil(F.lit(0.9) * F.col("n")) - 1)))


def mean(value: str) -> Column:
    return F.sum(F.col(value) * F.col("c")) / F.sum("c")


def spread(df: DataFrame, by: Sequence[str], value: str, width: float = 86400.0) -> DataFrame:
    """n, median, mean, min, max and p90 (rounded rank) of ``value`` per group."""
    return ranked_values(df, by, value, width).groupBy(*by).agg(
        F.sum("c").alias("n"), median(value).alias("median"), mean(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"), p90_round(value).alias("p90"))
