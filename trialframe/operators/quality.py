"""Outliers, trimming and checks of finished tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.common import join_groups, whole
from trialframe.operators.order import global_rank, group_quantiles
from trialframe.sources.scratch import saved


def nearest_ranks(df: DataFrame, value: str, **quantiles: float) -> DataFrame:
    """One row with a column for each quantile q: the value of rank round(q (n-1)), counted from 0, of all non-null values.

    Values are written once and ranked in ranges, once for all quantiles, so that no task holds them all.
    """
    values = saved(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), "values")
    ranked = global_rank(values, "v", total="_n")
    at = {name: F.col("_k") == F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5) for name, q in quantiles.items()}
    return ranked.agg(*[F.min(F.when(sought, F.col("v"))).alias(name) for name, sought in at.items()])


def nearest_rank_outliers(df: DataFrame, value: str = "reward", area: str = "clean_area", q1: float = 0.01, q2: float = 0.99) -> DataFrame:
    """``nodata`` (no area), ``outlier`` (outside the nearest-rank quantiles; false for null), ``valid`` (neither)."""
    bounds = nearest_ranks(df, value, _low=q1, _high=q2)
    flagged = df.crossJoin(F.broadcast(bounds)).withColumn("nodata", F.col(area) == 0)
    flagged = flagged.withColumn("outlier", F.coalesce((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high")), F.lit(False)))
    return flagged.withColumn("valid", ~(F.col("nodata") | F.col("outlier"))).drop("_low", "_high")


def iqr_filter(df: DataFrame, value: str, keys: tuple[str, ...], multiplier: float = 1.5) -> DataFrame:
    """Rows within the quartiles widened by the multiplier; groups of fewer than four values, and groups without spread, keep [q1, q3] or all rows."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    bounds = join_groups(group_quantiles(df, value, keys, {"_low": 0.25, "_high": 0.75}), sizes, keys)
    spread = F.col("_high") - F.col("_low")
    bounds = bounds.select(*keys, "_n", (F.col("_low") - multiplier * spread).alias("_a"), (F.col("_high") + multiplier * spread).alias("_b"))
    return join_groups(df, bounds, keys).where((F.col("_n") < 4) | F.col(value).between(F.col("_a"), F.col("_b"))).drop("_n", "_a", "_b")


def percentile_bounds(df: DataFrame, value: str, keys: tuple[str, ...], low: float, high: float) -> DataFrame:
    """(keys, low, high) of each group's values, whatever their number."""
    return group_quantiles(df, value, keys, {"low": low, "high": high})


def trimmed_mean(df: DataFrame, value: str, keys: tuple[str, ...], low: float = 0.1, high: float = 0.99) -> DataFrame:
    """Mean of each group's values within its percentiles, bounds included; the plain mean where none are."""
    bounds = percentile_bounds(df, value, keys, low, high)
    inside = F.when(F.col(value).between(F.col("low"), F.col("high")), F.col(value))
    return join_groups(df, bounds, keys).groupBy(*keys).agg(F.coalesce(F.avg(inside), F.avg(value)).alias("trimmed_mean"), F.count(inside).alias("n_inside"), F.count(value).alias("n"))


def outside_bounds(df: DataFrame, value: str, keys: tuple[str, ...], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``outlier``: outside the percentiles of the row's own group."""
    bounds = percentile_bounds(df, value, keys, low, high)
    return join_groups(df, bounds, keys).withColumn("outlier", ~F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")


def not_finite(column: str, array: bool = False) -> Column:
    def bad(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))

    return F.exists(column, bad) if array else bad(F.col(column))


def finite_check(df: DataFrame, scalars: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, n_violations): rows with NaN or infinity in each column."""
    flags = {c: not_finite(c, c in arrays) for c in (*scalars, *arrays)}
    one = df.agg(*[F.coalesce(F.sum(F.coalesce(f, F.lit(False)).cast("long")), F.lit(0)).alias(c) for c, f in flags.items()])
    return one.unpivot([], list(flags), "column_name", "n_violations")


def minmax_scale(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Values scaled to [0, 1]; 0.5 where all are equal."""
    if keys:
        low, high = F.min(value).over(whole(keys)), F.max(value).over(whole(keys))
        return df.withColumn(out, F.when(low == high, 0.5).otherwise(F.try_divide(F.col(value) - low, high - low)))
    joined = df.crossJoin(F.broadcast(df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))))
    return joined.withColumn(out, F.when(F.col("_a") == F.col("_b"), 0.5).otherwise(F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a")))).drop("_a", "_b")


def group_summary(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, mean, median, n, std, min, max) of each group; the median is exact whatever the group's size."""
    sums = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return join_groups(sums, group_quantiles(df, value, keys, {"median": 0.5}), keys, "left").select(*keys, "mean", "median", "n", "std", "min", "max")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n): counts in equal bins from ``low`` to ``high``; bin 0 and bins + 1 hold what lies outside."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column_name, n, mean, std, min, max) in one pass."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def sum_columns(*columns: str) -> Column:
    return reduce(Column.__add__, [F.col(c) for c in columns])
