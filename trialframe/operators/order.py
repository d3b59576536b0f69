"""Ranks and quantiles of whole tables and of groups of any size, without a task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.common import join_groups
from trialframe.sources.scratch import saved

#: Ranges of values that are ranked apart.
RANGES = 256


def in_ranges(df: DataFrame, value: str) -> DataFrame:
    """``_part``: which of RANGES ranges of about equal numbers of rows the value is in; equal values share one."""
    marks = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    splits = df.agg(F.percentile_approx(F.col(value).cast("double"), marks, 10_000).alias("_splits"))
    below = F.coalesce(F.size(F.filter("_splits", lambda s: s < F.col(value))), F.lit(0))
    return df.crossJoin(F.broadcast(splits)).withColumn("_part", below).drop("_splits")


def global_rank(df: DataFrame, value: str, ties: tuple[str, ...] = (), out: str = "_k", total: str | None = None) -> DataFrame:
    """``out``: each row's place from 0 by ``value`` and then ``ties``; null values must be left out before.

    ``total``, if given, is a column with the number of all rows.
    """
    parts = in_ranges(df, value)
    sizes = _sizes(parts, total)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(value, *ties))
    return parts.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + own - 1).drop("_part", "_before")


def _sizes(parts: DataFrame, total: str | None = None) -> DataFrame:
    """(_part, _before): the rows before each range; RANGES rows at most."""
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = [F.sum("_n").over(Window.partitionBy()).alias(total)] if total else []
    return sizes.select("_part", before.alias("_before"), *whole)


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: each row's rank from 1, the mean of the ranks of equal values; null values must be left out before."""
    parts = in_ranges(df, value)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    first = F.rank().over(Window.partitionBy("_part").orderBy(value))
    equal = F.count("*").over(Window.partitionBy("_part", value))
    return parts.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + first + (equal - 1) / 2).drop("_part", "_before")


#: Values of a group that one task may hold to find its quantiles.
LARGE_GROUP = 1 << 20


def group_quantiles(df: DataFrame, value: str, keys: tuple[str, ...], quantiles: dict[str, float], large: int | None = None) -> DataFrame:
    """(keys, a column for each quantile): linear between neighbours, as ``percentile`` gives it, of each group's non-null values.

    Groups of more than ``large`` values (by default LARGE_GROUP) are never held as
    such: their values are counted in ranges, only the ranges that hold a sought rank
    are looked into, and there equal values are one row with a number. A range has about
    one in RANGES of a group's values. Null keys are a group; NaN is the largest value.
    """
    large = LARGE_GROUP if large is None else large
    v = F.col(value).cast("double")
    rows = saved(df.where(v.isNotNull()).select(*keys, v.alias("_v")), "group-values")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > large)
    plain = lambda part: part.groupBy(*keys).agg(*[F.percentile("_v", F.lit(q)).alias(name) for name, q in quantiles.items()])
    big = saved(sizes, "large-groups")
    if not big.limit(1).count():
        return plain(rows)
    many = join_groups(rows, big, keys)
    found = _selected(many, big, keys, quantiles)
    return plain(join_groups(rows, big, keys, "left_anti")).unionByName(found) if keys else found


def _selected(rows: DataFrame, sizes: DataFrame, keys: tuple[str, ...], quantiles: dict[str, float]) -> DataFrame:
    """The quantiles of groups (``sizes``: keys, _n) by selection within ranges."""
    marks = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    splits = saved(rows.groupBy(*keys).agg(F.percentile_approx("_v", marks, 10_000).alias("_splits")), "splits")
    below = F.size(F.filter("_splits", lambda s: s < F.col("_v")))
    parts = join_groups(rows, splits, keys, rows=10_000).withColumn("_part", below).drop("_splits")
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    by_key = Window.partitionBy(*keys).orderBy("_part")  # RANGES rows a group
    counts = counts.withColumn("_from", F.sum("_c").over(by_key) - F.col("_c"))
    sought = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for name, q in quantiles.items()])
    ranks = sizes.select(*keys, F.explode(sought).alias("_s")).select(*keys, F.col("_s.name").alias("_name"), F.col("_s.at").alias("_at"))
    ends = F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k")
    ranks = saved(ranks.select(*keys, "_name", "_at", ends).distinct(), "sought-ranks")
    held = join_groups(counts, ranks, keys).where("_k >= _from and _k < _from + _c").select(*keys, "_part", "_from", "_name", "_at", "_k")
    held = saved(held, "sought-ranges")
    inside = join_groups(parts, held.select(*keys, "_part").distinct(), (*keys, "_part"), "left_semi")
    values = inside.groupBy(*keys, "_part", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    placed = values.withColumn("_before", upto - F.col("_c"))
    at = join_groups(placed, held, (*keys, "_part")).where("_k - _from >= _before and _k - _from < _before + _c")
    low, high = F.min_by("_v", "_k"), F.max_by("_v", "_k")
    at_ = F.first("_at")
    between = F.when(low == high, low).otherwise((F.ceil(at_) - at_) * low + (at_ - F.floor(at_)) * high)
    return at.groupBy(*keys, "_name").agg(between.alias("_q")).groupBy(*keys).pivot("_name", list(quantiles)).agg(F.first("_q"))
