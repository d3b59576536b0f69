"""Cleaning and regularising telemetry: one row per zone and time on an even grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.common import PLANT, ZONE, over, seconds_of_day, up_to, whole
from trialframe.operators.running import fill_along, has_large_key

#: Local times (hour, minute) at which each cadence takes a row; no hour means every hour.
CADENCES = {"daily": ((9,), 30), "hourly": (None, 30), "4hourly": ((9, 13, 17), 30), "4hourly_full": ((9, 13, 17), 0), "daily_start": ((9,), 0)}


def to_local(df: DataFrame, zone: str | Column = "America/Edmonton", time: str = "time", out: str = "local_time") -> DataFrame:
    """The wall-clock time of an instant (UTC) in ``zone``, which may be a column."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return df.withColumn(out, F.convert_timezone(F.lit("UTC"), zone, F.col(time).cast("timestamp_ntz")))


def truncate_minute(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn(time, F.date_trunc("minute", F.col(time).cast("timestamp")).cast(df.schema[time].dataType))


def on_interval(df: DataFrame, minutes: int = 5, time: str = "time") -> DataFrame:
    """Rows whose minute is a multiple of ``minutes``."""
    return df.where(F.minute(time) % minutes == 0)


def round_interval(time: str | Column, minutes: int = 5) -> Column:
    """The nearest multiple of ``minutes``; halves go to the even multiple."""
    time = F.col(time) if isinstance(time, str) else time
    step = minutes * 60_000_000
    return F.timestamp_micros((F.bround(F.unix_micros(time.cast("timestamp")) / F.lit(float(step)), 0) * step).cast("long"))


def dedup(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...]) -> DataFrame:
    """The first row of each key by ``order``, which should leave no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def regularize(df: DataFrame, keys: tuple[str, ...] = ZONE, time: str = "time", interval: str = "5 minutes") -> DataFrame:
    """Every time from a key's first to its last, with the key's rows where there are any."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {interval}"))).alias(time))
    return grid.join(df, [*keys, time], "left")


def forward_fill(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ZONE, time: str = "time") -> DataFrame:
    """Each column's last value of the key that is not null, up to the row; a key of very many rows is filled in ranges of time."""
    if has_large_key(df, keys):
        return fill_along(df, keys, (time,), columns)
    w = up_to(keys, time)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def lead_columns(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ZONE, time: str = "time", n: int = 1) -> DataFrame:
    """Each column's value ``n`` rows later."""
    w = over(keys, time)
    return df.withColumns({c: F.lead(c, n).over(w) for c in columns})


def time_between(time: str | Column, start: tuple[int, int], end: tuple[int, int], closed: bool = True) -> Column:
    """Whether the time of day is in [start, end], or in [start, end) where not ``closed``."""
    s, low, high = seconds_of_day(time), start[0] * 3600 + start[1] * 60, end[0] * 3600 + end[1] * 60
    return (s >= low) & (s <= high if closed else s < high)


def subsample(df: DataFrame, cadence: str, time: str = "time") -> DataFrame:
    """Rows at a cadence's times; an unknown cadence is an error."""
    if cadence not in CADENCES:
        raise ValueError(f"unknown cadence: {cadence}")
    hours, minute = CADENCES[cadence]
    at = F.minute(time) == minute
    if hours:
        at = at & F.hour(time).isin(*hours)
    if cadence.startswith("daily"):
        at = at & (F.second(time) == 0)
    return df.where(at)


def day_index(df: DataFrame, keys: tuple[str, ...] = ZONE, time: str = "time", out: str = "day", anchor: Column | None = None) -> DataFrame:
    """Days since the key's first date, or since ``anchor``."""
    date = F.to_date(time)
    return df.withColumn(out, F.datediff(date, anchor if anchor is not None else F.min(date).over(whole(keys))))


def group_mean(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Each column's mean over ``keys``, on every row."""
    return df.withColumns({c: F.avg(c).over(whole(keys)) for c in columns})


def mark_repeated_images(df: DataFrame, digest: str = "image_hash", brightness: str = "brightness", day: str = "day", dark: float = 90.0, keys: tuple[str, ...] = PLANT) -> DataFrame:
    """``forward_filled``: a dark frame, or the frame of the plant's previous row on another day."""
    w = over(keys)
    dim = (F.col(brightness) >= 0) & (F.col(brightness) < dark)
    same = (F.col(digest) != "") & (F.col(digest) == F.lag(digest).over(w)) & (F.col(day) != F.lag(day).over(w))
    return df.withColumn("forward_filled", F.coalesce(dim | same, F.lit(False)))


def imaging_gaps(df: DataFrame, flag: str = "forward_filled", day: str = "day", time: str = "time") -> DataFrame:
    """``imaging_gap`` marks whole zone-days with any flagged row; of those only the 09:00 rows stay."""
    gap = df.withColumn("imaging_gap", F.max(flag).over(whole((*ZONE, day)))).drop(flag)
    return gap.where(~F.col("imaging_gap") | ((F.hour(time) == 9) & (F.minute(time) == 0)))


def drop_gap_anchors(df: DataFrame, flag: str = "imaging_gap") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag) if flag in df.columns else df


def good_days(df: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """``is_good_day``: whether ``days(experiment, zone, days)`` lists the day; a zone it lacks has none."""
    listed = days.select(*ZONE, F.col("days").alias("_days"))
    return df.join(listed, list(ZONE), "left").withColumn("is_good_day", F.coalesce(F.array_contains("_days", F.col(day)), F.lit(False))).drop("_days")


def cut_experiments(df: DataFrame, limits: DataFrame, value: str = "wall_time") -> DataFrame:
    """Rows below their experiment's limit in ``limits(experiment, limit)``; other experiments stay whole."""
    return df.join(limits.select("experiment", F.col("limit").alias("_limit")), "experiment", "left").where(F.col("_limit").isNull() | (F.col(value) < F.col("_limit"))).drop("_limit")


def drop_prefixed(df: DataFrame, *prefixes: str, also: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes) or c in also]) if prefixes else df.drop(*also)


def nonzero_actions(df: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    return df.where(reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0.0)) for c in channels]) > 0)


def carry_frames(frames: DataFrame, plants: DataFrame, keys: tuple[str, ...] = ZONE, time: str = "time", values: tuple[str, ...] = ("clean_area",), brightness: str = "brightness", dark: float = 90.0) -> DataFrame:
    """The plants' rows of bright frames, and for each dark frame those of the zone's last frame with rows, at the dark frame's time.

    A frame is dark below ``dark``; rows measured in it are replaced. Plants absent
    from a bright frame stay absent, and dark frames before the first bright one
    have no rows. ``frames(keys, time, brightness)`` has a row for each frame.
    """
    w = up_to(keys, time)
    dim = F.coalesce(F.col(brightness) < dark, F.lit(False))
    seen = plants.select(*keys, time).distinct().withColumn("_rows", F.lit(True))
    shown = frames.groupBy(*keys, time).agg(F.min(dim).alias("_dark")).join(seen, [*keys, time], "left")
    source = F.last(F.when(~F.col("_dark") & F.col("_rows"), F.col(time)), ignorenulls=True).over(w)
    shown = shown.withColumn("_from", F.when(F.col("_dark"), source).otherwise(F.col(time))).select(*keys, F.col(time).alias("_at"), "_from", "_dark")
    rows = plants.select(*keys, "plant_id", F.col(time).alias("_from"), *values)
    return shown.join(rows, [*keys, "_from"]).select(*keys, "plant_id", F.col("_at").alias(time), *values, F.col("_dark").alias("carried"))


def null_audit(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column_name, n_rows, n_nulls) of each column in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns])
    return one.unpivot(["n"], list(columns), "column_name", "n_nulls").select("column_name", F.col("n").alias("n_rows"), "n_nulls")
