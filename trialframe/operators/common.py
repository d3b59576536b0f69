"""Keys, windows and time arithmetic that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PLANT = ("experiment", "zone", "plant_id")
ZONE = ("experiment", "zone")
CHANNELS = tuple(f"action_{i}" for i in range(6))
COEFFICIENTS = ("red_coef", "white_coef", "blue_coef")
DAY_MICROS = 86_400_000_000


def over(keys: tuple[str, ...] = PLANT, *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*(order or ("time",)))


def before(keys: tuple[str, ...] = PLANT, *order: str) -> WindowSpec:
    """All rows before the current one."""
    return over(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


def up_to(keys: tuple[str, ...] = PLANT, *order: str) -> WindowSpec:
    return over(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def whole(keys: tuple[str, ...] = PLANT) -> WindowSpec:
    return Window.partitionBy(*keys)


def micros(time: str | Column) -> Column:
    """Microseconds since the epoch; differences are physical, whatever the calendar does in between."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def seconds_of_day(time: str | Column) -> Column:
    time = F.col(time) if isinstance(time, str) else time
    return F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def text(time: str) -> Column:
    return F.col(time).cast("string").alias(time)


#: Rows of a table with one row a group up to which it is broadcast.
BROADCAST_GROUPS = 100_000


def join_groups(df: DataFrame, groups: DataFrame, keys: tuple[str, ...], how: str = "inner", rows: int | None = None) -> DataFrame:
    """``df`` with the other columns of ``groups``, which has one row for each of its keys; null keys are equal.

    ``groups`` is broadcast if it has at most ``rows`` rows (by default BROADCAST_GROUPS), which is looked up.
    """
    if not keys:
        return df.crossJoin(F.broadcast(groups))  # one row
    most = BROADCAST_GROUPS if rows is None else rows
    other = groups.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    if groups.limit(most + 1).count() <= most:
        other = F.broadcast(other)
    joined = df.join(other, [F.col(k).eqNullSafe(F.col(f"_group_{k}")) for k in keys], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_group_{k}" for k in keys])
