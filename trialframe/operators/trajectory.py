"""Trajectories: rewards, energy, truncation, episodes and transitions of each plant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.common import DAY_MICROS, PLANT, ZONE, before, micros, over, up_to, whole
from trialframe.operators.order import in_ranges
from trialframe.operators.order import global_rank

HOUR_MICROS = DAY_MICROS // 24


def log_area(df: DataFrame, area: str = "clean_area", out: str = "log_clean_area") -> DataFrame:
    """The logarithm of a positive area, else null; ``area`` stands in for an absent ``clean_area``."""
    if area not in df.columns and "area" in df.columns:
        df = df.withColumn(area, F.col("area"))
    return df.withColumn(out, F.when(F.col(area) > 0, F.ln(F.when(F.col(area) > 0, F.col(area)))))


def mean_area(df: DataFrame, keys: tuple[str, ...] = (*ZONE, "time"), area: str = "clean_area") -> DataFrame:
    return df.withColumn("mean_clean_area", F.avg(area).over(whole(keys)))


def step_reward(df: DataFrame, value: str = "log_clean_area", bolted: str | None = "bolted_pred", null_first: bool = False, keys: tuple[str, ...] = PLANT) -> DataFrame:
    """Change of ``value`` since the plant's previous row; 0 once bolted, and 0 for null unless ``null_first``."""
    change = F.col(value) - F.lag(value).over(over(keys))
    if bolted:
        change = F.when(F.col(bolted), F.lit(0.0)).otherwise(change)
    return df.withColumn("reward", change if null_first else F.coalesce(change, F.lit(0.0)))


def daily_reward(df: DataFrame, value: str = "log_clean_area", keys: tuple[str, ...] = PLANT, time: str = "time") -> DataFrame:
    """Change of ``value`` where the previous row is exactly 24 hours earlier, else null."""
    w = over(keys, time)
    apart = micros(time) - F.lag(micros(time)).over(w)
    return df.withColumn("reward", F.when(apart == DAY_MICROS, F.col(value) - F.lag(value).over(w)))


def truncated_daily(df: DataFrame, keys: tuple[str, ...] = PLANT, time: str = "time") -> DataFrame:
    """Whether there is a next row and it is not 24 hours later."""
    apart = F.lead(micros(time)).over(over(keys, time)) - micros(time)
    return df.withColumn("truncated", F.coalesce(apart != DAY_MICROS, F.lit(False)))


def truncated_step(df: DataFrame, cadence: str = "daily", keys: tuple[str, ...] = PLANT, time: str = "time", last_day: float = 13.0) -> DataFrame:
    """Whether the trajectory breaks off: no row after next before ``last_day`` without a terminal, or a next row that comes at another time than the cadence's."""
    w = over(keys, time)
    following = F.lead(micros(time)).over(w)
    expected = {"daily": F.lit(DAY_MICROS), "4hourly": F.when(F.hour(time) == 17, 16 * HOUR_MICROS).otherwise(4 * HOUR_MICROS)}.get(cadence, F.lit(HOUR_MICROS))
    short = F.lead(time, 2).over(w).isNull() & ~F.col("terminal") & (F.col("wall_time") < last_day)
    return df.withColumn("truncated", short | F.coalesce(following - micros(time) != expected, F.lit(False)))


def terminal(df: DataFrame, probability: str = "bolted_prob", day: str = "day", wall: str = "wall_time", threshold: float = 0.5, first_day: float = 7.0, last_day: int | None = 13) -> DataFrame:
    """``bolted_pred`` from the probability once ``first_day`` is reached; ``terminal`` adds the last day, if there is one."""
    bolted = (F.col(probability) > threshold) & (F.col(wall) >= first_day)
    df = df.withColumn("bolted_pred", bolted)
    return df.withColumn("terminal", F.col("bolted_pred") | (F.col(day) >= last_day) if last_day is not None else F.col("bolted_pred"))


# -- energy

def step_energy(df: DataFrame, keys: tuple[str, ...] = ZONE, power: str = "power", minutes: float = 5.0, time: str = "time") -> DataFrame:
    """Watt hours of each step (the next row's power) and their running sum; as it is without a power column."""
    if power not in df.columns:
        return df
    energy = F.lead(power).over(over(keys, time)) * (minutes / 60.0)
    return df.withColumn("energy", energy).withColumn("cumulative_energy", F.sum("energy").over(up_to(keys, time)))


def interval_energy(df: DataFrame, total: str = "cumulative_energy", out: str = "energy", keys: tuple[str, ...] = PLANT, time: str = "time", only_daily: bool = False) -> DataFrame:
    """Energy up to the next row; with ``only_daily`` null unless that is 24 hours later."""
    w = over(keys, time)
    used = F.lead(total).over(w) - F.col(total)
    if only_daily:
        used = F.when(F.lead(micros(time)).over(w) - micros(time) == DAY_MICROS, used)
    return df.withColumn(out, used)


def align_energy(df: DataFrame, energy: str = "energy", keys: tuple[str, ...] = PLANT) -> DataFrame:
    """The previous row's energy, which is what this row's reward was paid with."""
    return df.withColumn(energy, F.lag(energy).over(over(keys)))


def photoperiod_energy(df: DataFrame, keys: tuple[str, ...], power: str = "power", hours: float = 12.0) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(power) * hours).alias("energy"))


# -- windows over trajectories

def step_number(df: DataFrame, keys: tuple[str, ...] = PLANT) -> DataFrame:
    return df.withColumn("step", F.row_number().over(over(keys)).cast("long"))


def cumulative(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = PLANT) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(up_to(keys)))


def until_truncation(df: DataFrame, flag: str = "truncated", keys: tuple[str, ...] = PLANT) -> DataFrame:
    """Rows up to and including the first flagged one."""
    return df.withColumn("_t", F.max(F.coalesce(flag, F.lit(False))).over(before(keys))).where(~F.coalesce("_t", F.lit(False))).drop("_t")


def segments(df: DataFrame, keys: tuple[str, ...] = PLANT, time: str = "time", gap: int = DAY_MICROS) -> DataFrame:
    """``segment`` counts the breaks of more than ``gap`` microseconds so far."""
    w = over(keys, time)
    new = F.coalesce((micros(time) - F.lag(micros(time)).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(up_to(keys, time))).drop("_new")


def pairs_with_next(df: DataFrame, value: str = "clean_area", keys: tuple[str, ...] = PLANT) -> DataFrame:
    """Rows with ``next_value``, both positive."""
    return df.withColumn("next_value", F.lead(value).over(over(keys))).where((F.col(value) > 0) & (F.col("next_value") > 0))


def first_normalised(df: DataFrame, value: str = "clean_area", keys: tuple[str, ...] = PLANT) -> DataFrame:
    """Each value over the trajectory's first."""
    return df.withColumn(f"{value}_normalised", F.try_divide(F.col(value), F.first(value).over(up_to(keys))))


def pareto_frontier(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Rows whose ``y`` is above that of all rows of smaller ``x`` (ties on x: larger y, then smaller ``tie``, first).

    Meant for aggregated rows. Ranges of ``x`` are scanned apart and meet in their
    maxima only: a row is compared with its range so far and the ranges before.
    """
    ordered = in_ranges(df.where(F.col(x).isNotNull()), x).withColumnRenamed("_part", "_r")
    w = Window.partitionBy("_r").orderBy(F.col(x), F.desc(y), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    tops = ordered.groupBy("_r").agg(F.max(y).alias("_top"))
    earlier = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).select("_r", "_before")
    scanned = ordered.withColumn("_own", F.max(y).over(w)).join(earlier, "_r")
    best = F.greatest("_own", "_before")
    return scanned.where(best.isNull() | (F.col(y) > best)).drop("_r", "_own", "_before")


# -- episodes

def build_transitions(df: DataFrame, carry: tuple[str, ...] = ("clean_area",), keys: tuple[str, ...] = PLANT, time: str = "time") -> DataFrame:
    """A row for each step from a row to the next within an episode.

    The reward is the next row's (null: 0). Rows after a trajectory's first terminal
    row are left out; a truncated step ends an episode and the next row begins a
    new one; a last step that is not terminal is truncated. Null flags are false.
    """
    w = over(keys, time)
    flags = df.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in ("terminal", "truncated")})
    seen = flags.withColumns(
        {
            "_next": F.lead(time).over(w),
            "_next2": F.lead(time, 2).over(w),
            "_done": F.coalesce(F.max(F.col("terminal").cast("int")).over(before(keys, time)), F.lit(0)),
            "episode": F.coalesce(F.sum(F.col("truncated").cast("long")).over(before(keys, time)), F.lit(0)),
            "step_reward": F.coalesce(F.lead("reward").over(w), F.lit(0.0)),
            **{f"next_{c}": F.lead(c).over(w) for c in carry},
        }
    )
    kept = seen.where(F.col("_next").isNotNull() & (F.col("_done") == 0))
    last = F.col("_next2").isNull() & ~F.col("terminal")
    return kept.withColumn("truncated", F.col("truncated") | last).drop("_next", "_next2", "_done").withColumn("step", F.row_number().over(over((*keys, "episode"), time)).cast("long") - 1)


def episode_returns(transitions: DataFrame, keys: tuple[str, ...] = PLANT) -> DataFrame:
    return transitions.groupBy(*keys, "episode").agg(F.sum("step_reward").alias("episode_return"), F.count("*").alias("n_steps"), F.max("terminal").alias("is_terminal"))


def episodes_at_percentiles(returns: DataFrame, percentiles: tuple[int, ...] = (10, 50, 90), keys: tuple[str, ...] = PLANT) -> DataFrame:
    """The terminal episodes whose return has rank round(p/100 * (n-1)), halves to even.

    Returns are ranked in ranges, so that no task holds all episodes.
    """
    ended = returns.where("is_terminal")
    ranked = global_rank(ended, "episode_return", (*keys, "episode")).crossJoin(F.broadcast(ended.agg(F.count("*").alias("_n"))))
    sought = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("percentile"), F.bround(F.lit(p / 100.0) * (F.col("_n") - 1), 0).cast("long").alias("at")) for p in percentiles]))
    return ranked.withColumn("_p", sought).where("_k = _p.at").select(F.col("_p.percentile").alias("percentile"), *keys, "episode", "episode_return")


def spaced_steps(transitions: DataFrame, steps: int = 5, keys: tuple[str, ...] = PLANT) -> DataFrame:
    """``steps`` evenly spaced steps of each episode: floor(k (n-1) / (steps-1))."""
    n = F.count("*").over(whole((*keys, "episode")))
    places = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.floor(k * (n - 1) / (steps - 1)))
    return transitions.withColumn("_at", places).where(F.array_contains("_at", F.col("step"))).drop("_at")


def first_event(df: DataFrame, flag: str, time: str = "wall_time", keys: tuple[str, ...] = PLANT) -> DataFrame:
    """Each plant's first time with the flag; null (censored) if it never comes."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(flag), F.col(time))).alias("event_time"), F.max(time).alias("last_time"))


def lagged_return(df: DataFrame, keys: tuple[str, ...] = PLANT, reward: str = "reward", done: str = "terminal") -> DataFrame:
    """Return of each plant from rewards moved one row on, rows after the end left out."""
    moved = df.withColumn("_r", F.lag(reward).over(over(keys)))
    return moved.where(~F.coalesce(done, F.lit(False))).groupBy(*keys).agg(F.coalesce(F.sum("_r"), F.lit(0.0)).alias("total"))
