"""Energy rewards against a baseline zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.operators.clean import drop_gap_anchors
from trialframe.operators.light import TRACED, action_traces
from trialframe.operators.quality import nearest_rank_outliers
from trialframe.operators.trajectory import align_energy, daily_reward, interval_energy, log_area, truncated_daily

BETAS = (0.5, 1.0, 2.0, 4.0, 8.0)


def baselines(df: DataFrame, zone: int = 11, energy: str = "energy", reward: str = "reward") -> DataFrame:
    """One row: the zone's mean energy and reward (all rows' if it has no energy), and the largest energy of all."""
    own = F.col("zone") == zone
    one = df.agg(
        F.avg(F.when(own, F.col(energy))).alias("_e"),
        F.avg(F.when(own, F.col(reward))).alias("_r"),
        F.avg(energy).alias("_ea"),
        F.avg(reward).alias("_ra"),
        F.max(energy).alias("max_energy"),
    )
    some = F.col("_e").isNotNull()
    return one.select(F.when(some, F.col("_e")).otherwise(F.col("_ea")).alias("e_const"), F.when(some, F.col("_r")).otherwise(F.col("_ra")).alias("r_const"), "max_energy")


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A one-row table's columns on every row, without bringing them to the driver."""
    return df.crossJoin(F.broadcast(one_row))


def schema_a(df: DataFrame, betas: tuple[float, ...] = BETAS, steps: int = 14, energy: str = "energy") -> DataFrame:
    """beta/steps * (ln energy - ln e_const) for each beta; null without positive energy."""
    gap = F.when(F.col(energy) > 0, F.ln(F.when(F.col(energy) > 0, F.col(energy))) - F.ln("e_const"))
    return df.withColumns({f"schema_a_{b:g}".replace(".", "_"): gap * (b / steps) for b in betas})


def schema_b(df: DataFrame, gate: float = 0.95, penalty: float = 2.0, reward: str = "area_reward", energy: str = "energy") -> DataFrame:
    """The energy where the reward passes the gate, else the penalty; null without a reward."""
    paid = F.when(F.col(reward) >= gate * F.col("r_const"), F.col(energy)).otherwise(penalty * F.col("max_energy"))
    return df.withColumn("schema_b", F.when(F.col(reward).isNotNull(), paid))


def combined_reward(df: DataFrame, reward: str = "area_reward", energy_reward: str = "schema_a_1") -> DataFrame:
    return df.withColumn("reward", F.col(reward) - F.col(energy_reward))


def daily_recompute(df: DataFrame, traces: tuple[str, ...] | None = None) -> DataFrame:
    """Everything that depends on the daily grid: energy, gaps, areas, rewards, traces, outliers, truncation, in this order.

    ``traces`` are the columns to trace: all of ``light.TRACED`` that the table has, if not given.
    """
    if traces is None:
        traces = tuple(c for c in TRACED if c in df.columns)
    if "cumulative_energy" in df.columns:
        df = interval_energy(df, only_daily=True)
    df = log_area(drop_gap_anchors(df))
    df = daily_reward(df)
    if traces:
        df = action_traces(df, traces)
    return truncated_daily(nearest_rank_outliers(df))


def energy_rewards(df: DataFrame, zone: int = 11) -> DataFrame:
    """All reward columns of a recomputed daily table: ``area_reward``, both schemas, ``reward``."""
    constants = baselines(df, zone)
    df = with_constants(align_energy(df.withColumnRenamed("reward", "area_reward")), constants)
    return combined_reward(schema_b(schema_a(df))).drop("e_const", "r_const", "max_energy")


def schema_summary(plants: DataFrame, policy: str = "agent", value: str = "total", energy: str = "energy", constant: str = "Constant", gate: float = 0.95, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Per policy: trimmed mean return, mean energy, log energy against the constant policy, whether the gate is passed, and both induced returns."""
    from trialframe.operators.quality import trimmed_mean

    summary = trimmed_mean(plants, value, (policy,), low, high).join(plants.groupBy(policy).agg(F.avg(energy).alias("mean_energy")), policy)
    base = summary.where(F.col(policy) == constant).select(F.col("trimmed_mean").alias("_r"), F.col("mean_energy").alias("_e"))
    top = summary.agg(F.max("mean_energy").alias("_m"))
    joined = with_constants(with_constants(summary, base), top)
    joined = joined.withColumn("log_energy_ratio", F.ln(F.col("mean_energy") / F.col("_e"))).withColumn("passes", F.col("trimmed_mean") >= gate * F.col("_r"))
    return joined.withColumn("induced_a", F.col("trimmed_mean") - F.col("log_energy_ratio")).withColumn("induced_b", -F.when(F.col("passes"), F.col("mean_energy")).otherwise(2 * F.col("_m"))).drop("_r", "_e", "_m")
