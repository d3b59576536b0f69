"""Experiment-shaped views of the generic tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators.common import ZONE
from trialframe.operators.trajectory import daily_reward, log_area

KINDS = ("click", "view", "purchase", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: str | Column) -> Column:
    """Six digits; a little is added first, so that a mean halfway between two goes the same way in any order of summing."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, 6) + F.lit(0.0)


def mean_to(digits: int, column: str) -> Column:
    """The mean of values of at most six digits, rounded half up whatever the order of rows: sums are of decimals, or of doubles where a value is none."""
    x = F.col(column)
    exact = x.try_cast("decimal(20,6)")
    return F.when(F.count(exact) == F.count(x), F.round(F.sum(exact) / F.count(exact), digits).cast("double")).otherwise(F.round(F.avg(x), digits))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user and date of ``events``, as plants of zones of experiments."""
    e = table(spark, sf_dir, "events")
    at = F.to_date("ts")
    rows = e.select(
        (11 + F.col("user_id") % 8).alias("experiment"),
        (1 + F.floor(F.col("user_id") / 8) % 12).alias("zone"),
        F.col("user_id").alias("plant_id"),
        (at.cast("timestamp") + F.expr("INTERVAL 9 HOURS")).alias("time"),
        F.datediff(at, F.lit("2024-01-01").cast("date")).cast("long").alias("day"),
        "event_type",
        "value",
    )
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)), 6).alias(f"action_{i}") for i, k in enumerate(KINDS)]
    grouped = rows.groupBy("experiment", "zone", "plant_id", "time", "day").agg(F.round(F.sum("value"), 6).alias("clean_area"), *sums, F.lit(0.0).alias("action_5"), F.least(F.lit(1.0), F.max("value") / 200).alias("bolted_prob"))
    return grouped


_SUMS = ",\n".join(f"round(coalesce(sum(CASE WHEN event_type = '{k}' THEN value END), 0), 6) AS action_{i}" for i, k in enumerate(KINDS))
DAILY = f"""daily AS (SELECT 11 + user_id % 8 AS experiment, 1 + (user_id // 8) % 12 AS zone, user_id AS plant_id,
CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 9 HOUR AS time,
CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
round(sum(value), 6) AS clean_area, {_SUMS}, CAST(0 AS DOUBLE) AS action_5, least(CAST(1 AS DOUBLE), max(value) / 200) AS bolted_prob
FROM events GROUP BY 1, 2, 3, 4, 5)"""
W = "(PARTITION BY experiment, zone, plant_id ORDER BY time)"
WZ = "(PARTITION BY experiment, zone)"
LOGGED = f"{DAILY}, logged AS (SELECT *, CASE WHEN clean_area > 0 THEN ln(clean_area) END AS log_clean_area FROM daily)"
REWARDED = f"""{LOGGED}, rewarded AS (SELECT *, CASE WHEN epoch_us(time) - epoch_us(lag(time) OVER w) = 86400000000 THEN log_clean_area - lag(log_clean_area) OVER w END AS reward
FROM logged WINDOW w AS {W})"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_area(daily(spark, sf_dir))


def rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_reward(logged(spark, sf_dir))


def s6(x: str) -> str:
    return f"(round(({x}) + CAST(1e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as telemetry: a zone for each event type, its value as power."""
    e = table(spark, sf_dir, "events")
    zone = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).cast("long")
    return e.select(F.lit(1).cast("long").alias("experiment"), zone.alias("zone"), "event_id", "user_id", F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("power"))


TELEMETRY = "telemetry AS (SELECT CAST(1 AS BIGINT) AS experiment, CAST(list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) AS BIGINT) AS zone, event_id, user_id, ts AS time, value AS power FROM events)"


def calibration(spark: SparkSession) -> DataFrame:
    """A dozen zones with a made-up response for each lamp."""
    rows = spark.range(1, 13).select(F.col("id").cast("long").alias("ZONE"))
    colours = F.explode(F.array(*[F.lit(c) for c in "RWB"])).alias("COLOR")
    return rows.select("ZONE", colours).withColumn("PPFD_ELEC", (100 + F.col("ZONE") * 3 + F.when(F.col("COLOR") == "R", 5).when(F.col("COLOR") == "W", 11).otherwise(17)).cast("double"))


CALIBRATION = "calibration AS (SELECT z AS zone, CAST(105 + 3 * z AS DOUBLE) AS R, CAST(111 + 3 * z AS DOUBLE) AS W, CAST(117 + 3 * z AS DOUBLE) AS B FROM range(1, 13) t(z))"
STAGE = ("day", "experiment")
EVENT_BASE = "2024-01-01"


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plant: return, first and last area, energy, policy (one of four by zone)."""
    d = rewarded(spark, sf_dir)
    w = F.struct("time")
    return d.groupBy(*ZONE, "plant_id").agg(
        F.round(F.coalesce(F.sum("reward"), F.lit(0.0)), 6).alias("total"),
        F.min_by("clean_area", w).alias("initial"),
        F.max_by("clean_area", w).alias("final"),
        F.round(F.sum(F.col("action_0") + F.col("action_1")), 6).alias("energy"),
        F.count("*").alias("n_days"),
    ).withColumn("agent", F.element_at(F.array(*[F.lit(a) for a in ("Constant", "Ramp", "Blue", "Late")]), (F.col("zone") % 4 + 1).cast("int")))


PLANTS = f"""{REWARDED}, plants AS (SELECT experiment, zone, plant_id, round(coalesce(sum(reward), 0), 6) AS total,
arg_min(clean_area, time) AS initial, arg_max(clean_area, time) AS final, round(sum(action_0 + action_1), 6) AS energy, count(*) AS n_days,
['Constant', 'Ramp', 'Blue', 'Late'][1 + zone % 4] AS agent FROM rewarded GROUP BY experiment, zone, plant_id)"""
