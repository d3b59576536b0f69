"""Queries on episodes, transitions and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import splits, trajectory
from trialframe.operators.common import PLANT, ZONE, text
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, REWARDED, W, daily, r6, rewarded, s6

_UNTIL = "(PARTITION BY experiment, zone, plant_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
EPISODES = f"""{REWARDED}, flagged AS (SELECT *, bolted_prob > 0.4 AND day >= 20 AS terminal, coalesce(epoch_us(lead(time) OVER {W}) - epoch_us(time) <> 86400000000, false) AS truncated FROM rewarded),
looked AS (SELECT *, lead(time) OVER {W} AS n1, lead(time, 2) OVER {W} AS n2, coalesce(max(CAST(terminal AS INT)) OVER {_UNTIL}, 0) AS done,
CAST(coalesce(sum(CAST(truncated AS INT)) OVER {_UNTIL}, 0) AS BIGINT) AS episode, coalesce(lead(reward) OVER {W}, 0) AS step_reward, lead(clean_area) OVER {W} AS next_area FROM flagged),
steps AS (SELECT experiment, zone, plant_id, time, episode, clean_area, next_area, step_reward, terminal, truncated OR (n2 IS NULL AND NOT terminal) AS truncated,
row_number() OVER (PARTITION BY experiment, zone, plant_id, episode ORDER BY time) - 1 AS step FROM looked WHERE n1 IS NOT NULL AND done = 0),
returns AS (SELECT experiment, zone, plant_id, episode, round(sum(step_reward), 6) AS episode_return, count(*) AS n_steps, bool_or(terminal) AS is_terminal FROM steps GROUP BY 1, 2, 3, 4)"""


def steps(spark, sf_dir):
    d = rewarded(spark, sf_dir).withColumn("terminal", (F.col("bolted_prob") > 0.4) & (F.col("day") >= 20))
    return trajectory.build_transitions(trajectory.truncated_daily(d))


def returns(spark, sf_dir):
    return trajectory.episode_returns(steps(spark, sf_dir)).withColumn("episode_return", F.round("episode_return", 6))


@query(f"WITH {EPISODES} SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, episode, step, clean_area, next_area, {s6('step_reward')} AS step_reward, terminal, truncated FROM steps")
def transitions(spark, sf_dir):
    s = steps(spark, sf_dir)
    return s.select(*PLANT, text("time"), "episode", "step", "clean_area", F.col("next_clean_area").alias("next_area"), r6("step_reward").alias("step_reward"), "terminal", "truncated")


@query(f"""WITH {EPISODES}, e AS (SELECT *, row_number() OVER (ORDER BY episode_return, experiment, zone, plant_id, episode) - 1 AS k, count(*) OVER () AS n FROM returns WHERE is_terminal),
p AS (SELECT unnest([10, 50, 90]) AS percentile)
SELECT CAST(percentile AS BIGINT) AS percentile, experiment, zone, plant_id, episode, {s6('episode_return')} AS episode_return FROM e JOIN p ON k = CAST(round_even(percentile / 100.0 * (n - 1), 0) AS BIGINT)""")
def episode_returns(spark, sf_dir):
    e = trajectory.episodes_at_percentiles(returns(spark, sf_dir))
    return e.select("percentile", *PLANT, "episode", r6("episode_return").alias("episode_return"))


@query(f"""WITH {EPISODES}, c AS (SELECT *, count(*) OVER (PARTITION BY experiment, zone, plant_id, episode) AS n FROM steps)
SELECT experiment, zone, plant_id, episode, step FROM c WHERE list_contains(list_transform([0, 1, 2, 3, 4], lambda k: CAST(floor(k * (n - 1) / 4) AS BIGINT)), step)""")
def episode_steps(spark, sf_dir):
    return trajectory.spaced_steps(steps(spark, sf_dir)).select(*PLANT, "episode", "step")


@query(f"""WITH RECURSIVE {DAILY}, g AS (SELECT experiment, zone, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, experiment, zone) AS k FROM daily GROUP BY 1, 2),
deal AS (SELECT CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS load, CAST(-1 AS BIGINT) AS fold
UNION ALL SELECT g.k, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN g.n ELSE 0 END), CAST(list_position(load, list_min(load)) - 1 AS BIGINT) FROM deal JOIN g ON g.k = deal.k + 1)
SELECT experiment, zone, n, fold FROM g JOIN deal USING (k)""")
def group_kfold(spark, sf_dir):
    return splits.group_folds(daily(spark, sf_dir), ZONE)


def _md5(seed: int) -> str:
    return f"md5(concat_ws('|', experiment, zone, plant_id, CAST(time AS VARCHAR), '{seed}'))"


@query(f"WITH {DAILY} SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, clean_area FROM daily ORDER BY {_md5(7)} LIMIT 200")
def hash_sample(spark, sf_dir):
    return splits.hash_sample(daily(spark, sf_dir), (*PLANT, "time"), 200, 7).select(*PLANT, text("time"), "clean_area")


@query(f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY zone = 11 ORDER BY {_md5(7)}) AS k, count(*) FILTER (zone = 11) OVER () AS wanted FROM daily)
SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, clean_area FROM r WHERE zone = 11 OR k <= greatest(500 - wanted, 0)""")
def target_sample(spark, sf_dir):
    d = daily(spark, sf_dir)
    return splits.target_sample(d, F.col("zone") == 11, (*PLANT, "time"), 500, 7).select(*PLANT, text("time"), "clean_area")


@query(f"WITH {DAILY} SELECT experiment, zone, plant_id, count(*) AS n_frames, string_agg(strftime(time, '%Y%m%d'), ',' ORDER BY time) AS names FROM daily WHERE bolted_prob > 0.2 GROUP BY 1, 2, 3")
def frames_per_plant(spark, sf_dir):
    d = daily(spark, sf_dir)
    there = d.where("bolted_prob > 0.2").select(*PLANT, "time")
    named = d.join(there, [*PLANT, "time"], "left_semi").groupBy(*PLANT).agg(F.array_sort(F.collect_list(F.date_format("time", "yyyyMMdd"))).alias("names"))
    return named.select(*PLANT, F.size("names").cast("long").alias("n_frames"), F.array_join("names", ",").alias("names"))
