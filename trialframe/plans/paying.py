"""Queries on energy rewards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from trialframe.operators import light, rewards, trajectory
from trialframe.operators.common import PLANT, ZONE, text
from trialframe.plans.lighting import COEF, trace_sql
from trialframe.plans.registry import query
from trialframe.plans.views import PLANTS, REWARDED, W, logged, plants, r6, s6
from trialframe.operators.quality import trimmed_mean

KEY = "experiment, zone, plant_id, CAST(time AS VARCHAR) AS time"
_USED = f"lead(cumulative_energy) OVER {W} - cumulative_energy"
RECOMPUTED = f"""{REWARDED}, cumulated AS (SELECT *, sum(action_0 + action_1) OVER {W} AS cumulative_energy FROM rewarded),
metered AS (SELECT *, CASE WHEN epoch_us(lead(time) OVER {W}) - epoch_us(time) = 86400000000 THEN round({_USED}, 6) END AS energy,
coalesce(epoch_us(lead(time) OVER {W}) - epoch_us(time) <> 86400000000, false) AS truncated FROM cumulated),
constants AS (SELECT CASE WHEN avg(energy) FILTER (zone = 11) IS NOT NULL THEN avg(energy) FILTER (zone = 11) ELSE avg(energy) END AS e_const,
CASE WHEN avg(energy) FILTER (zone = 11) IS NOT NULL THEN avg(reward) FILTER (zone = 11) ELSE avg(reward) END AS r_const, max(energy) AS max_energy FROM metered),
aligned AS (SELECT m.* EXCLUDE (energy), lag(energy) OVER {W} AS energy, c.* FROM metered m CROSS JOIN constants c)"""
_GAP = "CASE WHEN energy > 0 THEN ln(energy) - ln(e_const) END"
_B = "CASE WHEN reward IS NOT NULL THEN CASE WHEN reward >= 0.95 * r_const THEN energy ELSE 2 * max_energy END END"


def metered(spark, sf_dir):
    d = logged(spark, sf_dir).withColumn("_e", F.col("action_0") + F.col("action_1"))
    d = trajectory.cumulative(d, "_e", "cumulative_energy").drop("_e")
    d = trajectory.interval_energy(d, only_daily=True).withColumn("energy", F.round("energy", 6))
    return trajectory.truncated_daily(trajectory.daily_reward(d))


@query(f"WITH {RECOMPUTED} SELECT {s6('e_const')} AS e_const, {s6('r_const')} AS r_const, {s6('max_energy')} AS max_energy FROM constants")
def baselines(spark, sf_dir):
    return rewards.baselines(metered(spark, sf_dir)).select(*[r6(c).alias(c) for c in ("e_const", "r_const", "max_energy")])


@query(f"WITH {RECOMPUTED} SELECT {KEY}, {', '.join(f'{s6(f'({_GAP}) * {b} / 14')} AS a{i}' for i, b in enumerate(rewards.BETAS))} FROM aligned")
def schema_a(spark, sf_dir):
    d = rewards.energy_rewards(metered(spark, sf_dir))
    return d.select(*PLANT, text("time"), *[r6(f"schema_a_{b:g}".replace(".", "_")).alias(f"a{i}") for i, b in enumerate(rewards.BETAS)])


@query(f"WITH {RECOMPUTED} SELECT {KEY}, {s6(_B)} AS schema_b FROM aligned")
def schema_b(spark, sf_dir):
    return rewards.energy_rewards(metered(spark, sf_dir)).select(*PLANT, text("time"), r6("schema_b").alias("schema_b"))


@query(f"WITH {RECOMPUTED} SELECT {KEY}, {s6('reward')} AS area_reward, {s6(f'reward - ({_GAP}) / 14')} AS reward FROM aligned")
def combined_reward(spark, sf_dir):
    return rewards.energy_rewards(metered(spark, sf_dir)).select(*PLANT, text("time"), r6("area_reward").alias("area_reward"), r6("reward").alias("reward"))


#: Per beta, the sum of the nine traces.
_TRACED = {f"traces_{int(10 * b)}": b for b in light.BETAS}
TRACED = f"""{COEF}, zone_points AS (SELECT experiment, zone, time, {', '.join(f'avg({c}) AS {c}' for c in light.TRACED)} FROM mixed GROUP BY 1, 2, 3),
traced AS (SELECT experiment, zone, time, {', '.join(f"{s6(' + '.join(trace_sql(c, b) for c in light.TRACED))} AS {n}" for n, b in _TRACED.items())}
FROM zone_points WINDOW w AS (PARTITION BY experiment, zone ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {RECOMPUTED}, {TRACED}, n AS (SELECT *, row_number() OVER (ORDER BY reward) - 1 AS k, count(*) OVER () AS n FROM metered WHERE reward IS NOT NULL),
b AS (SELECT max(reward) FILTER (k = CAST(floor(0.01 * (n - 1) + 0.5) AS BIGINT)) AS lo, max(reward) FILTER (k = CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT)) AS hi FROM n)
SELECT m.experiment, m.zone, m.plant_id, CAST(m.time AS VARCHAR) AS time, {s6('energy')} AS energy, {s6('reward')} AS reward, clean_area = 0 AS nodata, coalesce(reward < lo OR reward > hi, false) AS outlier,
NOT (clean_area = 0 OR coalesce(reward < lo OR reward > hi, false)) AS valid, truncated, {', '.join(f't.{n}' for n in _TRACED)}
FROM metered m CROSS JOIN b JOIN traced t ON t.experiment = m.experiment AND t.zone = m.zone AND t.time = m.time""")
def daily_recompute(spark, sf_dir):
    d = logged(spark, sf_dir).drop("log_clean_area").withColumn("_e", F.col("action_0") + F.col("action_1"))
    d = light.action_coefficients(trajectory.cumulative(d, "_e", "cumulative_energy").drop("_e"))
    d = d.withColumns({c: F.avg(c).over(Window.partitionBy(*ZONE, "time")) for c in light.TRACED})  # a zone's plants share its light
    d = rewards.daily_recompute(d)
    traces = light.trace_names(light.TRACED)
    sums = {name: reduce(Column.__add__, [F.col(f"`{n}`") for n, (_, b) in traces.items() if b == beta]) for name, beta in _TRACED.items()}
    return d.select(*PLANT, text("time"), r6("energy").alias("energy"), r6("reward").alias("reward"), "nodata", "outlier", "valid", "truncated", *[r6(x).alias(n) for n, x in sums.items()])


@query(f"""WITH {RECOMPUTED} SELECT experiment, zone, plant_id, {s6('sum(reward)')} AS area, {', '.join(f'{s6(f'sum(reward - ({_GAP}) * {b} / 14)')} AS a{i}' for i, b in enumerate(rewards.BETAS))}, {s6(f'sum(reward - {_B})')} AS b
FROM aligned GROUP BY 1, 2, 3""")
def returns_by_schema(spark, sf_dir):
    d = rewards.energy_rewards(metered(spark, sf_dir))
    sums = [F.sum(F.col("area_reward") - F.col(f"schema_a_{b:g}".replace(".", "_"))) for b in rewards.BETAS]
    return d.groupBy(*PLANT).agg(r6(F.sum("area_reward")).alias("area"), *[r6(x).alias(f"a{i}") for i, x in enumerate(sums)], r6(F.sum(F.col("area_reward") - F.col("schema_b"))).alias("b"))


TRIMMED = f"""{PLANTS}, bounds AS (SELECT agent, quantile_cont(total, 0.025) AS low, quantile_cont(total, 0.975) AS high FROM plants GROUP BY 1),
trimmed AS (SELECT agent, coalesce(avg(total) FILTER (total BETWEEN low AND high), avg(total)) AS trimmed_mean, avg(energy) AS mean_energy FROM plants JOIN bounds USING (agent) GROUP BY 1)"""


@query(f"""WITH {TRIMMED}, c AS (SELECT trimmed_mean AS r, mean_energy AS e FROM trimmed WHERE agent = 'Constant'), m AS (SELECT max(mean_energy) AS m FROM trimmed)
SELECT agent, {s6('trimmed_mean')} AS trimmed_mean, {s6('mean_energy')} AS mean_energy, {s6('ln(mean_energy / e)')} AS log_energy_ratio, trimmed_mean >= 0.95 * r AS passes,
{s6('trimmed_mean - ln(mean_energy / e)')} AS induced_a, {s6('-(CASE WHEN trimmed_mean >= 0.95 * r THEN mean_energy ELSE 2 * m END)')} AS induced_b FROM trimmed, c, m""")
def schema_summary(spark, sf_dir):
    s = rewards.schema_summary(plants(spark, sf_dir))
    return s.select("agent", *[r6(c).alias(c) for c in ("trimmed_mean", "mean_energy", "log_energy_ratio")], "passes", r6("induced_a").alias("induced_a"), r6("induced_b").alias("induced_b"))


@query(f"WITH {PLANTS}, o AS (SELECT *, max(total) OVER (ORDER BY energy, total DESC, plant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM plants) SELECT plant_id, energy, total FROM o WHERE best IS NULL OR total > best")
def pareto(spark, sf_dir):
    return trajectory.pareto_frontier(plants(spark, sf_dir), "energy", "total", "plant_id").select("plant_id", "energy", "total")


@query(f"""WITH {TRIMMED}, x AS (SELECT agent, unnest([0.5, 1.0, 2.0, 4.0, 8.0]) AS beta, round(trimmed_mean, 6) AS t, mean_energy FROM trimmed), s AS (SELECT agent, CAST(beta AS DOUBLE) AS beta, {s6('t - beta * ln(mean_energy / 1000)')} AS score FROM x)
SELECT agent, beta, score, rank() OVER (PARTITION BY beta ORDER BY score DESC) AS rank FROM s""")
def rank_by_beta(spark, sf_dir):
    p = plants(spark, sf_dir)
    s = trimmed_mean(p, "total", ("agent",), 0.025, 0.975).join(p.groupBy("agent").agg(F.avg("energy").alias("mean_energy")), "agent")
    s = s.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in rewards.BETAS]))).withColumn("score", r6(F.round("trimmed_mean", 6) - F.col("beta") * F.ln(F.col("mean_energy") / 1000)))
    return s.select("agent", "beta", "score", F.rank().over(Window.partitionBy("beta").orderBy(F.desc("score"))).cast("long").alias("rank"))


@query(f"WITH {PLANTS}, c AS (SELECT avg(total) AS m, max(total) AS x FROM plants WHERE zone = 11) SELECT experiment, zone, plant_id, {s6('total - m')} AS above_mean, total >= x AS above_all FROM plants CROSS JOIN c")
def baseline_cross(spark, sf_dir):
    p = plants(spark, sf_dir)
    one = p.where("zone = 11").agg(F.avg("total").alias("m"), F.max("total").alias("x"))
    return rewards.with_constants(p, one).select(*PLANT, r6(F.col("total") - F.col("m")).alias("above_mean"), (F.col("total") >= F.col("x")).alias("above_all"))
