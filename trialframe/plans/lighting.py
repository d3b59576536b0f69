"""Queries on light and energy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trialframe.operators import light, trajectory
from trialframe.operators.common import CHANNELS, COEFFICIENTS, PLANT, ZONE, text
from trialframe.plans.registry import query
from trialframe.plans.views import CALIBRATION, DAILY, W, calibration, daily, r6, s6, table

KEY = "experiment, zone, plant_id, CAST(time AS VARCHAR) AS time"
_P = np.linalg.pinv(np.column_stack(list(light.BASIS.values())))
_RAW = [" + ".join(f"{c} * CAST({float(w)!r} AS DOUBLE)" for c, w in zip(CHANNELS, row)) for row in _P]
COEF = f"""clipped AS (SELECT *, {", ".join(f"greatest(0.0, least(1.0, {x})) AS c{i}" for i, x in enumerate(_RAW))} FROM daily),
mixed AS (SELECT *, {", ".join(f"CASE WHEN c0 + c1 + c2 > 0 THEN c{i} / (c0 + c1 + c2) ELSE c{i} END AS {n}" for i, n in enumerate(COEFFICIENTS))} FROM clipped)"""
ENERGY = f"{DAILY}, cumulated AS (SELECT *, sum(action_0) OVER {W} AS cumulative_energy FROM daily)"


def mixed(spark, sf_dir):
    return light.action_coefficients(daily(spark, sf_dir))


def cumulated(spark, sf_dir):
    return trajectory.cumulative(daily(spark, sf_dir), "action_0", "cumulative_energy")


@query(f"WITH {DAILY}, {COEF} SELECT {KEY}, {', '.join(f'{s6(c)} AS {c}' for c in COEFFICIENTS)} FROM mixed")
def action_coefficients(spark, sf_dir):
    return mixed(spark, sf_dir).select(*PLANT, text("time"), *[r6(c).alias(c) for c in COEFFICIENTS])


_L1 = {n.removesuffix("_coef"): " + ".join(f"abs({c} - {float(x)!r})" for c, x in zip(CHANNELS, v)) for n, v in light.BASIS.items()}


@query(f"WITH {DAILY} SELECT {KEY}, {', '.join(f'{s6(x)} AS {n}_l1' for n, x in _L1.items())} FROM daily")
def l1_to_basis(spark, sf_dir):
    return light.l1_to_basis(daily(spark, sf_dir)).select(*PLANT, text("time"), *[r6(f"{n}_l1").alias(f"{n}_l1") for n in _L1])


@query(f"WITH {DAILY}, {COEF} SELECT {KEY}, {', '.join(f'{s6(f'avg({c}) OVER (PARTITION BY experiment, zone, day)')} AS {c}' for c in COEFFICIENTS)} FROM mixed")
def daily_mean_coef(spark, sf_dir):
    from trialframe.operators.clean import group_mean

    return group_mean(mixed(spark, sf_dir), COEFFICIENTS, (*ZONE, "day")).select(*PLANT, text("time"), *[r6(c).alias(c) for c in COEFFICIENTS])


@query(f"WITH {DAILY} SELECT {KEY}, {s6('(action_0 + action_1 + action_2 + action_3 + action_4 + action_5) / 100')} AS intensity FROM daily WHERE action_0 + action_1 + action_2 + action_3 + action_4 + action_5 > 0")
def intensity(spark, sf_dir):
    return light.intensity(daily(spark, sf_dir)).select(*PLANT, text("time"), r6("intensity").alias("intensity"))


@query(f"WITH {DAILY} SELECT experiment, zone, CAST(CAST(time AS DATE) AS VARCHAR) AS date, {s6('avg((action_0 + action_1 + action_2 + action_3 + action_4 + action_5) / 100)')} AS intensity FROM daily WHERE action_0 + action_1 + action_2 + action_3 + action_4 + action_5 > 0 GROUP BY ALL")
def intensity_by_date(spark, sf_dir):
    return light.intensity(daily(spark, sf_dir)).groupBy(*ZONE, F.to_date("time").cast("string").alias("date")).agg(r6(F.avg("intensity")).alias("intensity"))


@query(f"WITH {DAILY}, e AS (SELECT *, lead(action_0) OVER {W} * (5.0 / 60) AS energy FROM daily) SELECT {KEY}, {s6('energy')} AS energy, {s6(f'sum(energy) OVER {W}')} AS cumulative_energy FROM e")
def step_energy(spark, sf_dir):
    d = trajectory.step_energy(daily(spark, sf_dir), PLANT, "action_0")
    return d.select(*PLANT, text("time"), r6("energy").alias("energy"), r6("cumulative_energy").alias("cumulative_energy"))


_USED = f"lead(cumulative_energy) OVER {W} - cumulative_energy"


@query(f"WITH {ENERGY} SELECT {KEY}, {s6(_USED)} AS energy, {s6(f'CASE WHEN epoch_us(lead(time) OVER {W}) - epoch_us(time) = 86400000000 THEN {_USED} END')} AS daily_energy FROM cumulated")
def interval_energy(spark, sf_dir):
    d = trajectory.interval_energy(cumulated(spark, sf_dir))
    d = trajectory.interval_energy(d, out="daily_energy", only_daily=True)
    return d.select(*PLANT, text("time"), r6("energy").alias("energy"), r6("daily_energy").alias("daily_energy"))


@query(f"WITH {ENERGY}, e AS (SELECT *, {_USED} AS energy FROM cumulated) SELECT {KEY}, {s6(f'lag(energy) OVER {W}')} AS energy FROM e")
def aligned_energy(spark, sf_dir):
    d = trajectory.align_energy(trajectory.interval_energy(cumulated(spark, sf_dir)))
    return d.select(*PLANT, text("time"), r6("energy").alias("energy"))


@query(f"WITH {DAILY} SELECT experiment, zone, day, {s6('avg(action_1) * 12')} AS energy FROM daily GROUP BY 1, 2, 3")
def photoperiod_energy(spark, sf_dir):
    return trajectory.photoperiod_energy(daily(spark, sf_dir), (*ZONE, "day"), "action_1").select(*ZONE, "day", r6("energy").alias("energy"))


@query(f"WITH {DAILY}, m AS (SELECT experiment, zone, day, median(action_1) AS e FROM daily GROUP BY 1, 2, 3) SELECT experiment, zone, {s6('sum(e)')} AS energy FROM m GROUP BY 1, 2")
def zone_energy_median(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy(*ZONE, "day").agg(F.median("action_1").alias("e"))
    return m.groupBy(*ZONE).agg(r6(F.sum("e")).alias("energy"))


@query(f"WITH {ENERGY}, d AS (SELECT experiment, zone, time, max(cumulative_energy) AS c FROM cumulated GROUP BY 1, 2, 3) SELECT experiment, zone, {s6('max(c)')} AS energy, count(*) AS n_times FROM d GROUP BY 1, 2")
def zone_energy_max(spark, sf_dir):
    points = cumulated(spark, sf_dir).groupBy(*ZONE, "time").agg(F.max("cumulative_energy").alias("c"))
    return points.groupBy(*ZONE).agg(r6(F.max("c")).alias("energy"), F.count("*").alias("n_times"))


#: A zone's mean settings at each time, null on every fifth day, and their traces.
TRACE_POINTS = f"""{DAILY}, {COEF}, points AS (SELECT experiment, zone, time, {', '.join(f'CASE WHEN any_value(day) % 5 <> 4 THEN avg({c}) END AS {c}' for c in light.TRACED)} FROM mixed GROUP BY 1, 2, 3)"""


def trace_sql(column: str, beta: float) -> str:
    walked = f"list_reduce(list_transform(list({column}) OVER w, lambda v: {{'n': CAST(coalesce(v, 0) AS DOUBLE), 'd': CAST(CASE WHEN v IS NULL THEN 0 ELSE 1 END AS DOUBLE)}}), lambda a, b: {{'n': a.n * CAST({beta} AS DOUBLE) + b.n, 'd': a.d * CAST({beta} AS DOUBLE) + b.d}})"
    return f"(CASE WHEN lag({column}) OVER (PARTITION BY experiment, zone ORDER BY time) IS NULL THEN 0.0 ELSE {walked}['n'] / {walked}['d'] END)"


def trace_points(spark, sf_dir):
    return mixed(spark, sf_dir).groupBy(*ZONE, "time").agg(*[F.when(F.first("day") % 5 != 4, F.avg(c)).alias(c) for c in light.TRACED])


@query(f"""WITH {TRACE_POINTS} SELECT experiment, zone, CAST(time AS VARCHAR) AS time, {', '.join(f'{s6(trace_sql(c, b))} AS t_{c}_{int(10 * b)}' for c, b in light.trace_names(light.TRACED).values())}
FROM points WINDOW w AS (PARTITION BY experiment, zone ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def action_trace(spark, sf_dir):
    traced = light.action_traces(trace_points(spark, sf_dir))
    return traced.select(*ZONE, text("time"), *[r6(F.col(f"`{n}`")).alias(f"t_{c}_{int(10 * b)}") for n, (c, b) in light.trace_names(light.TRACED).items()])


ZONE_COEF = f"""{DAILY}, {COEF}, zpoints AS (SELECT experiment, zone, time, {', '.join(f'avg({c}) AS {c}' for c in COEFFICIENTS)} FROM mixed GROUP BY 1, 2, 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY experiment, zone ORDER BY time) AS k FROM zpoints),
steps AS (SELECT experiment, zone, {', '.join(f'avg({c}) AS {c}' for c in COEFFICIENTS)}, count(*) AS n_steps FROM firsts WHERE k <= 13 GROUP BY 1, 2)"""


def zone_points(spark, sf_dir):
    return mixed(spark, sf_dir).groupBy(*ZONE, "time").agg(*[F.avg(c).alias(c) for c in COEFFICIENTS])


@query(f"WITH {ZONE_COEF} SELECT experiment, zone, {', '.join(f'{s6(c)} AS {c}' for c in COEFFICIENTS)}, n_steps FROM steps")
def coef_by_step(spark, sf_dir):
    return light.step_coefficients(zone_points(spark, sf_dir)).select(*ZONE, *[r6(c).alias(c) for c in COEFFICIENTS], "n_steps")


@query(f"WITH {ZONE_COEF}, {CALIBRATION} SELECT experiment, zone, {s6('red_coef * R + white_coef * W + blue_coef * B')} AS dose FROM steps LEFT JOIN calibration USING (zone)")
def weighted_dose(spark, sf_dir):
    steps = light.step_coefficients(zone_points(spark, sf_dir))
    return light.weighted_dose(steps, light.pivot_calibration(calibration(spark))).select(*ZONE, r6("dose").alias("dose"))


SPECTRA = "spectra AS (SELECT l_linenumber AS zone, CAST(l_partkey % 40 AS BIGINT) * 10 + 380 AS wavelength, avg(l_discount) AS red, avg(l_tax) AS white, avg(l_quantity) - 25.5 AS blue FROM lineitem GROUP BY 1, 2)"


def spectra(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("zone"), ((F.col("l_partkey") % 40).cast("long") * 10 + 380).alias("wavelength")).agg(F.avg("l_discount").alias("red"), F.avg("l_tax").alias("white"), (F.avg("l_quantity") - 25.5).alias("blue"))


_WEIGHTED = f"{ZONE_COEF}, {SPECTRA}, weighted AS (SELECT experiment, s.zone, wavelength, greatest(0.0, red_coef * red + white_coef * white + blue_coef * blue) AS intensity FROM steps s JOIN spectra USING (zone))"


def spectrum(spark, sf_dir):
    return light.weighted_spectrum(light.step_coefficients(zone_points(spark, sf_dir)), spectra(spark, sf_dir), ZONE)


@query(f"WITH {_WEIGHTED} SELECT experiment, zone, wavelength, {s6('intensity')} AS intensity FROM weighted")
def weighted_spectrum(spark, sf_dir):
    return spectrum(spark, sf_dir).select(*ZONE, "wavelength", r6("intensity").alias("intensity"))


@query(f"""WITH {_WEIGHTED}, days AS (SELECT w.*, d AS day, intensity * (1 + d / 10.0) AS lit FROM weighted w, range(0, 4) t(d) WHERE d <= 1 + zone % 3),
last AS (SELECT experiment, min(m) AS m FROM (SELECT experiment, zone, max(day) AS m FROM days GROUP BY 1, 2) GROUP BY 1)
SELECT experiment, zone, day, wavelength, {s6('lit - avg(lit) OVER (PARTITION BY experiment, day, wavelength)')} AS difference FROM days JOIN last USING (experiment) WHERE day <= m""")
def spectrum_diff(spark, sf_dir):
    s = spectrum(spark, sf_dir).withColumn("day", F.explode(F.sequence(F.lit(0), (1 + F.col("zone") % 3).cast("int")))).withColumn("agent", F.col("experiment"))
    s = s.withColumn("intensity", F.col("intensity") * (1 + F.col("day") / 10))
    return light.spectrum_difference(s).select(*ZONE, F.col("day").cast("long").alias("day"), "wavelength", r6("difference").alias("difference"))


@query(f"WITH {DAILY}, {CALIBRATION}, t AS (SELECT experiment, zone, avg(clean_area) AS m FROM daily GROUP BY 1, 2) SELECT experiment, zone, {s6('m')} AS mean_area, R AS dose FROM t JOIN calibration USING (zone)")
def zone_dose(spark, sf_dir):
    dose = light.pivot_calibration(calibration(spark)).select("zone", F.col("R").alias("dose"))
    joined = daily(spark, sf_dir).join(F.broadcast(dose), "zone")
    return joined.groupBy(*ZONE).agg(r6(F.avg("clean_area")).alias("mean_area"), F.first("dose").alias("dose"))
