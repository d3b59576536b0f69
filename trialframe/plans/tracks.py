"""Queries on trajectories: rewards, truncation, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import attributes, clean, quality, trajectory
from trialframe.operators.common import PLANT, ZONE, text, up_to, whole
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, LOGGED, PLANTS, REWARDED, W, WZ, daily, logged, plants, r6, rewarded, s6, table

KEY = "experiment, zone, plant_id, CAST(time AS VARCHAR) AS time"
TRUNC = f"{REWARDED}, truncs AS (SELECT *, coalesce(epoch_us(lead(time) OVER w) - epoch_us(time) <> 86400000000, false) AS truncated FROM rewarded WINDOW w AS {W})"


def key():
    return [*PLANT, text("time")]


@query(f"WITH {PLANTS} SELECT experiment, zone, {s6('avg(total)')} AS mean_return, count(*) AS n_plants FROM plants GROUP BY 1, 2")
def mean_return(spark, sf_dir):
    totals = rewarded(spark, sf_dir).groupBy(*PLANT).agg(F.round(F.coalesce(F.sum("reward"), F.lit(0.0)), 6).alias("total"))
    return totals.groupBy(*ZONE).agg(r6(F.avg("total")).alias("mean_return"), F.count("*").alias("n_plants"))


@query(f"WITH {PLANTS}, z AS (SELECT experiment, zone, avg(total) AS m FROM plants GROUP BY 1, 2) SELECT experiment, {s6('max(m) - min(m)')} AS spread FROM z GROUP BY 1")
def return_spread(spark, sf_dir):
    z = plants(spark, sf_dir).groupBy(*ZONE).agg(F.avg("total").alias("m"))
    return z.groupBy("experiment").agg(r6(F.max("m") - F.min("m")).alias("spread"))


@query(f"""WITH {LOGGED} SELECT {KEY}, {s6("CASE WHEN bolted_prob > 0.5 AND day >= 7 THEN 0 ELSE coalesce(log_clean_area - lag(log_clean_area) OVER w, 0) END")} AS reward
FROM logged WINDOW w AS {W}""")
def step_reward(spark, sf_dir):
    d = logged(spark, sf_dir).withColumn("bolted_pred", (F.col("bolted_prob") > 0.5) & (F.col("day") >= 7))
    return trajectory.step_reward(d).select(*key(), r6("reward").alias("reward"))


@query(f"WITH {REWARDED} SELECT {KEY}, {s6('reward')} AS reward FROM rewarded")
def daily_reward(spark, sf_dir):
    return rewarded(spark, sf_dir).select(*key(), r6("reward").alias("reward"))


@query(f"WITH {TRUNC} SELECT {KEY}, truncated FROM truncs")
def truncated_daily(spark, sf_dir):
    return trajectory.truncated_daily(daily(spark, sf_dir)).select(*key(), "truncated")


@query(f"""WITH {DAILY}, x AS (SELECT *, day >= 80 AS terminal FROM daily)
SELECT {KEY}, (lead(time, 2) OVER w IS NULL AND NOT terminal AND day < 60) OR coalesce(epoch_us(lead(time) OVER w) - epoch_us(time) <> 86400000000, false) AS truncated FROM x WINDOW w AS {W}""")
def truncated_step(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("terminal", F.col("day") >= 80).withColumn("wall_time", F.col("day"))
    return trajectory.truncated_step(d, "daily", last_day=60).select(*key(), "truncated")


_EXPECTED = {"hourly": "3600000000", "4hourly": "CASE WHEN extract(hour FROM time) = 17 THEN 57600000000 ELSE 14400000000 END"}


@query("WITH h AS (SELECT DISTINCT user_id AS plant_id, date_trunc('hour', ts) AS time FROM events), " + ", ".join(f"""t{cadence} AS (SELECT '{cadence}' AS cadence, plant_id, time, (lead(time, 2) OVER w IS NULL AND extract(day FROM time) <> 1) OR coalesce(epoch_us(lead(time) OVER w) - epoch_us(time) <> {apart}, false) AS truncated
FROM h WHERE {"true" if cadence == "hourly" else "extract(hour FROM time) IN (9, 13, 17)"} WINDOW w AS (PARTITION BY plant_id ORDER BY time))""" for cadence, apart in _EXPECTED.items()) + " SELECT cadence, plant_id, CAST(time AS VARCHAR) AS time, truncated FROM (FROM thourly UNION ALL FROM t4hourly)")
def truncated_cadences(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select(F.col("user_id").alias("plant_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time")).distinct()
    hours = hours.withColumns({"terminal": F.dayofmonth("time") == 1, "wall_time": F.lit(0.0)})
    found = [trajectory.truncated_step(hours.where(where), cadence, ("plant_id",)).select(F.lit(cadence).alias("cadence"), "plant_id", text("time"), "truncated") for cadence, where in (("hourly", "true"), ("4hourly", "hour(time) in (9, 13, 17)"))]
    return found[0].unionAll(found[1])


@query(f"WITH {DAILY} SELECT {KEY}, {s6(f'(epoch_us(time) - epoch_us(CAST(CAST(min(time) OVER {WZ} AS DATE) AS TIMESTAMP)) - 34200000000) / 86400000000.0')} AS wall_time FROM daily")
def wall_time(spark, sf_dir):
    return attributes.wall_time(daily(spark, sf_dir)).select(*key(), r6("wall_time").alias("wall_time"))


@query(f"WITH {DAILY} SELECT {KEY}, CAST(date_diff('day', CAST(min(time) OVER {WZ} AS DATE), CAST(time AS DATE)) AS BIGINT) AS day FROM daily")
def day_index(spark, sf_dir):
    return clean.day_index(daily(spark, sf_dir).drop("day")).select(*key(), F.col("day").cast("long").alias("day"))


@query(f"WITH {LOGGED} SELECT {KEY}, {s6('log_clean_area')} AS log_clean_area FROM logged")
def log_area(spark, sf_dir):
    return logged(spark, sf_dir).select(*key(), r6("log_clean_area").alias("log_clean_area"))


@query(f"WITH {DAILY} SELECT {KEY}, {s6('avg(clean_area) OVER (PARTITION BY experiment, zone, time)')} AS mean_clean_area FROM daily")
def mean_area_over_time(spark, sf_dir):
    return trajectory.mean_area(daily(spark, sf_dir)).select(*key(), r6("mean_clean_area").alias("mean_clean_area"))


@query(f"""WITH {DAILY} SELECT {KEY}, bolted_prob > 0.5 AND day >= 7 AS bolted_pred, (bolted_prob > 0.5 AND day >= 7) OR day >= 13 AS terminal FROM daily""")
def terminal(spark, sf_dir):
    return trajectory.terminal(daily(spark, sf_dir), wall="day").select(*key(), "bolted_pred", "terminal")


@query(f"WITH {DAILY} SELECT {KEY}, row_number() OVER {W} AS step FROM daily")
def step_number(spark, sf_dir):
    return trajectory.step_number(daily(spark, sf_dir)).select(*key(), "step")


@query(f"WITH {REWARDED} SELECT {KEY}, {s6(f'sum(reward) OVER {W}')} AS cumulative_reward FROM rewarded")
def cumulative_reward(spark, sf_dir):
    return trajectory.cumulative(rewarded(spark, sf_dir), "reward", "c").select(*key(), r6("c").alias("cumulative_reward"))


@query(f"""WITH {TRUNC}, m AS (SELECT *, coalesce(max(CAST(truncated AS INT)) OVER (PARTITION BY experiment, zone, plant_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM truncs)
SELECT {KEY}, truncated FROM m WHERE t = 0""")
def until_truncation(spark, sf_dir):
    return trajectory.until_truncation(trajectory.truncated_daily(daily(spark, sf_dir))).select(*key(), "truncated")


@query(f"""WITH {DAILY}, f AS (SELECT *, CASE WHEN epoch_us(time) - epoch_us(lag(time) OVER w) > 86400000000 THEN 1 ELSE 0 END AS n FROM daily WINDOW w AS {W})
SELECT {KEY}, CAST(sum(n) OVER {W} AS BIGINT) AS segment FROM f""")
def segments(spark, sf_dir):
    return trajectory.segments(daily(spark, sf_dir)).select(*key(), "segment")


@query(f"""WITH {DAILY}, p AS (SELECT *, lead(clean_area) OVER {W} AS next_value FROM daily)
SELECT {KEY}, clean_area, next_value FROM p WHERE clean_area > 0 AND next_value > 0""")
def transition_pairs(spark, sf_dir):
    return trajectory.pairs_with_next(daily(spark, sf_dir)).select(*key(), "clean_area", "next_value")


@query(f"WITH {DAILY} SELECT {KEY}, {s6(f'clean_area / nullif(first_value(clean_area) OVER {W}, 0)')} AS normalised FROM daily")
def normalized_area(spark, sf_dir):
    return trajectory.first_normalised(daily(spark, sf_dir)).select(*key(), r6("clean_area_normalised").alias("normalised"))


@query(f"""WITH {DAILY}, z AS (SELECT {KEY}, sum(clean_area) OVER (PARTITION BY experiment, zone, plant_id) AS s, first_value(clean_area) OVER {W} AS f, min(day) OVER (PARTITION BY experiment, zone, plant_id) AS m FROM daily)
SELECT experiment, zone, plant_id, time, {s6('s')} AS total_area, f AS first_area, m AS first_day FROM z""")
def whole_partition(spark, sf_dir):
    d = daily(spark, sf_dir)
    d = d.withColumns({"s": F.sum("clean_area").over(whole()), "f": F.first("clean_area").over(up_to()), "m": F.min("day").over(whole())})
    return d.select(*key(), r6("s").alias("total_area"), F.col("f").alias("first_area"), F.col("m").alias("first_day"))


@query(f"""WITH {REWARDED}, m AS (SELECT *, lag(reward) OVER {W} AS r FROM rewarded)
SELECT experiment, zone, plant_id, {s6('coalesce(sum(r), 0)')} AS total_return FROM m WHERE NOT (bolted_prob > 0.5 AND day >= 7) GROUP BY 1, 2, 3""")
def lagged_return(spark, sf_dir):
    d = rewarded(spark, sf_dir).withColumn("terminal", (F.col("bolted_prob") > 0.5) & (F.col("day") >= 7))
    return trajectory.lagged_return(d).select(*PLANT, r6("total").alias("total_return"))


@query(f"WITH {REWARDED} SELECT {KEY}, {s6('exp(reward)')} AS growth FROM rewarded")
def exp_reward(spark, sf_dir):
    return rewarded(spark, sf_dir).select(*key(), r6(F.exp("reward")).alias("growth"))


@query(f"""WITH {DAILY} SELECT {KEY}, {s6('(clean_area - min(clean_area) OVER ()) / (max(clean_area) OVER () - min(clean_area) OVER ())')} AS scaled FROM daily""")
def minmax(spark, sf_dir):
    return quality.minmax_scale(daily(spark, sf_dir), "clean_area", "scaled").select(*key(), r6("scaled").alias("scaled"))


@query(f"WITH {DAILY} SELECT {KEY}, CASE WHEN zone IN (1, 2, 3) THEN 'red' WHEN zone IN (4, 5, 6) THEN 'blue' ELSE 'other' END AS zone_group FROM daily")
def zone_groups(spark, sf_dir):
    group = F.when(F.col("zone").isin(1, 2, 3), "red").when(F.col("zone").isin(4, 5, 6), "blue").otherwise("other")
    return daily(spark, sf_dir).select(*key(), group.alias("zone_group"))


@query(f"WITH {DAILY} SELECT {KEY}, concat('E', experiment, '_Z', zone) AS zone_key, concat_ws('-', experiment, zone) AS pair_key, TRY_CAST(regexp_extract(concat('E', experiment), '(\\d+)', 1) AS BIGINT) AS read_back FROM daily")
def composite_key(spark, sf_dir):
    e, z = F.col("experiment").cast("string"), F.col("zone").cast("string")
    name = F.concat(F.lit("E"), e)
    return daily(spark, sf_dir).select(*key(), F.concat(name, F.lit("_Z"), z).alias("zone_key"), F.concat_ws("-", e, z).alias("pair_key"), F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("read_back"))


@query(f"WITH {DAILY} SELECT {KEY}, clean_area FROM daily WHERE experiment = 12 AND zone = 3 AND day < 14")
def one_zone_rows(spark, sf_dir):
    return daily(spark, sf_dir).where("experiment = 12 AND zone = 3 AND day < 14").select(*key(), "clean_area")


@query(f"WITH {DAILY}, n AS (SELECT *, row_number() OVER {W} AS k FROM daily) SELECT {KEY}, clean_area FROM n WHERE (k - 1) % 12 = 0")
def every_nth(spark, sf_dir):
    from trialframe.operators.splits import every_nth as nth

    return nth(daily(spark, sf_dir), 12, PLANT, ("time",)).select(*key(), "clean_area")


@query(f"WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY experiment, zone ORDER BY clean_area DESC, plant_id, time) AS rank FROM daily) SELECT {KEY}, clean_area, rank FROM n WHERE rank <= 3")
def top_k(spark, sf_dir):
    from trialframe.operators.splits import top_n

    return top_n(daily(spark, sf_dir), 3, ZONE, (F.desc("clean_area"), "plant_id", "time")).select(*key(), "clean_area", "rank")


@query(f"WITH {PLANTS} SELECT experiment, zone, {s6('avg(total)')} AS mean_total, count(*) AS n FROM plants GROUP BY 1, 2 ORDER BY experiment, mean_total DESC, zone")
def ordered_report(spark, sf_dir):
    z = plants(spark, sf_dir).groupBy(*ZONE).agg(r6(F.avg("total")).alias("mean_total"), F.count("*").alias("n"))
    return z.orderBy("experiment", F.desc("mean_total"), "zone")
