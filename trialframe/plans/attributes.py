"""Queries on attributes and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import attributes as ops
from trialframe.operators.common import PLANT, ZONE, text
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, daily, r6, s6, table

KEY = "experiment, zone, plant_id, CAST(time AS VARCHAR) AS time"
_AGENT_CASE = "CASE " + " ".join(f"WHEN experiment = {e}" + (f" AND zone = {z}" if z is not None else "") + f" THEN '{a}'" for e, zones in ops.AGENTS.items() for z, a in sorted(zones.items(), key=lambda x: x[0] is None)) + " ELSE 'Other' END"
_E18 = ops.AGENTS[18]
_POLICY_CASE = "CASE zone " + " ".join(f"WHEN {z} THEN '{a}'" for z, a in _E18.items()) + " ELSE 'Other' END"
WATER = "watering AS (SELECT DISTINCT experiment, CAST(time AS DATE) AS watering_date, CAST((day % 5 + 1) AS DOUBLE) / 18 AS liters FROM daily WHERE day % 6 = 2)"


@query(f"WITH {DAILY} SELECT {KEY}, {_AGENT_CASE} AS agent FROM daily")
def agent_mapping(spark, sf_dir):
    return ops.map_agents(daily(spark, sf_dir), ops.agent_table(spark)).select(*PLANT, text("time"), "agent")


@query(f"WITH {DAILY} SELECT {KEY}, {_POLICY_CASE} AS policy FROM daily")
def policy_map(spark, sf_dir):
    return daily(spark, sf_dir).select(*PLANT, text("time"), ops.map_values("zone", _E18, "Other").alias("policy"))


@query(f"""WITH {DAILY} SELECT {KEY}, CAST(date_diff('day', CAST('2023-12-20' AS DATE) + CAST(experiment AS INT), CAST(time AS DATE)) AS BIGINT) AS days_since_plate, CAST(NULL AS BIGINT) AS days_since_dome FROM daily""")
def days_since_event(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("plate_date", F.date_add(F.lit("2023-12-20").cast("date"), F.col("experiment").cast("int")))
    d = ops.days_since(d, {"days_since_plate": "plate_date", "days_since_dome": "dome_date"})
    return d.select(*PLANT, text("time"), F.col("days_since_plate").cast("long").alias("days_since_plate"), "days_since_dome")


@query(f"""WITH {DAILY} SELECT {KEY}, CAST(CAST('2024-01-05' AS DATE) + CAST(experiment % 3 AS INT) AS VARCHAR) AS transplant_date, 18 + experiment % 2 AS n_pots, clean_area AS area FROM daily""")
def attach_calendar(spark, sf_dir):
    from trialframe.operators.clean import drop_prefixed
    from trialframe.operators.trajectory import log_area

    d = daily(spark, sf_dir).withColumnRenamed("clean_area", "area")
    calendar = d.select("experiment").distinct().select("experiment", F.date_add(F.lit("2024-01-05").cast("date"), (F.col("experiment") % 3).cast("int")).alias("transplant_date"), (18 + F.col("experiment") % 2).alias("n_pots"))
    joined = log_area(ops.attach_calendar(drop_prefixed(d, "action_"), calendar))
    return joined.select(*PLANT, text("time"), text("transplant_date"), "n_pots", F.col("clean_area").alias("area"))


@query(f"""WITH {DAILY}, {WATER} SELECT d.experiment, d.zone, d.plant_id, CAST(d.time AS VARCHAR) AS time, CAST(date_diff('day', w.watering_date, CAST(d.time AS DATE)) AS BIGINT) AS days_since_watering, {s6('w.liters')} AS liters
FROM daily d ASOF LEFT JOIN watering w ON d.experiment = w.experiment AND CAST(d.time AS DATE) >= w.watering_date""")
def asof_watering(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("_date", F.to_date("time"))
    water = d.where("day % 6 = 2").select("experiment", F.col("_date").alias("watering_date"), ((F.col("day") % 5 + 1).cast("double") / 18).alias("liters")).distinct()
    found = ops.asof_calendar(d, water, ("experiment",), "_date", "watering_date", ("liters",))
    return found.select(*PLANT, text("time"), F.datediff("_date", "watering_date_asof").cast("long").alias("days_since_watering"), r6("liters").alias("liters"))


_SIDES = "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS other, user_id, ts AS at FROM events WHERE event_type = 'signup')"


@query(f"""WITH {_SIDES} SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.at) <= 864000000000 THEN r.other END AS other FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at""")
def asof_tolerance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("other"))
    return ops.asof_join(left, right, ("user_id",), "ts", "at", ("other",), tolerance_micros=10 * 86_400_000_000).select("event_id", "other")


@query(f"""WITH {DAILY}, t AS (SELECT unnest([0, 7, 14, 21]) AS target), n AS (SELECT d.*, t.target, row_number() OVER (PARTITION BY experiment, zone, target ORDER BY abs(day - target), plant_id, day) AS k FROM daily d CROSS JOIN t)
SELECT experiment, zone, CAST(target AS BIGINT) AS target, plant_id, clean_area FROM n WHERE k = 1""")
def nearest_match(spark, sf_dir):
    d = daily(spark, sf_dir).select(*ZONE, "plant_id", "day", "clean_area").withColumn("tie", F.struct("plant_id", "day"))
    targets = spark.createDataFrame([(x,) for x in (0, 7, 14, 21)], "target long")
    return ops.nearest_rows(d, targets, "day", ZONE, "tie").select(*ZONE, "target", "plant_id", "clean_area")


@query(f"""WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY experiment, zone ORDER BY abs(day - 1), plant_id, time) AS k FROM daily)
SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS reference_time FROM n WHERE k = 1""")
def zone_reference(spark, sf_dir):
    d = daily(spark, sf_dir)
    row = F.min_by(F.struct("plant_id", "time"), F.struct(F.abs(F.col("day") - 1), F.col("plant_id"), F.col("time")))
    return d.groupBy(*ZONE).agg(row.alias("r")).select(*ZONE, "r.plant_id", F.col("r.time").cast("string").alias("reference_time"))


@query(f"WITH {DAILY}, good AS (SELECT experiment, zone FROM daily GROUP BY 1, 2 HAVING count(*) >= 30) SELECT {KEY} FROM daily SEMI JOIN good USING (experiment, zone)")
def semi_keys(spark, sf_dir):
    d = daily(spark, sf_dir)
    good = d.groupBy(*ZONE).count().where("count >= 30")
    return d.join(good, list(ZONE), "left_semi").select(*PLANT, text("time"))


@query(f"WITH {DAILY} SELECT DISTINCT experiment, zone FROM daily")
def distinct_keys_rows(spark, sf_dir):
    return daily(spark, sf_dir).select(*ZONE).distinct()


@query(f"WITH {DAILY}, t AS (SELECT DISTINCT experiment, zone, plant_id FROM daily WHERE bolted_prob > 0.9) SELECT DISTINCT experiment, zone, plant_id FROM daily ANTI JOIN t USING (experiment, zone, plant_id)")
def anti_keys(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.select(*PLANT).distinct().join(d.where("bolted_prob > 0.9").select(*PLANT), list(PLANT), "left_anti")


@query(f"WITH {DAILY} SELECT count(DISTINCT (experiment, zone)) AS n_zones, count(DISTINCT (experiment, zone, plant_id)) AS n_plants, count(DISTINCT (experiment, zone, time)) AS n_times FROM daily")
def distinct_keys(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.agg(F.countDistinct(F.struct(*ZONE)).alias("n_zones"), F.countDistinct(F.struct(*PLANT)).alias("n_plants"), F.countDistinct(F.struct(*ZONE, "time")).alias("n_times"))
