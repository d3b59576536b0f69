"""Queries on cleaning and regularising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trialframe.operators import clean
from trialframe.operators.common import PLANT, ZONE, text
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, TELEMETRY, daily, r6, s6, telemetry
from trialframe.sources.tables import image_time

# one row a zone and five-minute mark: the earliest event of the minute
MARKS = f"""{TELEMETRY}, minutes AS (SELECT experiment, zone, date_trunc('minute', time) AS time, power, row_number() OVER (PARTITION BY experiment, zone, date_trunc('minute', time) ORDER BY event_id) AS n
FROM telemetry WHERE extract(minute FROM time) % 5 = 0), marks AS (SELECT experiment, zone, time, power FROM minutes WHERE n = 1)"""
HOURS = f"""{TELEMETRY}, tagged AS (SELECT experiment, zone, date_trunc('hour', time) AS time, power, row_number() OVER (PARTITION BY experiment, zone, date_trunc('hour', time) ORDER BY event_id) AS n FROM telemetry),
hours AS (SELECT experiment, zone, time, power FROM tagged WHERE n = 1)"""
GRID = f"""{HOURS}, span AS (SELECT experiment, zone, min(time) AS a, max(time) AS b FROM hours GROUP BY 1, 2),
grid AS (SELECT experiment, zone, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS time FROM span),
filled AS (SELECT g.experiment, g.zone, g.time, h.power FROM grid g LEFT JOIN hours h USING (experiment, zone, time))"""
ZT = "experiment, zone, CAST(time AS VARCHAR) AS time"


def marks(spark, sf_dir):
    t = clean.on_interval(clean.truncate_minute(telemetry(spark, sf_dir)))
    return clean.dedup(t, (*ZONE, "time"), ("event_id",)).select(*ZONE, "time", "power")


def hours(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("time", F.date_trunc("hour", "time"))
    return clean.dedup(t, (*ZONE, "time"), ("event_id",)).select(*ZONE, "time", "power")


def grid(spark, sf_dir):
    return clean.regularize(hours(spark, sf_dir), interval="1 hour")


@query(f"WITH {GRID} SELECT {ZT}, {s6('power')} AS power FROM filled")
def regularize_grid(spark, sf_dir):
    return grid(spark, sf_dir).select(*ZONE, text("time"), r6("power").alias("power"))


@query(f"WITH {MARKS} SELECT {ZT}, {s6('power')} AS power FROM marks")
def dedup_first(spark, sf_dir):
    return marks(spark, sf_dir).select(*ZONE, text("time"), r6("power").alias("power"))


@query(f"WITH {GRID} SELECT {ZT}, {s6('last_value(power IGNORE NULLS) OVER (PARTITION BY experiment, zone ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS power FROM filled")
def forward_fill(spark, sf_dir):
    return clean.forward_fill(grid(spark, sf_dir), ("power",)).select(*ZONE, text("time"), r6("power").alias("power"))


_S = "(extract(hour FROM time) * 3600 + extract(minute FROM time) * 60 + floor(extract(second FROM time)))"


@query(f"WITH {TELEMETRY} SELECT event_id, {_S} BETWEEN 32400 AND 75600 AS closed_day, {_S} >= 34200 AND {_S} < 73800 AS bright_day, {_S} >= 32400 AND {_S} < 75600 AS photoperiod FROM telemetry")
def time_of_day(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    between = clean.time_between
    return t.select("event_id", between("time", (9, 0), (21, 0)).alias("closed_day"), between("time", (9, 30), (20, 30), False).alias("bright_day"), between("time", (9, 0), (21, 0), False).alias("photoperiod"))


@query(f"WITH {TELEMETRY} SELECT event_id, CAST(time AS VARCHAR) AS time FROM telemetry WHERE extract(minute FROM time) = 30 AND extract(hour FROM time) IN (9, 13, 17)")
def subsample_cadence(spark, sf_dir):
    return clean.subsample(telemetry(spark, sf_dir), "4hourly").select("event_id", text("time"))


_HOURS = "extract(hour FROM time) IN (9, 13, 17)"
_CADENCES = {
    "daily": "extract(minute FROM time) = 30 AND extract(hour FROM time) = 9",
    "daily_start": "extract(minute FROM time) = 0 AND extract(hour FROM time) = 9",
    "hourly": "extract(minute FROM time) = 30",
    "4hourly": f"extract(minute FROM time) = 30 AND {_HOURS}",
    "4hourly_full": f"extract(minute FROM time) = 0 AND {_HOURS}",
}


@query(f"WITH {TELEMETRY}, t AS (SELECT event_id, date_trunc('minute', time) AS time FROM telemetry) {' UNION ALL '.join(f'SELECT {chr(39)}{name}{chr(39)} AS cadence, event_id FROM t WHERE {where}' for name, where in _CADENCES.items())}")
def all_cadences(spark, sf_dir):
    t = clean.truncate_minute(telemetry(spark, sf_dir))
    kept = [clean.subsample(t, name).select(F.lit(name).alias("cadence"), "event_id") for name in clean.CADENCES]
    return reduce(lambda a, b: a.unionAll(b), kept)


@query(f"WITH {GRID} SELECT {ZT}, {s6('lead(power) OVER (PARTITION BY experiment, zone ORDER BY time)')} AS power FROM filled")
def lead_action(spark, sf_dir):
    return clean.lead_columns(grid(spark, sf_dir), ("power",)).select(*ZONE, text("time"), r6("power").alias("power"))


@query(f"WITH {TELEMETRY} SELECT event_id, strftime((time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Edmonton', '%Y-%m-%d %H:%M:%S') AS local_time FROM telemetry")
def local_time(spark, sf_dir):
    return clean.to_local(telemetry(spark, sf_dir)).select("event_id", F.date_format("local_time", "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query(f"WITH {TELEMETRY} SELECT event_id, strftime(make_timestamp(CAST(round_even(epoch_us(time) / 300000000.0, 0) AS BIGINT) * 300000000), '%Y-%m-%d %H:%M:%S') AS mark FROM telemetry")
def round_5min(spark, sf_dir):
    return telemetry(spark, sf_dir).select("event_id", F.date_format(clean.round_interval("time"), "yyyy-MM-dd HH:mm:ss").alias("mark"))


@query(f"""WITH {GRID} SELECT 'power' AS column_name, count(*) AS n_rows, count(*) - count(power) AS n_nulls FROM filled
UNION ALL SELECT 'zone', count(*), count(*) - count(zone) FROM filled""")
def audit_nulls(spark, sf_dir):
    return clean.null_audit(grid(spark, sf_dir), ("power", "zone"))


@query(f"""WITH {DAILY}, p AS (SELECT *, CASE WHEN day % 9 = 4 THEN 50 ELSE 120 END AS brightness, CAST(floor(clean_area / 400) AS BIGINT) AS image_hash FROM daily),
f AS (SELECT *, brightness < 90 OR coalesce(image_hash = lag(image_hash) OVER w AND day <> lag(day) OVER w, false) AS ff FROM p WINDOW w AS (PARTITION BY experiment, zone, plant_id ORDER BY time)),
g AS (SELECT *, max(CAST(ff AS INT)) OVER (PARTITION BY experiment, zone, day) = 1 AS imaging_gap FROM f)
SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, imaging_gap FROM g""")
def imaging_gap(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("brightness", F.when(F.col("day") % 9 == 4, 50).otherwise(120)).withColumn("image_hash", F.floor(F.col("clean_area") / 400).cast("string"))
    return clean.imaging_gaps(clean.mark_repeated_images(d)).select(*PLANT, text("time"), "imaging_gap")


@query(f"""WITH {DAILY} SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, coalesce(zone <= 6 AND day IN (1, 2, 3, 5, 8, 13, 21, 34), false) AS is_good_day FROM daily""")
def good_day(spark, sf_dir):
    d = daily(spark, sf_dir)
    days = d.where("zone <= 6").select(*ZONE).distinct().withColumn("days", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 5, 8, 13, 21, 34)]))
    return clean.good_days(d, days).select(*PLANT, text("time"), "is_good_day")


@query(f"""WITH {DAILY} SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, day FROM daily WHERE (experiment <> 12 OR day < 9) AND extract(hour FROM time) = 9 AND day % 7 <> 3""")
def experiment_cut(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("imaging_gap", F.when(F.col("day") % 7 == 3, True).when(F.col("day") % 7 == 1, False))
    limits = spark.createDataFrame([(12, 9)], "experiment long, limit long")
    kept = clean.cut_experiments(clean.drop_gap_anchors(clean.subsample(d, "daily_start")), limits, "day")
    return kept.select(*PLANT, text("time"), "day")


@query(f"""WITH {GRID}, n AS (SELECT experiment, zone, count(*) AS n_rows, count(power) AS n_filled FROM filled GROUP BY 1, 2) SELECT * FROM n""")
def grid_join(spark, sf_dir):
    return grid(spark, sf_dir).groupBy(*ZONE).agg(F.count("*").alias("n_rows"), F.count("power").alias("n_filled"))


@query(f"""WITH {DAILY}, frames AS (SELECT DISTINCT experiment, zone, time FROM daily), everyone AS (SELECT DISTINCT experiment, zone, plant_id FROM daily),
grid AS (SELECT f.experiment, f.zone, f.time, e.plant_id FROM frames f JOIN everyone e USING (experiment, zone)),
x AS (SELECT g.*, d.clean_area AS a FROM grid g LEFT JOIN daily d USING (experiment, zone, plant_id, time))
SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, last_value(a IGNORE NULLS) OVER (PARTITION BY experiment, zone, plant_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clean_area FROM x""")
def carry_forward(spark, sf_dir):
    d = daily(spark, sf_dir)
    grid = d.select(*ZONE, "time").distinct().join(d.select(*PLANT).distinct(), list(ZONE))
    filled = clean.forward_fill(grid.join(d.select(*PLANT, "time", "clean_area"), [*PLANT, "time"], "left"), ("clean_area",), PLANT, "time")
    return filled.select(*PLANT, text("time"), "clean_area")


@query(f"""WITH {DAILY} SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, {s6("avg(clean_area) OVER (PARTITION BY experiment, zone, day)")} AS mean_area FROM daily""")
def daily_group_mean(spark, sf_dir):
    return clean.group_mean(daily(spark, sf_dir), ("clean_area",), (*ZONE, "day")).select(*PLANT, text("time"), r6("clean_area").alias("mean_area"))


@query(f"""WITH {DAILY}, n AS (SELECT * REPLACE (time - to_hours(CAST(o AS BIGINT)) AS time), concat('cam_', strftime(time, '%Y-%m-%dT%H%M%S'), CASE o WHEN 0 THEN '+0000' WHEN -7 THEN '-0700' ELSE '+0500' END, '_left.png') AS image_name FROM (SELECT *, CASE day % 3 WHEN 0 THEN 0 WHEN 1 THEN -7 ELSE 5 END AS o FROM daily))
SELECT experiment, zone, plant_id, image_name, CAST(time AS VARCHAR) AS time, strftime(time, '%d/%m %H:%M') AS shown,
CAST(date_diff('day', CAST(min(time) OVER (PARTITION BY experiment, zone, plant_id) AS DATE), CAST(time AS DATE)) AS BIGINT) AS day_number FROM n""")
def name_to_day(spark, sf_dir):
    named = daily(spark, sf_dir).select(*PLANT, F.concat(F.lit("cam_"), F.date_format("time", "yyyy-MM-dd'T'HHmmss"), F.when(F.col("day") % 3 == 0, "+0000").when(F.col("day") % 3 == 1, "-0700").otherwise("+0500"), F.lit("_left.png")).alias("image_name"))
    timed = clean.day_index(named.withColumn("time", image_time(F.col("image_name"))), PLANT, out="day_number")
    return timed.select(*PLANT, "image_name", text("time"), F.date_format("time", "dd/MM HH:mm").alias("shown"), F.col("day_number").cast("long").alias("day_number"))
