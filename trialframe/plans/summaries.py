"""Queries on summaries, outliers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.draws import exponential_sql, start_sql
from trialframe.operators import quality, trajectory
from trialframe.operators.common import PLANT, ZONE, text, up_to
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, PLANTS, REWARDED, W, daily, plants, r6, rewarded, s6

KEY = "experiment, zone, plant_id, CAST(time AS VARCHAR) AS time"


@query(f"""WITH {REWARDED}, n AS (SELECT *, row_number() OVER (ORDER BY reward) - 1 AS k, count(*) OVER () AS n FROM rewarded WHERE reward IS NOT NULL),
b AS (SELECT max(reward) FILTER (k = CAST(floor(0.01 * (n - 1) + 0.5) AS BIGINT)) AS lo, max(reward) FILTER (k = CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT)) AS hi FROM n)
SELECT {KEY}, clean_area = 0 AS nodata, coalesce(reward < lo OR reward > hi, false) AS outlier FROM rewarded CROSS JOIN b""")
def outliers_nearest(spark, sf_dir):
    return quality.nearest_rank_outliers(rewarded(spark, sf_dir)).select(*PLANT, text("time"), "nodata", "outlier")


@query(f"""WITH {PLANTS}, q AS (SELECT experiment, quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b, count(total) AS n FROM plants GROUP BY 1)
SELECT experiment, zone, plant_id, total FROM plants JOIN q USING (experiment) WHERE n < 4 OR total BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def iqr_filter(spark, sf_dir):
    return quality.iqr_filter(plants(spark, sf_dir), "total", ("experiment",)).select(*PLANT, "total")


@query(f"""WITH {PLANTS}, b AS (SELECT agent, quantile_cont(total, 0.1) AS low, quantile_cont(total, 0.99) AS high FROM plants GROUP BY 1)
SELECT agent, {s6('coalesce(avg(total) FILTER (total BETWEEN low AND high), avg(total))')} AS trimmed_mean, count(*) FILTER (total BETWEEN low AND high) AS n_inside, count(*) AS n FROM plants JOIN b USING (agent) GROUP BY 1""")
def trimmed_mean(spark, sf_dir):
    return quality.trimmed_mean(plants(spark, sf_dir), "total", ("agent",)).select("agent", r6("trimmed_mean").alias("trimmed_mean"), "n_inside", "n")


@query(f"""WITH {PLANTS}, b AS (SELECT agent, quantile_cont(total, 0.025) AS low, quantile_cont(total, 0.975) AS high FROM plants GROUP BY 1)
SELECT experiment, zone, plant_id, NOT (total BETWEEN low AND high) AS outlier FROM plants JOIN b USING (agent)""")
def policy_outliers(spark, sf_dir):
    return quality.outside_bounds(plants(spark, sf_dir), "total", ("agent",)).select(*PLANT, "outlier")


@query(f"WITH {PLANTS} SELECT agent, {s6('avg(total)')} AS mean, {s6('median(total)')} AS median, count(total) AS n, {s6('stddev_samp(total)')} AS std, min(total) AS min, max(total) AS max FROM plants GROUP BY 1")
def group_summary(spark, sf_dir):
    s = quality.group_summary(plants(spark, sf_dir), "total", ("agent",))
    return s.select("agent", r6("mean").alias("mean"), r6("median").alias("median"), "n", r6("std").alias("std"), "min", "max")


@query(f"WITH {PLANTS} SELECT experiment, zone, plant_id, total, initial, final, {s6('(final - initial) / initial * 100')} AS percent_change, {s6('final - initial')} AS change FROM plants WHERE initial > 0.01")
def episode_metrics(spark, sf_dir):
    p = plants(spark, sf_dir).where("initial > 0.01")
    return p.select(*PLANT, "total", "initial", "final", r6((F.col("final") - F.col("initial")) / F.col("initial") * 100).alias("percent_change"), r6(F.col("final") - F.col("initial")).alias("change"))


@query(f"""WITH {DAILY}, a AS (SELECT experiment, zone, plant_id, arg_min(clean_area, day) AS initial FROM daily WHERE day <= 20 GROUP BY 1, 2, 3), b AS (SELECT experiment, zone, plant_id, arg_max(clean_area, day) AS final FROM daily WHERE day BETWEEN 40 AND 60 GROUP BY 1, 2, 3)
SELECT experiment, zone, plant_id, {s6('final / initial')} AS ratio FROM a JOIN b USING (experiment, zone, plant_id) WHERE initial > 0.01 AND final / initial <= 100""")
def growth_ratio(spark, sf_dir):
    d = daily(spark, sf_dir)
    a = d.where("day <= 20").groupBy(*PLANT).agg(F.min_by("clean_area", "day").alias("initial"))
    b = d.where("day BETWEEN 40 AND 60").groupBy(*PLANT).agg(F.max_by("clean_area", "day").alias("final"))
    joined = a.join(b, list(PLANT)).where("initial > 0.01").withColumn("ratio", F.col("final") / F.col("initial")).where("ratio <= 100")
    return joined.select(*PLANT, r6("ratio").alias("ratio"))


EVENTS = f"{DAILY}, firsts AS (SELECT experiment, zone, plant_id, min(CASE WHEN bolted_prob > 0.95 THEN day END) AS event_time, max(day) AS last_time FROM daily GROUP BY 1, 2, 3)"


def firsts(spark, sf_dir):
    return trajectory.first_event(daily(spark, sf_dir).withColumn("f", F.col("bolted_prob") > 0.95), "f", "day")


@query(f"WITH {EVENTS} SELECT * FROM firsts")
def first_event(spark, sf_dir):
    return firsts(spark, sf_dir)


@query(f"""WITH {PLANTS}, firsts AS (SELECT experiment, zone, plant_id, min(day) AS event_time FROM daily WHERE bolted_prob > 0.95 GROUP BY 1, 2, 3)
SELECT agent, count(*) AS n_plants, count(event_time) AS n_events, count(*) - count(event_time) AS n_censored FROM plants LEFT JOIN firsts USING (experiment, zone, plant_id) GROUP BY 1""")
def censored_join(spark, sf_dir):
    e = daily(spark, sf_dir).where("bolted_prob > 0.95").groupBy(*PLANT).agg(F.min("day").alias("event_time"))
    j = plants(spark, sf_dir).join(e, list(PLANT), "left")
    return j.groupBy("agent").agg(F.count("*").alias("n_plants"), F.count("event_time").alias("n_events"), (F.count("*") - F.count("event_time")).alias("n_censored"))


@query(f"""WITH {REWARDED}, t AS (SELECT day, arg_min(plant_id, (experiment, zone, plant_id)) AS first_plant, avg(clean_area) AS a, avg(reward) AS r FROM rewarded GROUP BY 1)
SELECT day, first_plant, {s6('a')} AS mean_area, {s6('r')} AS mean_reward, {s6('sum(r) OVER (ORDER BY day)')} AS running_reward FROM t""")
def frame_table(spark, sf_dir):
    t = rewarded(spark, sf_dir).groupBy("day").agg(F.min_by("plant_id", F.struct(*PLANT)).alias("first_plant"), F.avg("clean_area").alias("a"), F.avg("reward").alias("r"))
    t = t.withColumn("g", F.lit(1))
    return t.select("day", "first_plant", r6("a").alias("mean_area"), r6("r").alias("mean_reward"), r6(F.sum("r").over(up_to(("g",), "day"))).alias("running_reward"))


@query(f"WITH {DAILY} SELECT experiment, CASE WHEN clean_area < 0 THEN 0 WHEN clean_area >= 1000 THEN 51 ELSE CAST(floor(clean_area / 1000 * 50) AS BIGINT) + 1 END AS bin, count(*) AS n FROM daily GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return quality.histogram(daily(spark, sf_dir), "clean_area", 0, 1000, 50, ("experiment",)).select("experiment", F.col("bin").cast("long").alias("bin"), "n")


@query(f"""WITH {DAILY}, u AS (UNPIVOT (SELECT clean_area, action_0, action_1 FROM daily) ON clean_area, action_0, action_1 INTO NAME column_name VALUE v)
SELECT column_name, count(v) AS n, {s6('avg(v)')} AS mean, {s6('stddev_samp(v)')} AS std, min(v) AS min, max(v) AS max FROM u GROUP BY 1""")
def describe(spark, sf_dir):
    d = quality.describe(daily(spark, sf_dir), ("clean_area", "action_0", "action_1"))
    return d.select("column_name", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max")


@query(f"""WITH {DAILY}, t AS (SELECT experiment, zone, day, avg(clean_area) AS a FROM daily WHERE action_0 + action_1 > 0 GROUP BY 1, 2, 3)
SELECT experiment, zone, count(*) AS n_days, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days, {s6('arg_min(a, day)')} AS first_mean FROM t GROUP BY 1, 2""")
def zone_series(spark, sf_dir):
    from trialframe.operators.clean import nonzero_actions

    t = nonzero_actions(daily(spark, sf_dir), ("action_0", "action_1")).groupBy(*ZONE, "day").agg(F.avg("clean_area").alias("a"))
    s = t.groupBy(*ZONE).agg(F.array_sort(F.collect_list(F.struct("day", "a"))).alias("s"))  # a zone's days
    return s.select(*ZONE, F.size("s").cast("long").alias("n_days"), F.array_join(F.transform("s", lambda x: x["day"].cast("string")), ",").alias("days"), r6(F.col("s")[0]["a"]).alias("first_mean"))


@query(f"""WITH {PLANTS}, f AS (SELECT experiment, zone, avg(clean_area) AS a FROM daily WHERE day = 50 GROUP BY 1, 2), t AS (SELECT experiment, zone, avg(total) AS m FROM plants GROUP BY 1, 2)
SELECT experiment, zone, {s6('a')} AS mean_area, {s6('m')} AS mean_return FROM f JOIN t USING (experiment, zone)""")
def final_state(spark, sf_dir):
    f = daily(spark, sf_dir).where("day = 50").groupBy(*ZONE).agg(F.avg("clean_area").alias("a"))
    t = plants(spark, sf_dir).groupBy(*ZONE).agg(F.avg("total").alias("m"))
    return f.join(t, list(ZONE)).select(*ZONE, r6("a").alias("mean_area"), r6("m").alias("mean_return"))


@query(f"""WITH {DAILY}, u AS (UNPIVOT (SELECT experiment, zone, day, plant_id, clean_area, action_0 FROM daily) ON clean_area, action_0 INTO NAME metric VALUE v),
g AS (SELECT experiment, zone, day, metric, avg(v) AS mean, count(*) AS n FROM u GROUP BY 1, 2, 3, 4), states AS (SELECT u.*, {start_sql('plant_id')} AS start FROM u JOIN g USING (experiment, zone, day, metric) WHERE n > 1),
replicates AS (SELECT experiment, zone, day, metric, sum(w * v) / sum(w) AS m FROM (SELECT *, {exponential_sql('start', 'r')} AS w FROM states, range(1000) t(r)) GROUP BY experiment, zone, day, metric, r),
i AS (SELECT experiment, zone, day, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM replicates GROUP BY 1, 2, 3, 4)
SELECT experiment, zone, day, metric, {s6('mean')} AS mean, {s6('coalesce(low, mean)')} AS low, {s6('coalesce(high, mean)')} AS high, n FROM g LEFT JOIN i USING (experiment, zone, day, metric)""")
def metric_long(spark, sf_dir):
    from trialframe.operators.stats import bootstrap_ci

    long = daily(spark, sf_dir).unpivot([*ZONE, "day", "plant_id"], ["clean_area", "action_0"], "metric", "v")
    found = bootstrap_ci(long, "v", (*ZONE, "day", "metric"), "plant_id", 1000)
    return found.select(*ZONE, "day", "metric", *[r6(c).alias(c) for c in ("mean", "low", "high")], "n")


@query(f"""WITH {DAILY}, p AS (SELECT *, lead(clean_area) OVER {W} AS nxt FROM daily), v AS (SELECT * FROM p WHERE clean_area > 0 AND nxt > 0)
SELECT experiment, {s6('regr_slope(nxt, clean_area)')} AS slope, {s6('regr_intercept(nxt, clean_area)')} AS intercept, {s6('regr_r2(nxt, clean_area)')} AS r2, count(*) AS n FROM v GROUP BY 1""")
def transition_fit(spark, sf_dir):
    from trialframe.operators.stats import line_fit

    f = line_fit(trajectory.pairs_with_next(daily(spark, sf_dir)), "clean_area", "next_value", ("experiment",))
    return f.select("experiment", *[r6(c).alias(c) for c in ("slope", "intercept", "r2")], "n")
