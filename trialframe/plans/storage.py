"""Queries that write files and read them back: raw telemetry, processed zones, settings, sheets, images, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import attributes, clean, features, light, stats
from trialframe.operators.common import PLANT, ZONE, text
from trialframe.plans.embeddings import LONG
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, TELEMETRY, daily, mean_to, r6, s6, table, telemetry
from trialframe.sources import tables
from trialframe.sources.scratch import name_files, scratch


@query(f"""WITH {TELEMETRY} SELECT experiment, zone, user_id AS image, CAST(time AS VARCHAR) AS time, power AS action_0, CAST(event_id AS DOUBLE) AS action_3, CASE WHEN zone <> 4 THEN power + zone END AS power FROM telemetry""")
def telemetry_csv(spark, sf_dir):
    root = scratch(spark, "telemetry")
    t = telemetry(spark, sf_dir)
    columns = {
        "time": F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        "image_name": F.col("user_id").cast("string"),
        **{f"action.{i}": F.lit(float(i)) for i in range(1, 6)},
        "action.0": F.col("power"),
        "action.3": F.col("event_id").cast("double"),
        "power": F.col("power") + F.col("zone"),
        "note": F.lit("a, b"),
    }
    declared = ["time", "image_name", *[f"action.{i}" for i in range(6)]]
    layouts = {1: [*declared, "power"], 2: ["power", "note", *reversed(declared)], 3: ["note", *declared[::2], "power", *declared[1::2]], 4: declared, 5: [*declared, "power", "note"]}
    for zone, names in layouts.items():
        t.where(F.col("zone") == zone).select(*[columns[n].alias(n) for n in names]).write.option("header", True).csv(f"{root}/E1/P1/zone{zone:02d}")
    read = tables.read_telemetry(spark, f"{root}/E1/P1/*/*.csv")
    return read.select("experiment", "zone", F.col("image_name").cast("long").alias("image"), text("time"), "action_0", "action_3", "power")


def processed(spark, sf_dir) -> str:
    """A folder of one Parquet file a zone, named by experiment and zone."""
    root = scratch(spark, "processed")
    tables.write_zones(daily(spark, sf_dir).withColumns({"e": F.col("experiment"), "z": F.col("zone")}), f"{root}/zones")
    name_files(spark, f"{root}/zones", "*/*/*.parquet", f"{root}/named", lambda p: "E{}/E{}_Z{}.parquet".format(*(p.split("experiment=")[1].split("/")[0],) * 2, p.split("/zone=")[1].split("/")[0]))
    return f"{root}/named"


@query(f"WITH {DAILY} SELECT experiment AS e, zone AS z, plant_id, CAST(time AS VARCHAR) AS time, clean_area FROM daily WHERE experiment IN (11, 14) AND zone IN (1, 2, 12)")
def processed_scan(spark, sf_dir):
    found = tables.scan_processed(spark, processed(spark, sf_dir), [11, 14], [1, 2, 12])
    return found.select("e", "z", "plant_id", text("time"), "clean_area")


@query(f"WITH {DAILY} SELECT CAST(experiment AS INT) AS experiment, CAST(zone AS INT) AS zone, plant_id, CAST(time AS VARCHAR) AS time, clean_area + CASE WHEN zone = 3 THEN 1000 ELSE 0 END AS clean_area FROM daily")
def zone_partitions(spark, sf_dir):
    root = scratch(spark, "zones")
    d = daily(spark, sf_dir)
    tables.write_zones(d, root)
    tables.write_zones(d.where("zone = 3").withColumn("clean_area", F.col("clean_area") + 1000), root)  # replaces those zones only
    return spark.read.parquet(root).select("experiment", "zone", "plant_id", text("time"), "clean_area")


@query(f"""WITH {DAILY}, c AS (SELECT experiment, zone, count(*) AS later, count(*) FILTER (zone % 3 <> 0 OR day <= 40) AS first FROM daily GROUP BY 1, 2)
SELECT CAST(experiment AS INT) AS experiment, CAST(zone AS INT) AS zone, plant_id, CAST(time AS VARCHAR) AS time, clean_area + CASE WHEN first <> later THEN 1000 ELSE 0 END AS clean_area, CASE WHEN first <> later THEN 2 ELSE 1 END AS run, later AS n_images
FROM daily JOIN c USING (experiment, zone)""")
def refreshed_zones(spark, sf_dir):
    root = scratch(spark, "refreshed")
    d = daily(spark, sf_dir)
    counts = lambda rows: rows.groupBy(*ZONE).agg(F.count("*").alias("n_images"))
    first = d.where("zone % 3 <> 0 or day <= 40")  # in some zones, images of later days come in afterwards
    tables.refresh_zones(first, counts(first), root, lambda rows: rows.withColumn("run", F.lit(1)))
    tables.refresh_zones(d, counts(d), root, lambda rows: rows.withColumns({"run": F.lit(2), "clean_area": F.col("clean_area") + 1000}))
    known = tables.read_manifest(spark, root)
    return spark.read.parquet(root).join(known, list(ZONE)).select(*[F.col(c).cast("int").alias(c) for c in ZONE], "plant_id", text("time"), "clean_area", "run", "n_images")


@query(f"""WITH {DAILY}, z AS (SELECT *, CASE WHEN experiment % 2 = 0 THEN 'Europe/Paris' ELSE 'America/Edmonton' END AS timezone FROM daily)
SELECT experiment, plant_id, timezone, CAST(timezone(timezone, timezone('UTC', time)) AS VARCHAR) AS local_time FROM z""")
def time_zone_files(spark, sf_dir):
    root = scratch(spark, "settings")
    d = daily(spark, sf_dir)
    settings = d.select("experiment").distinct().withColumn("value", F.when(F.col("experiment") % 2 == 0, F.lit('{"timezone": "Europe/Paris", "other": 1}')).otherwise(F.lit("{}")))
    settings.repartition("experiment").write.partitionBy("experiment").text(root)
    zones = tables.read_time_zones(spark, f"{root}/*/*.txt").withColumn("directory", F.regexp_extract("directory", r"experiment=\d+$", 0))
    named = tables.attach_time_zones(d.withColumn("directory", F.concat(F.lit("experiment="), F.col("experiment").cast("string"))), zones)
    local = named.withColumn("local_time", F.from_utc_timestamp("time", F.col("timezone")))
    return local.select("experiment", "plant_id", "timezone", text("local_time"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def read_columns(spark, sf_dir):
    return tables.read_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


_LAMPS = "(VALUES (1, 'R'), (2, 'W'), (3, 'B')) c(k, COLOR)"


@query(f"""WITH s AS (SELECT l_linenumber AS zone, k, COLOR, CAST(floor(sum(l_quantity)) AS INT) % 500 + k AS v FROM lineitem CROSS JOIN {_LAMPS} GROUP BY 1, 2, 3)
SELECT CAST(zone AS INT) AS zone, max(v) FILTER (COLOR = 'R') AS R, max(v) FILTER (COLOR = 'W') AS W, max(v) FILTER (COLOR = 'B') AS B FROM s GROUP BY 1""")
def calibration_csv(spark, sf_dir):
    root = scratch(spark, "calibration")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("ZONE")).agg((F.floor(F.sum("l_quantity")) % 500).cast("int").alias("v"))
    lamps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate("RWB", 1)])).alias("lamp")
    rows = sums.select("ZONE", "v", lamps).select("ZONE", (F.col("v") + F.col("lamp.k")).alias("PPFD_ELEC"), F.col("lamp.c").alias("COLOR"), F.lit(0).alias("PPFD_SUN"))
    rows.write.option("header", True).csv(root)
    return light.pivot_calibration(tables.read_calibration(spark, root))


@query("""SELECT CAST(l_linenumber AS BIGINT) AS zone, CAST(l_partkey % 40 * 10 + 380 AS DOUBLE) AS wavelength, round(sum(l_quantity), 2) AS red, round(sum(l_discount), 2) AS white, round(sum(l_tax), 2) AS blue
FROM lineitem GROUP BY 1, 2""")
def spectra_files(spark, sf_dir):
    root = scratch(spark, "spectra")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("zone"), (F.col("l_partkey") % 40 * 10 + 380).alias("w"))
    sums = li.agg(F.round(F.sum("l_quantity"), 2).alias("red"), F.round(F.sum("l_discount"), 2).alias("white"), F.round(F.sum("l_tax"), 2).alias("blue"))
    long = sums.unpivot(["zone", "w"], ["red", "white", "blue"], "colour", "v")
    long.select("zone", "colour", F.concat_ws(" ", F.col("w").cast("string"), F.col("v").cast("decimal(20,2)").cast("string")).alias("value")).repartition("zone", "colour").write.partitionBy("zone", "colour").text(f"{root}/parts")
    name_files(spark, f"{root}/parts", "*/*/*.txt", f"{root}/named", lambda p: "zone{}_{}.txt".format(p.split("zone=")[1].split("/")[0], p.split("colour=")[1].split("/")[0]))
    return tables.read_spectra(spark, f"{root}/named/*.txt")


@query(f"WITH {DAILY}, m AS (SELECT experiment, zone, round(avg(clean_area), 3) AS v FROM daily GROUP BY 1, 2) SELECT zone, {s6('avg(v)')} AS biomass FROM m GROUP BY 1")
def harvest_sheet(spark, sf_dir):
    root = scratch(spark, "harvest")
    wide = daily(spark, sf_dir).groupBy(F.col("experiment").cast("string").alias("Plot")).pivot("zone", list(range(1, 13))).agg(mean_to(3, "clean_area"))
    wide = wide.withColumnsRenamed({str(z): f"Zone {z}" for z in range(1, 13)})
    average = wide.agg(F.lit("Avg").alias("Plot"), *[F.avg(F.col(f"`Zone {z}`")).alias(f"Zone {z}") for z in range(1, 13)])
    wide.unionByName(average).write.option("header", True).csv(root)
    return tables.harvest_long(spark.read.option("header", True).csv(root), "Plot").where("biomass is not null").select("zone", r6("biomass").alias("biomass"))


_OFFSET = "CASE day % 3 WHEN 0 THEN '+0000' WHEN 1 THEN '-0700' ELSE '+0530' END"
_SIDE = "CASE day % 4 WHEN 0 THEN '_left' WHEN 1 THEN '_right' ELSE '' END"


@query(f"""WITH {DAILY}, i AS (SELECT concat(strftime(time, '%Y-%m-%dT%H%M%S'), {_OFFSET}, {_SIDE}, '.png') AS image_name, concat('bytes of ', plant_id, ' ', day, chr(10)) AS content, day, time FROM daily WHERE experiment = 11 AND zone = 1),
o AS (SELECT image_name, max(content) AS content, any_value(time) AS time, any_value(day) AS day FROM i GROUP BY 1)
SELECT image_name, md5(content) AS image_hash, CAST(strlen(content) AS BIGINT) AS n_bytes, CAST(time - CASE day % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL (-7) HOUR ELSE INTERVAL 330 MINUTE END AS VARCHAR) AS time,
CASE day % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS side FROM o""")
def image_files(spark, sf_dir):
    root = scratch(spark, "images")
    d = daily(spark, sf_dir).where("experiment = 11 and zone = 1")
    offset = F.when(F.col("day") % 3 == 0, "+0000").when(F.col("day") % 3 == 1, "-0700").otherwise("+0530")
    side = F.when(F.col("day") % 4 == 0, "_left").when(F.col("day") % 4 == 1, "_right").otherwise("")
    named = d.select(F.concat(F.date_format("time", "yyyy-MM-dd'T'HHmmss"), offset, side, F.lit(".png")).alias("image_name"), F.concat_ws(" ", F.lit("bytes of"), F.col("plant_id").cast("string"), F.col("day").cast("string")).alias("value"))
    named.groupBy("image_name").agg(F.max("value").alias("value")).repartition("image_name").write.partitionBy("image_name").text(f"{root}/parts")
    from urllib.parse import unquote

    name_files(spark, f"{root}/parts", "*/*.txt", f"{root}/named", lambda p: unquote(p.split("image_name=")[1].split("/")[0]))
    return tables.image_manifest(spark, f"{root}/named").select("image_name", "image_hash", "n_bytes", text("time"), "side")


@query(f"""WITH {DAILY}, u AS (UNPIVOT (SELECT clean_area, bolted_prob FROM daily) ON clean_area, bolted_prob INTO NAME metric VALUE v)
SELECT metric, {s6('min(v)')} AS min, {s6('max(v)')} AS max, {s6('avg(v)')} AS mean, {s6('stddev_samp(v)')} AS std FROM u GROUP BY 1""")
def stats_file(spark, sf_dir):
    root = scratch(spark, "stats")
    tables.write_stats(features.norm_stats(daily(spark, sf_dir), ("clean_area", "bolted_prob")), root)
    return tables.read_stats(spark, root).select("metric", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query(f"""WITH {DAILY}, w AS (SELECT experiment, zone, count(*) AS n_images FROM daily GROUP BY 1, 2), done AS (SELECT experiment, zone, count(*) FILTER (zone % 3 <> 0 OR day > 20) AS n_images FROM daily WHERE experiment <> 15 GROUP BY 1, 2)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.experiment = w.experiment AND done.zone = w.zone AND done.n_images = w.n_images)""")
def stale_zones(spark, sf_dir):
    d = daily(spark, sf_dir)
    wanted = d.groupBy(*ZONE).agg(F.count("*").alias("n_images"))
    done = d.where("experiment <> 15").groupBy(*ZONE).agg(F.count(F.when((F.col("zone") % 3 != 0) | (F.col("day") > 20), 1)).alias("n_images"))
    return tables.stale_zones(wanted, done)


@query(f"""WITH {LONG}, s AS (SELECT dim, avg(x) AS m FROM long GROUP BY 1) SELECT vec_id, true AS same, CAST(count(*) AS INT) AS width, {s6('sum(power(x - m, 2))')} AS squares FROM long JOIN s USING (dim) GROUP BY 1""")
def saved_models(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    width = e.select(F.size("embedding")).first()[0]  # so many components keep a row's distance from the mean, if the model read back is whole
    root, models = scratch(spark, "models"), features.fit_pca(e, "embedding", width)
    features.save_models(models, root)
    both = features.pca_project(features.pca_project(e, "embedding", models, "before"), "embedding", features.load_models(root), "after")
    return both.select("vec_id", (F.col("before") == F.col("after")).alias("same"), F.size("after").alias("width"), r6(F.aggregate("after", F.lit(0.0), lambda t, x: t + x * x)).alias("squares"))


@query("SELECT unnest(['e', 'z', 'plant_id', 'time', 'clean_area']) AS column_name, true AS stored, true AS whole")
def storage_profile(spark, sf_dir):
    root = processed(spark, sf_dir)
    p = tables.storage_profile(spark, f"{root}/*/*.parquet").where(F.col("column_name").isin("e", "z", "plant_id", "time", "clean_area"))
    return p.select("column_name", ((F.col("compressed") > 0) & (F.col("uncompressed") > 0)).alias("stored"), F.col("share").between(0.0, 1.0).alias("whole"))


@query(f"""WITH {DAILY}, p AS (SELECT *, lead(clean_area) OVER (PARTITION BY experiment, zone, plant_id ORDER BY time) AS nxt FROM daily), v AS (SELECT * FROM p WHERE clean_area > 0 AND nxt > 0)
SELECT 'line' AS kind, {s6('regr_slope(nxt, clean_area)')} AS slope, {s6('regr_intercept(nxt, clean_area)')} AS intercept, count(*) AS n FROM v""")
def parameter_report(spark, sf_dir):
    from trialframe.operators.trajectory import pairs_with_next

    fit = stats.line_fit(pairs_with_next(daily(spark, sf_dir)), "clean_area", "next_value")
    report = tables.parameter_report({"kind": "line", "slope": F.col("slope"), "intercept": F.col("intercept"), "n": F.col("n")}, fit)
    read = report.select(F.from_json("report", "kind string, slope double, intercept double, n long").alias("r")).select("r.*")
    return read.select("kind", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n")


@query(f"SELECT vec_id, {s6('1 / (1 + exp(-list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (i % 3)))))')} AS bolted_prob FROM embeddings")
def scored_rows(spark, sf_dir):
    def scorer(x):
        import numpy as np

        return 1 / (1 + np.exp(-(x * (np.arange(1, x.shape[1] + 1) % 3)).sum(axis=1)))

    return features.score_rows(table(spark, sf_dir, "embeddings"), "embedding", scorer).select("vec_id", r6("bolted_prob").alias("bolted_prob"))


_HEX = "list_avg(list_transform(range(1, 33), lambda i: ascii(substr(md5(coalesce(html, '')), CAST(i AS BIGINT), 1))))"


@query(f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN -1.0 ELSE {s6(_HEX)} END AS brightness, CASE WHEN page_id % 5 = 0 THEN md5('') ELSE md5(md5(coalesce(html, ''))) END AS image_hash FROM pages")
def image_brightness(spark, sf_dir):
    def decode(content):
        import numpy as np

        grey = np.frombuffer(content, np.uint8)
        if not len(grey):
            raise ValueError("no image")
        return grey

    pages = table(spark, sf_dir, "pages").withColumn("content", F.encode(F.when(F.col("page_id") % 5 == 0, "").otherwise(F.md5(F.coalesce("html", F.lit("")))), "utf-8"))
    return tables.image_quality(pages, decode).select("page_id", r6("brightness").alias("brightness"), "image_hash")


@query(f"""WITH {DAILY}, f AS (SELECT experiment, zone, time, min(action_0) AS setting, min(day) AS frame_day FROM daily GROUP BY 1, 2, 3)
SELECT d.experiment, d.zone, d.plant_id, CAST(d.time AS VARCHAR) AS time, d.clean_area, f.setting, f.frame_day FROM daily d LEFT JOIN f ON d.experiment = f.experiment AND d.zone = f.zone AND d.time = f.time AND f.frame_day % 7 <> 0""")
def exploded_plants(spark, sf_dir):
    d = daily(spark, sf_dir)
    frames = d.where("day % 7 <> 0").select(*ZONE, "time", F.lit(-1.0).alias("clean_area"), F.col("action_0").alias("setting"), F.col("day").alias("frame_day"))
    out = attributes.explode_plants(d.select(*PLANT, "time", "clean_area"), frames, order=("setting",))
    return out.select(*PLANT, text("time"), "clean_area", "setting", "frame_day")


_DARK = "day % 4 = 1"


@query(f"""WITH {DAILY}, frames AS (SELECT DISTINCT experiment, zone, time, {_DARK} AS dark FROM daily),
f AS (SELECT *, CASE WHEN dark THEN max(time) FILTER (NOT dark) OVER (PARTITION BY experiment, zone ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE time END AS source FROM frames)
SELECT f.experiment, f.zone, d.plant_id, CAST(f.time AS VARCHAR) AS time, d.clean_area, f.dark AS carried FROM f JOIN daily d ON d.experiment = f.experiment AND d.zone = f.zone AND d.time = f.source""")
def carry_dark_frames(spark, sf_dir):
    d = daily(spark, sf_dir)
    frames = d.select(*ZONE, "time", F.when(F.expr(_DARK), 20.0).otherwise(120.0).alias("brightness")).distinct()
    return clean.carry_frames(frames, d).select(*PLANT, text("time"), "clean_area", "carried")
