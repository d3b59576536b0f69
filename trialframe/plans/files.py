"""Queries on labels, names, manifests and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import clean, labels
from trialframe.operators.common import PLANT, ZONE, text
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, daily, r6, s6, table
from trialframe.sources import tables

PATHS = "concat('/d/E', experiment, '/P1/x/zone', lpad(CAST(zone AS VARCHAR), 2, '0'), '/', plant_id, '_', strftime(time, '%Y%m%d'), '.jpg')"


def with_path(spark, sf_dir):
    path = F.concat(F.lit("/d/E"), F.col("experiment").cast("string"), F.lit("/P1/x/zone"), F.lpad(F.col("zone").cast("string"), 2, "0"), F.lit("/"), F.col("plant_id").cast("string"), F.lit("_"), F.date_format("time", "yyyyMMdd"), F.lit(".jpg"))
    return daily(spark, sf_dir).withColumn("image_path", path)


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, min((quality, toxic))[1] AS quality, min((quality, toxic))[2] AS toxic FROM labels GROUP BY 1) l USING (doc_id)".replace("min((quality, toxic))[1]", "min(quality)").replace("min((quality, toxic))[2]", "arg_min(toxic, (quality, toxic))"))
def label_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.join_labels(d, table(spark, sf_dir, "labels"), ("doc_id",)).select("doc_id", "lang", "quality", "toxic")


@query("""WITH old AS (SELECT doc_id, n_chars % 2 AS quality FROM documents), new AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1)
SELECT doc_id, CAST(coalesce(q, quality) AS BIGINT) AS quality FROM old LEFT JOIN new USING (doc_id)""")
def label_merge(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("quality"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return labels.merge_labels(old, new, ("doc_id",)).select("doc_id", "quality")


@query("""WITH l AS (SELECT doc_id, min(quality) AS quality, arg_min(toxic, (quality, toxic)) AS toxic FROM labels GROUP BY 1), x AS (SELECT doc_id, quality, toxic, CAST(n_chars % 2 AS INT) AS pred FROM documents LEFT JOIN l USING (doc_id))
SELECT doc_id, CASE WHEN quality IS NOT NULL AND pred <> quality THEN concat('r/_DISAGREE_pred=', pred, '_label=', quality) WHEN quality IS NOT NULL THEN concat('r/quality=', quality) WHEN toxic IS NOT NULL THEN concat('r/toxic=', toxic) ELSE 'r' END AS folder FROM x""")
def label_routing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("pred"))
    joined = labels.join_labels(d, table(spark, sf_dir, "labels"), ("doc_id",))
    return joined.select("doc_id", labels.review_folder("r", "pred", ("quality", "toxic")).alias("folder"))


@query(f"""WITH {DAILY}, k AS (SELECT CASE WHEN day % 10 = 0 THEN concat('bad_', plant_id) ELSE concat(experiment, '_', zone, '_', plant_id, '_', strftime(time, '%Y%m%dT%H%M%S'), '_abc123') END AS name, * FROM daily)
SELECT name, CASE WHEN day % 10 <> 0 THEN experiment END AS experiment, CASE WHEN day % 10 <> 0 THEN zone END AS zone, CASE WHEN day % 10 <> 0 THEN plant_id END AS plant_id, CASE WHEN day % 10 <> 0 THEN CAST(time AS VARCHAR) END AS time FROM k""")
def key_codec(spark, sf_dir):
    d = daily(spark, sf_dir)
    named = d.select(F.when(F.col("day") % 10 == 0, F.concat(F.lit("bad_"), F.col("plant_id").cast("string"))).otherwise(labels.encode_key(F.lit("abc123"))).alias("name"))
    return labels.decode_key(named, "name").select("name", *PLANT, text("time"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('n=', n_chars) WHEN 1 THEN concat('x=', n_chars, '.5') WHEN 2 THEN concat('lang=', lang) ELSE source END AS folder FROM documents)
SELECT doc_id, CASE WHEN contains(folder, '=') THEN split_part(folder, '=', 1) END AS name, CASE WHEN doc_id % 4 = 0 THEN TRY_CAST(split_part(folder, '=', 2) AS BIGINT) END AS whole,
CASE WHEN contains(folder, '=') THEN TRY_CAST(split_part(folder, '=', 2) AS DOUBLE) END AS number, CASE WHEN contains(folder, '=') THEN split_part(folder, '=', 2) END AS word FROM f""")
def folder_label(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    kind = F.col("doc_id") % 4
    folder = F.when(kind == 0, F.concat(F.lit("n="), n)).when(kind == 1, F.concat(F.lit("x="), n, F.lit(".5"))).when(kind == 2, F.concat(F.lit("lang="), F.col("lang"))).otherwise(F.col("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", folder.alias("folder"))
    parts = labels.folder_label("folder")
    return d.select("doc_id", *[p.alias(a) for p, a in zip(parts, ("name", "whole", "number", "word"))])


@query(f"""WITH {DAILY}, p AS (SELECT *, {PATHS} AS image_path FROM daily WHERE experiment IN (11, 12) AND extract(hour FROM time) = 9)
SELECT DISTINCT image_path, concat(experiment, '_', zone, '_', strftime(time, '%Y%m%dT%H%M%S'), '_', string_split(image_path, '/')[-1]) AS target, regexp_replace(image_path, '/x/', '/y/') AS shown_path FROM p""")
def image_manifest(spark, sf_dir):
    p = with_path(spark, sf_dir).where(F.col("experiment").isin(11, 12) & (F.hour("time") == 9))
    name = F.element_at(F.split("image_path", "/"), -1)
    target = F.concat_ws("_", F.col("experiment").cast("string"), F.col("zone").cast("string"), F.date_format("time", "yyyyMMdd'T'HHmmss"), name)
    return p.select("image_path", target.alias("target"), F.regexp_replace("image_path", "/x/", "/y/").alias("shown_path")).distinct()


@query(f"WITH {DAILY} SELECT {PATHS} AS image_path, experiment AS from_path, zone AS zone_from_path FROM daily")
def path_metadata(spark, sf_dir):
    return with_path(spark, sf_dir).select("image_path", tables.experiment_of("image_path").alias("from_path"), tables.zone_of("image_path").alias("zone_from_path"))


@query(f"WITH {DAILY}, p AS (SELECT experiment, zone, arg_min({PATHS}, (time, plant_id)) AS image_path FROM daily GROUP BY 1, 2) SELECT * FROM p")
def first_local_image(spark, sf_dir):
    p = clean.to_local(with_path(spark, sf_dir), "UTC")
    return p.where(F.hour("local_time") == 9).groupBy(*ZONE).agg(F.min_by("image_path", F.struct("time", "plant_id")).alias("image_path"))


@query("SELECT doc_id AS id, lang AS kind, CAST(n_chars AS DOUBLE) AS size FROM documents UNION ALL SELECT item_id, NULL, CAST(length(text) AS DOUBLE) + 0.5 FROM benchmark UNION ALL SELECT page_id, url, NULL FROM pages")
def union_relaxed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("n_chars").alias("size"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.length("text") + 0.5).cast("double").alias("size"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("kind"))
    return tables.union_relaxed(d, b, p).select("id", "kind", "size")


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def union_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return d.unionByName(table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("id")))


@query(f"WITH {DAILY}, n AS (SELECT *, concat('E', experiment, '_Z', zone, '.parquet') AS file FROM daily) SELECT file, plant_id, CAST(time AS VARCHAR) AS time FROM n WHERE experiment IN (11, 14) AND zone IN (1, 2, 12)")
def file_predicate(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("file", F.concat(F.lit("E"), F.col("experiment").cast("string"), F.lit("_Z"), F.col("zone").cast("string"), F.lit(".parquet")))
    return tables.file_predicate(d, F.col("file"), [11, 14], [1, 2, 12]).select("file", "plant_id", text("time"))


@query(f"""WITH {DAILY}, m AS (SELECT experiment, zone, time, arg_min(action_0, plant_id) AS setting FROM daily GROUP BY 1, 2, 3), q AS (SELECT time, count(*) AS n_images FROM daily GROUP BY 1)
SELECT d.experiment, d.zone, d.plant_id, CAST(d.time AS VARCHAR) AS time, d.clean_area, m.setting FROM daily d LEFT JOIN m USING (experiment, zone, time)""")
def plant_explode(spark, sf_dir):
    d = daily(spark, sf_dir)
    detections = d.select(*PLANT, "time", "clean_area")
    metadata = clean.dedup(d, (*ZONE, "time"), ("plant_id",)).select(*ZONE, "time", F.col("action_0").alias("setting"))
    return detections.join(metadata, [*ZONE, "time"], "left").select(*PLANT, text("time"), "clean_area", "setting")


@query(f"""WITH {DAILY}, q AS (SELECT {PATHS} AS image_path, md5({PATHS}) AS image_hash, day % 200 AS brightness FROM daily WHERE day % 2 = 0)
SELECT concat('/mnt', {PATHS}) AS full_path, coalesce(q.image_hash, '') AS image_hash, coalesce(q.brightness, -1) AS brightness FROM daily LEFT JOIN q ON q.image_path = {PATHS}""")
def image_quality_join(spark, sf_dir):
    d = with_path(spark, sf_dir)
    q = d.where("day % 2 = 0").select("image_path", F.md5("image_path").alias("image_hash"), (F.col("day") % 200).alias("brightness")).distinct()
    j = d.join(q, "image_path", "left")
    return j.select(F.concat(F.lit("/mnt"), F.col("image_path")).alias("full_path"), F.coalesce("image_hash", F.lit("")).alias("image_hash"), F.coalesce("brightness", F.lit(-1)).alias("brightness"))
