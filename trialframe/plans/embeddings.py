"""Queries on features and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import features, quality
from trialframe.operators.common import PLANT, text
from trialframe.plans.registry import query
from trialframe.plans.views import DAILY, daily, r6, s6, table

LONG = "long AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query(f"""WITH {DAILY}, u AS (UNPIVOT (SELECT clean_area, bolted_prob, action_0 FROM daily) ON clean_area, bolted_prob, action_0 INTO NAME metric VALUE v)
SELECT metric, CASE metric WHEN 'action_0' THEN 0.0 ELSE {s6('min(v)')} END AS min, CASE metric WHEN 'action_0' THEN 1.0 ELSE {s6('max(v)')} END AS max,
CASE metric WHEN 'action_0' THEN 0.0 ELSE {s6('avg(v)')} END AS mean, CASE metric WHEN 'action_0' THEN 1.0 ELSE {s6('stddev_samp(v)')} END AS std FROM u GROUP BY 1""")
def norm_stats(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("agent", F.lit("x"))
    s = features.norm_stats(d, ("clean_area", "bolted_prob", "action_0", "agent", "absent"), {"action_0": (0, 1, 0, 1)})
    return s.select("metric", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query(f"WITH {LONG} SELECT dim, {s6('min(x)')} AS min, {s6('max(x)')} AS max, {s6('avg(CAST(x AS DOUBLE))')} AS mean, {s6('stddev_pop(CAST(x AS DOUBLE))')} AS std FROM long GROUP BY 1")
def vector_stats(spark, sf_dir):
    s = features.vector_stats(embeddings(spark, sf_dir), "embedding")
    return s.select("dim", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query(f"WITH {LONG} SELECT label, dim, {s6('avg(CAST(x AS DOUBLE))')} AS mean FROM long GROUP BY 1, 2")
def mean_embedding(spark, sf_dir):
    m = features.mean_vector(embeddings(spark, sf_dir), "embedding", ("label",))
    return m.select("label", F.posexplode("mean").alias("dim", "m")).select("label", F.col("dim").cast("long").alias("dim"), r6("m").alias("mean"))


@query(f"WITH {LONG}, s AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS m, var_pop(CAST(x AS DOUBLE)) AS v FROM long GROUP BY 1) SELECT dim, {s6('m')} AS mean, {s6('v')} AS variance FROM s ORDER BY v, dim LIMIT 16")
def low_variance_dims(spark, sf_dir):
    return features.low_variance_dims(embeddings(spark, sf_dir), "embedding").select("dim", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("SELECT 'embedding' AS column_name, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS n_violations FROM embeddings UNION ALL SELECT 'label', 0 FROM (SELECT 1)")
def finite_check(spark, sf_dir):
    return quality.finite_check(embeddings(spark, sf_dir), ("label",), ("embedding",))


@query(f"""WITH {DAILY}, x AS (SELECT *, CASE WHEN day % 3 = 0 THEN NULL WHEN day % 3 = 1 THEN CAST('nan' AS DOUBLE) ELSE clean_area END AS v FROM daily), m AS (SELECT avg(v) FILTER (NOT isnan(v)) AS m FROM x)
SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, {s6('CASE WHEN v IS NULL OR isnan(v) THEN m ELSE v END')} AS v FROM x, m""")
def feature_fill(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("v", F.when(F.col("day") % 3 == 1, float("nan")).when(F.col("day") % 3 == 2, F.col("clean_area")))
    return features.feature_fill(d, features.norm_stats(d, ("v",)), ("v",)).select(*PLANT, text("time"), r6("v").alias("v"))


@query(f"WITH {DAILY} SELECT experiment, zone, plant_id, CAST(time AS VARCHAR) AS time, 8 AS width, {s6('clean_area + bolted_prob + action_0 + action_1 + action_2 + action_3 + action_4 + action_5')} AS total FROM daily")
def state_vector(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("channels", F.array(*[f"action_{i}" for i in range(6)]))
    d = features.state_vector(d, ("clean_area", "bolted_prob"), ("channels",))
    return d.select(*PLANT, text("time"), F.size("state").alias("width"), r6(F.aggregate("state", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"""WITH {LONG}, s AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS d FROM long GROUP BY 1)
SELECT vec_id, {s6('sum(abs((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END))')} AS distance, count(*) AS width FROM long JOIN s USING (dim) GROUP BY 1""")
def standardize(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    z = features.standardise(e, "embedding", features.vector_stats(e, "embedding"))
    return z.select("vec_id", r6(F.aggregate("standardised", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("distance"), F.size("standardised").cast("long").alias("width"))


@query()
def pca_project(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return features.pca_project(e, "embedding", features.fit_pca(e, "embedding", 10)).select("vec_id", "label", "pca")


@query(f"WITH {LONG}, s AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS m FROM long GROUP BY 1) SELECT vec_id, {s6('sum(power(x - m, 2))')} AS squares, CAST(count(*) AS INT) AS width FROM long JOIN s USING (dim) GROUP BY 1")
def pca_whole(spark, sf_dir):
    """With as many components as dimensions, the projection keeps every row's distance from the mean."""
    e = embeddings(spark, sf_dir)
    width = e.select(F.size("embedding")).first()[0]
    found = features.pca_project(e, "embedding", features.fit_pca(e, "embedding", width))
    return found.select("vec_id", r6(F.aggregate("pca", F.lit(0.0), lambda s, x: s + x * x)).alias("squares"), F.size("pca").alias("width"))


@query()
def pca_variance(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return features.pca_variance(e, features.fit_pca(e, "embedding", 10))


_COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))"


_NEIGHBOURS = f"""WITH p AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, round({_COS}, 6) AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM p) SELECT query, neighbour, {s6('similarity')} AS similarity, rank FROM r WHERE rank <= 15"""


@query(_NEIGHBOURS)
def embedding_neighbours(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return features.neighbours(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding").select("query", "neighbour", r6("similarity").alias("similarity"), "rank")


@query(_NEIGHBOURS)
def indexed_neighbours(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    index = features.build_index(e, "vec_id", "embedding")
    found = features.indexed_neighbours(index, e.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.select("query", "neighbour", r6("similarity").alias("similarity"), "rank")


@query(f"""WITH r AS (SELECT vec_id, dense_rank() OVER (ORDER BY label) - 1 AS k, vec_id AS t FROM embeddings)
SELECT vec_id, {s6('k / max(k) OVER ()')} AS label_scalar, {s6('(t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ())')} AS time_scalar FROM r""")
def colour_scalars(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumn("t", F.col("vec_id"))
    return features.colour_scalars(e, "label", "t").select("vec_id", r6("label_scalar").alias("label_scalar"), r6("time_scalar").alias("time_scalar"))
