"""Feature statistics, embeddings and projections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.sources.scratch import saved

_NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def no_nan(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def norm_stats(df: DataFrame, columns: tuple[str, ...], fixed: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """(metric, min, max, mean, std) of each numeric column in one pass, NaN as null; columns without values are left out.

    ``fixed`` columns get the given numbers instead.
    """
    fixed = fixed or {}
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if c in kinds and isinstance(kinds[c], _NUMERIC)]
    parts = []
    for c in numeric:
        numbers = [F.lit(float(x)) for x in fixed[c]] if c in fixed else [F.min(no_nan(c)), F.max(no_nan(c)), F.avg(no_nan(c)), F.stddev_samp(no_nan(c))]
        parts.append(F.struct(F.lit(c).alias("metric"), *[x.alias(n) for x, n in zip(numbers, ("min", "max", "mean", "std"))]))
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows")).where("min is not null")


def vector_stats(df: DataFrame, array: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, dim, min, max, mean, std) of each place of an array; std over n, not n - 1."""
    v = array_to_vector(F.col(array).cast("array<double>"))
    s = df.where(F.col(array).isNotNull()).groupBy(*keys).agg(Summarizer.metrics("min", "max", "mean", "variance", "count").summary(v).alias("s"))
    zipped = F.arrays_zip(vector_to_array("s.min").alias("min"), vector_to_array("s.max").alias("max"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))
    rows = s.select(*keys, F.col("s.count").alias("n"), F.posexplode(zipped).alias("dim", "z"))
    return rows.select(*keys, F.col("dim").cast("long").alias("dim"), "z.min", "z.max", "z.mean", F.sqrt(F.col("z.variance") * (F.col("n") - 1) / F.col("n")).alias("std"))


def mean_vector(df: DataFrame, array: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, mean): the mean array of each group."""
    v = array_to_vector(F.col(array).cast("array<double>"))
    return df.groupBy(*keys).agg(Summarizer.mean(v).alias("m")).select(*keys, vector_to_array("m").alias("mean"))


def low_variance_dims(df: DataFrame, array: str, n: int = 16) -> DataFrame:
    """The ``n`` places of least variance, with their means."""
    return vector_stats(df, array).select("dim", "mean", (F.col("std") * F.col("std")).alias("variance")).orderBy("variance", "dim").limit(n)


def feature_fill(df: DataFrame, means: dict[str, Column | float] | DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Null and NaN become the feature's mean, of ``means(metric, mean)`` or given; what is left becomes 0."""
    if isinstance(means, DataFrame):
        one = means.groupBy().pivot("metric", list(columns)).agg(F.first("mean"))
        df = df.crossJoin(F.broadcast(one.withColumnsRenamed({c: f"_mean_{c}" for c in columns})))
        filled = {c: F.coalesce(no_nan(c), F.col(f"_mean_{c}")) for c in columns}
    else:
        filled = {c: F.coalesce(no_nan(c), F.lit(means[c]) if not isinstance(means[c], Column) else means[c]) for c in columns}
    df = df.withColumns(filled).drop(*[f"_mean_{c}" for c in columns])
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns})


def state_vector(df: DataFrame, scalars: tuple[str, ...], arrays: tuple[str, ...], out: str = "state") -> DataFrame:
    """The scalars and then the arrays, as one array of doubles."""
    return df.withColumn(out, F.concat(F.array(*[F.col(c).cast("double") for c in scalars]), *[F.col(a).cast("array<double>") for a in arrays]))


def standardise(df: DataFrame, array: str, stats: DataFrame, out: str = "standardised") -> DataFrame:
    """(x - mean) / std for each place by ``stats(dim, mean, std)``; a std of 0 counts as 1."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))  # as many as an array has places
    z = F.zip_with(F.col(array).cast("array<double>"), "_s", lambda x, s: (x - s["mean"]) / F.when(s["std"] == 0, 1.0).otherwise(s["std"]))
    return df.crossJoin(F.broadcast(one)).withColumn(out, z).drop("_s")


def fit_pca(df: DataFrame, array: str, k: int = 10):
    """(centring model, PCA model) of the array; transforms must centre first, as Spark's PCA does not."""
    v = df.where(F.col(array).isNotNull()).select(array_to_vector(F.col(array).cast("array<double>")).alias("v"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(v)
    return centre, PCA(k=k, inputCol="c", outputCol="p").fit(centre.transform(v))


def pca_project(df: DataFrame, array: str, models, out: str = "pca") -> DataFrame:
    centre, pca = models
    v = df.withColumn("v", array_to_vector(F.col(array).cast("array<double>")))
    return pca.transform(centre.transform(v)).withColumn(out, vector_to_array("p")).drop("v", "c", "p")


def save_models(models, path: str) -> None:
    """Writes the models of ``fit_pca`` under ``path``."""
    for name, model in zip(("centre", "pca"), models):
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str):
    from pyspark.ml.feature import PCAModel, StandardScalerModel

    return StandardScalerModel.load(f"{path}/centre"), PCAModel.load(f"{path}/pca")


def pca_variance(df: DataFrame, models) -> DataFrame:
    """(component, ratio, cumulative) of the explained variance."""
    ratio = models[1].explainedVariance.toArray().tolist()
    rows = [(i, float(r)) for i, r in enumerate(ratio)]
    out = df.sparkSession.createDataFrame(rows, "component long, ratio double")
    return out.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("component")))


#: Numbers of query vectors that are broadcast, and numbers (scores, best rows and query vectors) that a task compares at once.
QUERY_NUMBERS, HELD_NUMBERS = 1 << 22, 1 << 18
#: Rows that a block of queries is compared with at once.
ROW_BLOCK = 1024


def _unit_rows(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, v) with vectors of length one; those of length zero stay, rows without a vector go."""
    def unit(a):
        norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(a, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))

    return df.where(F.col(array).isNotNull()).select(F.col(key).cast("long").alias("key"), unit(F.col(array).cast("array<double>")).alias("v"))


def _query_batches(queries: DataFrame):
    """(keys, matrix) of bounded parts of the queries, one after another."""
    counts = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    parts = max(1, -(-counts["n"] * counts["width"] // QUERY_NUMBERS))
    for part in range(parts):
        table = queries.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow().combine_chunks()
        yield table["key"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, counts["width"])


_FOUND = "query long, neighbour long, similarity double"


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def neighbours(df: DataFrame, queries: DataFrame, key: str, array: str, k: int = 15) -> DataFrame:
    """(query, rank, neighbour, similarity): the ``k`` most cosine-similar rows of each query, ties to the smaller key.

    A stated set of queries meets all rows in products of blocks. Queries are
    broadcast in batches of bounded size; each task keeps its own best before anything
    is shuffled, and what a batch finds is written before the next one is made.
    """
    c, found = _unit_rows(df, key, array), None
    for keys, q in _query_batches(_unit_rows(queries, key, array)):
        held = df.sparkSession.sparkContext.broadcast((keys, q))
        one = saved(c.mapInArrow(_nearest(held, k), _FOUND), "nearest")
        held.destroy()
        found = one if found is None else found.unionAll(one)
    return _best(found, k)


@dataclass
class CellIndex:
    """Rows by the cell of the nearest of some centres (unit vectors); ``radius`` is the widest angle in each cell. The last cell is for zero vectors."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray


#: Rows that the centres of an index are fitted on, at most about.
FIT_ROWS = 50_000
#: What angles and similarities may be off by.
SLACK = 1e-5


def build_index(df: DataFrame, key: str, array: str, cells: int = 64, fit_rows: int = FIT_ROWS, seed: int = 0) -> CellIndex:
    """An index over all rows, written by cell; its centres are k-means of about ``fit_rows`` rows taken by the hash of their key."""
    rows = _unit_rows(df, key, array)
    n = rows.count()
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(min(1.0, fit_rows / max(n, 1)) * (1 << 20)) + 1)
    whole = rows.where(F.exists("v", lambda x: x != 0))
    sample = whole.where(share).select(array_to_vector("v").alias("v"))
    if not sample.limit(1).count():
        sample = whole.limit(1).select(array_to_vector("v").alias("v"))
    if not sample.limit(1).count():
        centres = np.zeros((0, 1))
    else:
        made = KMeans(k=max(2, cells), seed=seed, featuresCol="v", maxIter=10).fit(sample).clusterCenters()
        centres = np.array(made) / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)
        centres = centres[np.linalg.norm(centres, axis=1) > 0.5]
    held = df.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
            near = x @ held.value.T if len(held.value) else np.zeros((len(x), 1))
            cell = np.where((x != 0).any(axis=1), near.argmax(axis=1), len(held.value)).astype(np.int32)
            angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(angle)], ["key", "v", "cell", "angle"])

    placed = rows.mapInArrow(place, "key long, v array<double>, cell int, angle double")
    placed = saved(placed.hint("rebalance", F.col("cell")).sortWithinPartitions("cell"), "index-rows")  # large cells are split
    radius = np.full(len(centres) + 1, -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row a cell
        radius[r["cell"]] = r["a"]
    return CellIndex(placed, centres, radius)


def indexed_neighbours(index: CellIndex, queries: DataFrame, key: str, array: str, k: int = 15, probes: int = 4, exact: bool = True) -> DataFrame:
    """The same rows as ``neighbours``, from the cells where they can be.

    A query first looks into its ``probes`` nearest cells. No row of another cell is
    nearer to it than its angle to the centre less the cell's radius; ``exact`` looks
    into all cells that this does not rule out once ``k`` rows are known, otherwise
    what was found is returned. A query only meets rows of its cells, and cells that no
    query looks into are skipped. Scores are those of the vectors themselves.
    """
    found = None
    cells = len(index.radius)
    spark = index.rows.sparkSession
    there = index.radius >= 0

    def look(keys, q, wanted):
        held = spark.sparkContext.broadcast((keys, q, wanted))
        open_ = np.flatnonzero(wanted.any(axis=0)).tolist()
        one = saved(index.rows.where(F.col("cell").isin(open_)).select("key", "v", "cell").mapInArrow(_nearest_in_cells(held, k), _FOUND), "nearest")
        held.destroy()
        return one

    for keys, q in _query_batches(_unit_rows(queries, key, array)):
        near = q @ index.centres.T if len(index.centres) and len(q) else np.zeros((len(q), len(index.centres)))
        wanted = np.zeros((len(q), cells), bool)
        wanted[:, -1] = True
        filled = np.where(there[None, :-1], near, -np.inf)
        order = np.argsort(-filled, axis=1)[:, :probes]
        np.put_along_axis(wanted[:, :-1], order, True, axis=1)
        wanted[~(q != 0).any(axis=1)] = True  # a zero vector is equally far from everything
        wanted &= there
        one = look(keys, q, wanted)
        if exact:
            known = dict.fromkeys(keys.tolist(), -np.inf)
            known |= {r["query"]: r["s"] for r in _best(one, k).groupBy("query").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}  # a number for each query of the batch
            least = np.array([known[x] for x in keys.tolist()])
            nearest = np.arccos(np.clip(near, -1, 1)) - index.radius[None, :-1] - SLACK
            more = wanted.copy()
            more[:, :-1] = (np.cos(np.clip(nearest, 0, np.pi)) >= least[:, None] - SLACK) & there[None, :-1] & ~wanted[:, :-1]
            more[:, -1] = False
            if more.any():
                one = one.unionAll(look(keys, q, more))
        found = one if found is None else found.unionAll(one)
    return _best(found, k)


def _nearest_in_cells(held, k: int):
    def search(batches):
        ids, q, wanted = held.value
        best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            cells, keys = np.asarray(batch.column("cell")), np.asarray(batch.column("key"))
            x = np.asarray(batch.column("v").flatten()).reshape(len(keys), -1)
            for cell in np.unique(cells).tolist():
                mine, asking = np.flatnonzero(cells == cell), np.flatnonzero(wanted[:, cell])
                _scored(best_s, best_i, asking, ids, q, keys[mine], x[mine], k)
        yield _found(ids, best_s, best_i)

    return search


def _keep_best(best_s, best_i, block, ids, own, score, k: int) -> None:
    """Merges the scores of queries ``block`` against rows ``own`` into their best so far: only those that reach the k-th are sorted."""
    np.round(score, 6, out=score)
    score[(ids[block][:, None] == own[None]) | np.isnan(score)] = -np.inf
    least = best_s[block, k - 1]
    if score.shape[1] > k and np.isneginf(least).any():
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
    row, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    asking, row_of = np.unique(row, return_inverse=True)
    block = block[asking]
    row, s, i = (np.concatenate(x) for x in ((np.repeat(np.arange(len(block)), k), row_of), (best_s[block].ravel(), score[row, at]), (best_i[block].ravel(), own[at])))
    order = np.lexsort((i, -s, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    best_s[block], best_i[block] = s[order].reshape(-1, k), i[order].reshape(-1, k)


def _scored(best_s, best_i, block, ids, q, own, x, k: int) -> None:
    """``_keep_best`` of queries ``block`` against rows ``x``, a bounded part of them at a time."""
    rows = max(1, min(len(own), ROW_BLOCK))
    step = max(1, HELD_NUMBERS // (rows + k + x.shape[1]))
    for low in range(0, len(own), rows):
        for at in range(0, len(block), step):
            part = block[at : at + step]
            _keep_best(best_s, best_i, part, ids, own[low : low + rows], q[part] @ x[low : low + rows].T, k)


def _found(ids, best_s, best_i) -> pa.RecordBatch:
    there = np.isfinite(best_s)
    return pa.record_batch([pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(best_i[there]), pa.array(best_s[there])], ["query", "neighbour", "similarity"])


def _nearest(held, k: int):
    def search(batches):
        ids, q = held.value
        best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            own = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(len(own), -1)
            _scored(best_s, best_i, np.arange(len(ids)), ids, q, own, x, k)
        yield _found(ids, best_s, best_i)

    return search


def score_rows(df: DataFrame, array: str, scorer, out: str = "bolted_prob") -> DataFrame:
    """A probability for each row by ``scorer``, a function of a batch's matrix; rows in Arrow batches."""
    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        there = v.notna()
        out = pd.Series(np.nan, index=v.index)
        if there.any():
            out[there] = np.asarray(scorer(np.stack(v[there].to_numpy())), float)
        return out

    return df.withColumn(out, F.when(F.col(array).isNotNull(), score(F.col(array).cast("array<double>"))))


def colour_scalars(df: DataFrame, label: str, time: str) -> DataFrame:
    """``label_scalar``: the label's rank scaled to [0, 1]; ``time_scalar``: the time scaled likewise."""
    from trialframe.operators.quality import minmax_scale

    ranks = df.select(label).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(label)) - 1)
    df = minmax_scale(df.join(F.broadcast(ranks), label), "_rank", "label_scalar")
    return minmax_scale(df, time, "time_scalar").drop("_rank")
