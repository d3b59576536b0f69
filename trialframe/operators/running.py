"""Values that run along time, for keys of any number of rows.

A key with more rows than a task should walk is cut into runs, ranges of key and
time; each run is worked on apart, what it hands on is combined along the runs,
of which there are few, and every run then starts from what the ones before it
hand it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.sources.scratch import saved

#: Rows of one key that one task may walk.
LARGE_KEY = 1 << 20


def has_large_key(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether a key has more than LARGE_KEY rows; only counts of keys are shuffled."""
    return bool(df.groupBy(*keys).count().where(F.col("count") > LARGE_KEY).limit(1).count())


def in_runs(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """``df`` written in ``parts`` ranges of keys and order, ``_run`` their number; rows equal in both are in one range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(parts, *keys, *order).withColumn("_run", F.spark_partition_id()), "runs")


def fill_along(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """Each of ``columns`` with its last value that is not null, up to the row, of the row's key.

    A run takes in what the runs before it end with; only the first key of a run can
    have begun earlier, so that is one row a run, which is broadcast.
    """
    runs = in_runs(df, keys, order, parts)
    own = Window.partitionBy("_run", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    ends = runs.groupBy(*keys, "_run").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_end_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_to"), F.count("*").over(earlier).alias("_n"), *[F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns])
    brought = brought.where("_n > 0").drop("_n")
    same = [F.col("_run") == F.col("_to"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]]
    met = runs.join(F.broadcast(brought), same, "left")
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"_in_{c}")) for c in columns}
    return met.withColumns(filled).select(*df.columns)


def decayed_sums(points: DataFrame, keys: tuple[str, ...], time: str, made: dict[str, tuple[str, float]], parts: int | None = None) -> DataFrame:
    """(keys, time, a column for each name): means of a column's values before the row, each weighing less by a factor a row; 0 without one and after a null.

    ``points`` has a row for each key and time. A run hands on the decayed sums of
    its last key, and over how many rows: these rows, one a run, come to the driver,
    which combines them, as sums of sums decay like values. Where there are no more
    points than one key may have in a task, they are walked by key and nothing is cut.
    """
    columns = tuple(dict.fromkeys(c for c, _ in made.values()))
    places, fade = [columns.index(c) for c, _ in made.values()], np.array([b for _, b in made.values()])
    still = saved(points, "points")
    cut = parts is not None or still.count() > LARGE_KEY
    if cut:
        walked = in_runs(still, keys, (time,), parts).repartition("_run").sortWithinPartitions("_run", *keys, time)
    else:
        walked = still.repartition(*keys).sortWithinPartitions(*keys, time).withColumn("_run", F.lit(0))

    def rows(batches):
        """(batch, run, key, values and which of them there are) of every row in order."""
        for batch in batches:
            x = np.column_stack([batch.column(c).cast("float64").to_numpy(zero_copy_only=False) for c in columns])[:, places]
            there = ~np.column_stack([batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in columns])[:, places]
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            yield batch, batch.column("_run").to_pylist(), names, np.where(there, x, 0.0), there

    def ends(batches):
        at, kinds = None, None
        for batch, numbers, names, x, there in rows(batches):
            kinds = kinds or [pa.int32(), pa.bool_(), *(batch.schema.field(k).type for k in keys), pa.int64(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.bool_())]
            for i, (run, key) in enumerate(zip(numbers, names)):
                if at is None or run != at[0]:
                    if at is not None:
                        yield summary(at, kinds)
                    at = [run, True, key, 0, np.zeros(len(fade)), np.zeros(len(fade)), None]
                elif key != at[2]:
                    at[1:6] = [False, key, 0, np.zeros(len(fade)), np.zeros(len(fade))]
                at[3:] = [at[3] + 1, at[4] * fade + x[i], at[5] * fade + there[i], there[i]]
        if at is not None:
            yield summary(at, kinds)

    def summary(at, kinds):
        run, whole, key, m, n, d, last = at
        values = [run, whole, *key, m, n, d, last.tolist()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], ["_run", "whole", *keys, "m", "n", "d", "last"])

    fields = [points.schema[k] for k in keys]
    vector = T.ArrayType(T.DoubleType())
    state = T.StructType([T.StructField("_run", T.IntegerType()), T.StructField("whole", T.BooleanType()), *fields, T.StructField("m", T.LongType()), T.StructField("n", vector), T.StructField("d", vector), T.StructField("last", T.ArrayType(T.BooleanType()))])
    brought, carried = {}, None
    for r in sorted(walked.mapInArrow(ends, state).collect(), key=lambda r: r["_run"]) if cut else []:  # one row a run
        key = tuple(r[k] for k in keys)
        n, d = np.array(r["n"]), np.array(r["d"])
        if carried is not None:
            brought[r["_run"]] = carried
            if r["whole"] and carried[0] == key:
                n, d = n + fade ** r["m"] * carried[1], d + fade ** r["m"] * carried[2]
        carried = (key, n, d, np.array(r["last"]))
    shared = points.sparkSession.sparkContext.broadcast(brought)

    def walk(batches):
        held, run = None, None
        nothing = (None, np.zeros(len(fade)), np.zeros(len(fade)), np.zeros(len(fade), bool))
        for batch, numbers, names, x, there in rows(batches):
            out = np.zeros(x.shape)
            for i, (now, key) in enumerate(zip(numbers, names)):
                if now != run or key != held:
                    before = shared.value.get(now, nothing) if now != run else nothing
                    _, n, d, last = before if before[0] == key else nothing
                    run, held = now, key
                out[i] = np.where(last, n / np.where(d > 0, d, 1), 0.0)
                n, d, last = n * fade + x[i], d * fade + there[i], there[i]
            yield pa.record_batch([*(batch.column(c) for c in (*keys, time)), *(pa.array(out[:, k]) for k in range(len(made)))], [*keys, time, *made])

    schema = T.StructType([*fields, points.schema[time], *(T.StructField(n, T.DoubleType()) for n in made)])
    return walked.mapInArrow(walk, schema)
