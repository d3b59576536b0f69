"""Experiment attributes: small calendar and policy tables attached to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.common import DAY_MICROS, ZONE, micros, whole
from trialframe.operators.running import fill_along, has_large_key

#: Agents of an experiment's zones; zone None stands for all other zones.
AGENTS = {
    11: {None: "Uniform_Discrete"},
    12: {None: "Uniform_Discrete"},
    13: {None: "Uniform_Dirichlet"},
    14: {1: "Constant_White", 2: "InAC_Data_Det", 3: "InAC_Data_Sto", 4: "InAC_Data_Sto", 5: "InAC_Data_Sto", 6: "InAC_Data_Sto", 8: "InAC_GP_Det_Opt0", 9: "InAC_GP_Det_Opt0.25", 10: "InAC_GP_Det_Opt0.5", 11: "InAC_GP_Det_Opt0.75", 12: "InAC_GP_Det_Opt1"},
    15: {2: "InAC_2", 3: "InAC_3", 4: "InAC_4"},
    16: {1: "Constant_White", 2: "InAC_Seed7", 3: "InAC_Seed6", 4: "InAC_Seed21", 5: "Constant_White", 6: "InAC_Seed7", 7: "InAC_Seed6", 8: "InAC_Seed21", 9: "Constant_White", 10: "InAC_Seed7", 11: "InAC_Seed6", 12: "InAC_Seed21"},
    17: {1: "RedRed", 2: "RedBlue", 3: "BlueRed", 4: "BlueBlue", 5: "RedRed", 6: "RedBlue", 7: "BlueRed", 8: "BlueBlue", 9: "RedRed", 10: "RedBlue", 11: "BlueRed", 12: "BlueBlue"},
    18: {1: "SequencePowerLawRamp", 2: "SequenceParabolic", 3: "ConstantLow", 4: "SequenceSeventyPercentRamp", 5: "SequenceLateRamp", 6: "SequenceBlueToRedLate", 7: "SequenceBlueToRedEarly", 8: "ConstantBlue", 9: "SequenceRedToBlueEarly", 10: "SequenceRedToBlueLate", 11: "Constant"},
}


def agent_table(spark, agents: dict = AGENTS) -> DataFrame:
    """(experiment, zone, agent); a null zone is the experiment's default."""
    rows = [(e, z, a) for e, zones in agents.items() for z, a in zones.items()]
    return spark.createDataFrame(rows, "experiment long, zone long, agent string")


def map_agents(df: DataFrame, agents: DataFrame, default: str = "Other") -> DataFrame:
    """``agent`` of the row's zone, else of its experiment, else ``default``. ``agents`` is a hand-written table."""
    exact = agents.where("zone is not null").select(*ZONE, F.col("agent").alias("_a"))
    rest = agents.where("zone is null").select("experiment", F.col("agent").alias("_b"))
    joined = df.join(F.broadcast(exact), list(ZONE), "left").join(F.broadcast(rest), "experiment", "left")
    return joined.withColumn("agent", F.coalesce("_a", "_b", F.lit(default))).drop("_a", "_b")


def map_values(column: str, values: dict, default: str) -> Column:
    """A value by ``column``, ``default`` where there is none."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(table[F.col(column)], F.lit(default))


def attach_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Event dates and counts of ``calendar(experiment, ...)`` on every row; one row an experiment."""
    return df.join(calendar, "experiment", "left")


def days_since(df: DataFrame, events: dict[str, str], time: str = "time") -> DataFrame:
    """Days from each event's date column to the row's date, negative before it; null where the column is missing."""
    out = {name: F.datediff(F.to_date(time), F.col(at)) if at in df.columns else F.lit(None).cast("long") for name, at in events.items()}
    return df.withColumns(out)


def wall_time(df: DataFrame, keys: tuple[str, ...] = ZONE, time: str = "time", hour: float = 9.5, out: str = "wall_time") -> DataFrame:
    """Days, with fractions, since ``hour`` o'clock of the key's first day."""
    first = F.to_date(F.min(time).over(whole(keys))).cast("timestamp")
    return df.withColumn(out, (micros(time) - F.unix_micros(first) - int(hour * 3_600_000_000)) / float(DAY_MICROS))


def asof_join(left: DataFrame, right: DataFrame, by: tuple[str, ...], left_on: str, right_on: str, values: tuple[str, ...], order: tuple[str, ...] = (), tolerance_micros: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides go through one shuffle on ``by`` and one sort; no rows are paired. A
    key of very many rows is cut into ranges of time, each of which is brought the
    last right row of those before. ``order`` breaks ties among right rows (the last
    wins). Beyond the tolerance, if given, the values are null.
    """
    columns = left.columns
    side = F.struct(F.col(right_on).alias("_at"), *[F.col(v) for v in values])
    order = order or values
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(o) for o in order]).alias("_o"), side.alias("_r"), F.lit(None).cast(left.select(F.struct(*columns)).schema[0].dataType).alias("_l"))
    tie = F.lit(None).cast(r.schema["_o"].dataType)
    lft = left.select(*by, F.col(left_on).cast(r.schema["_t"].dataType).alias("_t"), F.lit(1).alias("_side"), tie.alias("_o"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*columns).alias("_l"))
    both = r.unionByName(lft)
    if has_large_key(left.select(*by).unionAll(right.select(*by)), by):
        both = both.withColumn("_h", F.xxhash64("_t", "_l"))  # so that a time's left rows may be cut as well
        found = fill_along(both, by, ("_t", "_side", "_o", "_h"), ("_r",)).withColumnRenamed("_r", "_m").where("_side = 1")
    else:
        w = Window.partitionBy(*by).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    keep = F.lit(True) if tolerance_micros is None else micros(F.col("_t")) - micros(F.col("_m._at")) <= tolerance_micros
    return found.select("_l.*", F.when(keep, F.col("_m._at")).alias(f"{right_on}_asof"), *[F.when(keep, F.col(f"_m.{v}")).alias(v) for v in values])


#: Rows of a calendar that may be gathered and broadcast.
CALENDAR_ROWS = 10_000


def asof_calendar(left: DataFrame, calendar: DataFrame, by: tuple[str, ...], left_on: str, right_on: str, values: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """``asof_join`` with a small right side: each key's events as one sorted array, broadcast, so that the rows stay where they are.

    A calendar of more than ``CALENDAR_ROWS`` rows takes the other way.
    """
    if calendar.limit(CALENDAR_ROWS + 1).count() > CALENDAR_ROWS:
        return asof_join(left, calendar, by, left_on, right_on, values, order)
    event = F.struct(F.col(right_on).alias("at"), F.struct(*[F.col(o) for o in order or values]).alias("o"), *[F.col(v).alias(f"v_{v}") for v in values])
    events = calendar.groupBy(*by).agg(F.array_sort(F.collect_list(event)).alias("_events"))
    met = left.join(F.broadcast(events), list(by), "left").withColumn("_m", F.try_element_at(F.filter("_events", lambda e: e["at"] <= F.col(left_on)), F.lit(-1)))
    return met.select(*left.columns, F.col("_m.at").alias(f"{right_on}_asof"), *[F.col(f"_m.v_{v}").alias(v) for v in values])


#: Targets that may be broadcast.
TARGETS = 1_000


def nearest_rows(df: DataFrame, targets: DataFrame, value: str, keys: tuple[str, ...], tie: str) -> DataFrame:
    """For each key and target of ``targets(target)``, the row whose ``value`` is nearest; ties to the smaller ``tie``. Targets are a short list."""
    if targets.limit(TARGETS + 1).count() > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    row = F.struct(*[c for c in df.columns if c not in keys])
    near = df.crossJoin(F.broadcast(targets)).groupBy(*keys, "target").agg(F.min_by(row, F.struct(F.abs(F.col(value) - F.col("target")), F.col(tie))).alias("_r"))
    return near.select(*keys, "target", "_r.*")


def explode_plants(detections: DataFrame, frames: DataFrame, keys: tuple[str, ...] = (*ZONE, "time"), order: tuple[str, ...] = ()) -> DataFrame:
    """Every detected plant's row with its frame's columns.

    A column of both tables is the detection's; of the frames' columns those that
    only they have are kept, one row a frame: the first by ``order``, or by all
    columns where none is given.
    """
    own = [c for c in frames.columns if c in keys or c not in detections.columns]
    first = F.min_by(F.struct(*[c for c in own if c not in keys]), F.struct(*(order or [c for c in frames.columns if c not in keys])))
    one = frames.groupBy(*keys).agg(first.alias("_frame")).select(*keys, "_frame.*")
    return detections.join(one, list(keys), "left")
