"""Light: spectra as coefficients of three basis lamps, traces, doses."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.common import CHANNELS, COEFFICIENTS, ZONE, whole
from trialframe.operators.running import decayed_sums

#: The three lamps' settings of the six channels.
BASIS = {
    "red_coef": (9.71409574, 34.97074468, 4.01515957, 0.0, 56.3, 6.13067376),
    "white_coef": (19.6875, 70.875, 8.1375, 0.0, 6.3, 12.425),
    "blue_coef": (69.6875, 29.33653846, 3.36826923, 0.0, 2.60769231, 5.14294872),
}
BETAS = (0.5, 0.7, 0.9)


def action_coefficients(df: DataFrame, channels: tuple[str, ...] = CHANNELS, basis: dict[str, tuple[float, ...]] = BASIS) -> DataFrame:
    """Least-squares coefficients of the basis, clipped to [0, 1] and scaled to sum 1 (all zero stays zero).

    The pseudo-inverse is 3 by 6 and made once; each row is then three linear
    expressions. A null channel gives null coefficients.
    """
    inverse = np.linalg.pinv(np.column_stack(list(basis.values())))
    raw = {n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(Column.__add__, [F.col(c) * float(w) for c, w in zip(channels, row)]))) for n, row in zip(basis, inverse)}
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in channels])
    df = df.withColumns({f"_{n}": F.when(~missing, x) for n, x in raw.items()})
    total = reduce(Column.__add__, [F.col(f"_{n}") for n in basis])
    return df.withColumns({n: F.when(total > 0, F.col(f"_{n}") / total).otherwise(F.col(f"_{n}")) for n in basis}).drop(*[f"_{n}" for n in basis])


def l1_to_basis(df: DataFrame, channels: tuple[str, ...] = CHANNELS, basis: dict[str, tuple[float, ...]] = BASIS) -> DataFrame:
    """Sum of absolute differences between the action and each basis vector."""
    return df.withColumns({f"{n.removesuffix('_coef')}_l1": reduce(Column.__add__, [F.abs(F.col(c) - F.lit(float(x))) for c, x in zip(channels, v)]) for n, v in basis.items()})


def intensity(df: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Sum of the channels there are, over 100; rows without light are dropped."""
    there = [F.col(c) for c in channels if c in df.columns]
    return df.withColumn("intensity", reduce(Column.__add__, there) / 100.0).where("intensity > 0")


#: Columns whose traces the daily table has.
TRACED = (*CHANNELS, *COEFFICIENTS)


def trace_names(columns: tuple[str, ...], betas: tuple[float, ...] = BETAS) -> dict[str, tuple[str, float]]:
    return {f"{c}_trace_{b:g}": (c, b) for c in columns for b in betas}


def action_traces(df: DataFrame, columns: tuple[str, ...] = TRACED, betas: tuple[float, ...] = BETAS, keys: tuple[str, ...] = ZONE, time: str = "time") -> DataFrame:
    """Exponentially weighted means of the rows before, per zone, 0 on the first row and after a null.

    The mean at a row weighs a value k rows back by beta**k over the sum of the
    weights; nulls keep their place but carry no weight. Rows that repeat a zone's
    time (its plants) share one trace. Distinct times are walked in order by tasks that
    hold two numbers for each trace; a zone may have any number of them, as many points
    are walked in ranges of zone and time that hand on what they end with.
    """
    made = trace_names(columns, betas)
    points = df.select(*keys, time, *columns).dropDuplicates([*keys, time])
    return df.join(decayed_sums(points, keys, time, made), [*keys, time])


def step_coefficients(df: DataFrame, steps: int = 13, keys: tuple[str, ...] = ZONE, columns: tuple[str, ...] = COEFFICIENTS, time: str = "time") -> DataFrame:
    """Mean coefficients of a zone over its first ``steps`` times."""
    points = df.select(*keys, time, *columns).dropDuplicates([*keys, time])
    first = points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(time))).where(F.col("_n") <= steps)
    return first.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n_steps"))


def pivot_calibration(calibration: DataFrame, zone: str = "ZONE", colour: str = "COLOR", value: str = "PPFD_ELEC", colours: tuple[str, ...] = ("R", "W", "B")) -> DataFrame:
    """One row a zone with a column for each colour."""
    return calibration.groupBy(F.col(zone).alias("zone")).pivot(colour, list(colours)).agg(F.first(value))


def weighted_dose(df: DataFrame, calibration: DataFrame, columns: tuple[str, ...] = COEFFICIENTS, colours: tuple[str, ...] = ("R", "W", "B")) -> DataFrame:
    """``dose``: coefficients times the zone's calibration (a dozen rows)."""
    joined = df.join(F.broadcast(calibration), "zone", "left")
    return joined.withColumn("dose", reduce(Column.__add__, [F.col(c) * F.col(k) for c, k in zip(columns, colours)])).drop(*colours)


def weighted_spectrum(coefficients: DataFrame, spectra: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, wavelength, intensity): the lamps' spectra weighted and added, not below 0. ``spectra(zone, wavelength, red, white, blue)``."""
    total = F.col("red_coef") * F.col("red") + F.col("white_coef") * F.col("white") + F.col("blue_coef") * F.col("blue")
    return coefficients.join(spectra, "zone").select(*keys, "wavelength", F.greatest(F.lit(0.0), total).alias("intensity"))


def spectrum_difference(spectrum: DataFrame, by: tuple[str, ...] = ("agent", "day", "wavelength")) -> DataFrame:
    """Each spectrum minus the mean of its agent's, on the days that all the agent's zones have."""
    days = spectrum.groupBy("agent", "zone").agg(F.max("day").alias("m")).groupBy("agent").agg(F.min("m").alias("_last"))
    common = spectrum.join(days, "agent").where("day <= _last").drop("_last")
    return common.withColumn("difference", F.col("intensity") - F.avg("intensity").over(whole(by)))
