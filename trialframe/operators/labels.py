"""Label round trips: keys in file names, labels in folder names, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators.common import PLANT

LABEL_KEY = (*PLANT, "time")


def encode_key(suffix: Column | None = None, time: str = "time") -> Column:
    """experiment_zone_plant_yyyyMMddTHHmmss_suffix."""
    tail = suffix if suffix is not None else F.substring(F.expr("uuid()"), 1, 6)
    return F.concat_ws("_", *[F.col(k).cast("string") for k in PLANT], F.date_format(time, "yyyyMMdd'T'HHmmss"), tail)


def decode_key(df: DataFrame, name: str) -> DataFrame:
    """The key's parts as columns; all null for a name of fewer than five parts."""
    parts = F.split(F.col(name), "_")
    whole = F.size(parts) >= 5
    part = lambda i: F.when(whole, F.get(parts, F.lit(i)))
    return df.withColumns(
        {
            **{k: part(i).try_cast("long") for i, k in enumerate(PLANT)},
            "time": F.try_to_timestamp(part(3), F.lit("yyyyMMdd'T'HHmmss")),
        }
    )


def folder_label(folder: str | Column) -> tuple[Column, Column, Column, Column]:
    """(name, whole number, number, text) of ``key=value``; numbers are null where the value is none, all where there is no '='."""
    f = F.col(folder) if isinstance(folder, str) else folder
    parts = F.split(f, "=", 2)
    there = F.size(parts) == 2
    value = F.when(there, F.get(parts, F.lit(1)))
    return F.when(there, F.get(parts, F.lit(0))), value.try_cast("long"), value.try_cast("double"), value


def unique_labels(labels: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def join_labels(df: DataFrame, labels: DataFrame, keys: tuple[str, ...] = LABEL_KEY) -> DataFrame:
    """Labels on the rows that have them; of repeated labels the first by value, so that no row is repeated."""
    values = tuple(c for c in labels.columns if c not in keys)
    return df.join(unique_labels(labels, keys, values), list(keys), "left")


def merge_labels(df: DataFrame, labels: DataFrame, keys: tuple[str, ...] = LABEL_KEY) -> DataFrame:
    """New labels where there are any, else the old ones."""
    values = [c for c in labels.columns if c not in keys]
    new = unique_labels(labels, keys, tuple(values)).withColumnsRenamed({c: f"{c}_new" for c in values})
    joined = df.join(new, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"{c}_new", c) if c in df.columns else F.col(f"{c}_new") for c in values}).drop(*[f"{c}_new" for c in values])


def review_folder(root: str, predicted: str, labels: tuple[str, ...]) -> Column:
    """The folder in which a row is reviewed: one for disagreement, else the first label's, else the root."""
    label = F.col(labels[0])
    differ = F.col(predicted).isNotNull() & label.isNotNull() & (F.col(predicted) != label)
    named = F.coalesce(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{root}/{c}="), F.col(c).cast("string"))) for c in labels], F.lit(root))
    return F.when(differ, F.concat(F.lit(f"{root}/_DISAGREE_pred="), F.col(predicted).cast("string"), F.lit("_label="), label.cast("string"))).otherwise(named)
