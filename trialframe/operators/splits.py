"""Samples and folds that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, keys: tuple[str, ...], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), always the same ones for a seed."""
    return df.orderBy(_order(keys, seed), *keys).limit(n)


def _order(keys: tuple[str, ...], seed: int) -> Column:
    """A random order that depends on the keys and the seed alone: the MD5 of their texts."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))))


def target_sample(df: DataFrame, targets: Column, keys: tuple[str, ...], n: int, seed: int = 0) -> DataFrame:
    """All target rows and a hash sample of the others, ``n`` rows in all if there are as many."""
    wanted = df.where(targets)
    rank = F.row_number().over(Window.orderBy(_order(keys, seed), *keys))  # of n rows
    others = df.where(~targets).orderBy(_order(keys, seed), *keys).limit(n).withColumn("_k", rank)
    room = wanted.agg(F.greatest(F.lit(n) - F.count("*"), F.lit(0)).alias("_room"))
    return wanted.unionByName(others.crossJoin(F.broadcast(room)).where("_k <= _room").drop("_k", "_room"))


def every_nth(df: DataFrame, n: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where((F.col("_k") - 1) % n == 0).drop("_k")


def top_n(df: DataFrame, n: int, keys: tuple[str, ...], order: tuple[Column | str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def group_folds(df: DataFrame, groups: tuple[str, ...], folds: int = 5) -> DataFrame:
    """(groups, n, fold): whole groups dealt to folds, largest first to the lightest fold; none with fewer groups than folds.

    There is a row for each group (experiments and zones: some dozens), which are
    dealt one after another.
    """
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"))

    def deal(batches):
        import pandas as pd

        table = pd.concat(list(batches)).sort_values(["n", *groups], ascending=[False, *[True] * len(groups)])
        if len(table) >= folds:
            load = [0] * folds
            fold = []
            for n in table["n"]:
                k = load.index(min(load))
                load[k] += int(n)
                fold.append(k)
            yield table.assign(fold=fold)

    schema = counts.withColumn("fold", F.lit(0).cast("long")).schema
    return counts.coalesce(1).mapInPandas(deal, schema)
