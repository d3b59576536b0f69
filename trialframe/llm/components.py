"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.store import forget, save

#: Enough for any graph that fits on a cluster: the number of rounds grows with the logarithm of the vertices. Beyond it is an error.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is linked to the vertex's smallest neighbour."""
    both = edges.select(F.col("u").alias("v"), F.col("w").alias("x")).unionAll(edges.select(F.col("w").alias("v"), F.col("u").alias("x")))
    least = both.groupBy("v").agg(F.least(F.min("x"), F.col("v")).alias("m"))
    return both.where("x > v").join(least, "v").select(F.col("x").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "w").alias("v"), F.least("u", "w").alias("x"))
    least = down.groupBy("v").agg(F.min("x").alias("m"))
    joined = down.join(least, "v")
    return joined.select(F.col("x").alias("u"), F.col("m").alias("w")).unionAll(least.select(F.col("v").alias("u"), F.col("m").alias("w"))).where("u <> w").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges(u, w)``; the component is its smallest id.

    Each round is written to the shared folder, which cuts the lineage and lets
    a lost executor cost one round only. Self links and repeated links do no harm;
    no edges give no rows. Where the rounds do not reach a fixed point, an error is
    raised, as what they have is not the components yet.
    """
    now = save(edges.select("u", "w").where("u <> w").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        then = save(_small_star(_large_star(now)), "edges")
        forget(now)
        now = then
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "w")), F.bit_xor(F.xxhash64("w", "u"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("w").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct())
