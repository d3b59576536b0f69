"""Group comparisons from sufficient statistics.

Spark reduces the rows to counts, sums and rank sums of each group; the tests are
then expressions over as many rows as there are groups or pairs of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.functions.draws import exponentials
from trialframe.functions.special import p_chi2, p_f, p_normal, p_range, p_t
from trialframe.operators.common import join_groups
from trialframe.operators.order import average_rank, group_quantiles, in_ranges
from trialframe.sources.scratch import saved


def moments(df: DataFrame, value: str, group: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, group, n, mean, var) of each group's non-null values."""
    return df.where(F.col(value).isNotNull()).groupBy(*within, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def group_pairs(stats: DataFrame, group: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Each pair of groups once, the statistics with suffixes _a and _b."""
    a = stats.withColumnsRenamed({c: f"{c}_a" for c in stats.columns})
    b = stats.withColumnsRenamed({c: f"{c}_b" for c in stats.columns})
    same = F.col(f"{group}_a") < F.col(f"{group}_b")
    for k in within:
        same = same & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    return a.join(b, same)


def welch_pairs(df: DataFrame, value: str, group: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(group_a, group_b, diff, t, dof, p) of all pairs of groups, unequal variances."""
    pairs = group_pairs(moments(df, value, group, within).where("n > 1"), group, within)
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    out = pairs.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("t", F.try_divide(F.col("diff"), F.sqrt(va + vb))).withColumn("dof", dof)
    keep = [*[F.col(f"{k}_a").alias(k) for k in within], f"{group}_a", f"{group}_b", "diff", "t", "dof"]
    return out.select(*keep).withColumn("p", p_t(F.col("t"), F.col("dof")))


def holm(df: DataFrame, p: str, out: str = "p_holm", within: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """Step-down adjusted p-values, never falling with p, at most 1."""
    by = list(within) or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy(p, *tie)
    m = F.count(p).over(Window.partitionBy(*by))
    raw = df.withColumn("_adj", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1)))
    return raw.withColumn(out, F.max("_adj").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_adj")


def stars(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def anova(df: DataFrame, value: str, group: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(ss_between, ss_within, df_between, df_within, f, eta2, p) of one-way groups."""
    g = moments(df, value, group, within)
    by = list(within)
    total = g.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"))
    joined = g.join(F.broadcast(total), by) if by else g.crossJoin(F.broadcast(total))
    s = joined.groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ss_between"),
        F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)).alias("ss_within"),
        (F.count("*") - 1).alias("df_between"),
        (F.sum("n") - F.count("*")).alias("df_within"),
    )
    f = F.try_divide(F.try_divide(F.col("ss_between"), F.col("df_between")), F.try_divide(F.col("ss_within"), F.col("df_within")))
    out = s.withColumn("f", f).withColumn("eta2", F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")))
    return out.withColumn("p", p_f(F.col("f"), F.col("df_between"), F.col("df_within")))


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """(f, df1, df2, p): one-way comparison without equal variances."""
    g = moments(df, value, group).where("n > 1 and var > 0").withColumn("w", F.col("n") / F.col("var"))
    t = g.agg(F.count("*").alias("k"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("grand"))
    s = g.crossJoin(F.broadcast(t)).groupBy("k").agg(
        F.sum(F.col("w") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("num"),
        F.sum(F.pow(1 - F.col("w") / F.col("sw"), 2) / (F.col("n") - 1)).alias("lam"),
    )
    k = F.col("k").cast("double")
    out = s.select(F.try_divide(F.col("num") / (k - 1), 1 + 2 * (k - 2) / (k * k - 1) * F.col("lam")).alias("f"), (k - 1).alias("df1"), F.try_divide(k * k - 1, 3 * F.col("lam")).alias("df2"))
    return out.withColumn("p", p_f(F.col("f"), F.col("df1"), F.col("df2")))


def alexander_govern(df: DataFrame, value: str, group: str) -> DataFrame:
    """(statistic, dof, p) of the test on normalised group deviations."""
    g = moments(df, value, group).where("n > 1 and var > 0").withColumn("w", F.col("n") / F.col("var"))
    t = g.agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("grand"), F.count("*").alias("k"))
    x = g.crossJoin(F.broadcast(t)).withColumn("t", (F.col("mean") - F.col("grand")) / F.sqrt(1 / F.col("w"))).withColumn("v", F.col("n") - 1.0)
    a, b = F.col("v") - 0.5, 48 * F.pow(F.col("v") - 0.5, 2)
    c = F.sqrt(a * F.ln(1 + F.col("t") * F.col("t") / F.col("v")))
    z = c + (F.pow(c, 3) + 3 * c) / b - (4 * F.pow(c, 7) + 33 * F.pow(c, 5) + 240 * F.pow(c, 3) + 855 * c) / (F.lit(10.0) * b * b + 8 * b * F.pow(c, 4) + 1000 * b)
    out = x.agg(F.sum(z * z).alias("statistic"), (F.count("*") - 1).alias("dof"))
    return out.withColumn("p", p_chi2(F.col("statistic"), F.col("dof")))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way ANOVA of the distances from the group's median."""
    rows = df.where(F.col(value).isNotNull())
    medians = group_quantiles(rows, value, (group,), {"_m": 0.5})
    return anova(join_groups(rows, medians, (group,)).withColumn("_d", F.abs(F.col(value) - F.col("_m"))), "_d", group)


def rank_sums(df: DataFrame, value: str, group: str, within: tuple[str, ...] = (), weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(within, group, n, rank_sum) with average ranks for ties, and (within, total, ties): the tie term is the sum of t^3 - t.

    Distinct values are counted first, unless ``weight`` already says how many rows each
    stands for; only these counts are put in order. Both results are written.
    """
    by = list(within)
    number = F.count("*") if weight is None else F.sum(weight)
    counted = saved(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"), group).agg(number.alias("_c")), "counted")
    values = saved(in_ranges(counted.groupBy(*by, "_v").agg(F.sum("_c").alias("_t")), "_v"), "values")
    parts = values.groupBy(*by, "_part").agg(F.sum("_t").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_t").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.join(parts, [*by, "_part"]).withColumn("_rank", F.col("_before") + own + (F.col("_t") + 1) / 2)
    sums = counted.join(ranked.select(*by, "_v", "_rank"), [*by, "_v"]).groupBy(*by, group).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_rank")).alias("rank_sum"))
    ties = values.groupBy(*by).agg(F.sum("_t").alias("total"), F.sum(F.pow("_t", 3) - F.col("_t")).alias("ties"))
    return saved(sums, "rank-sums"), saved(ties, "ties")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, dof, p) with the correction for ties."""
    sums, ties = rank_sums(df, value, group)
    one = sums.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), (F.count("*") - 1).alias("dof")).crossJoin(F.broadcast(ties))
    n = F.col("total").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))
    return one.select(h.alias("h"), "dof").withColumn("p", p_chi2(F.col("h"), F.col("dof")))


def nested_ss(df: DataFrame, value: str, outer: str, inner: str) -> DataFrame:
    """(ss_outer, ss_inner, ss_resid, ss_total, eta2_outer, eta2_inner): inner groups nested in outer ones."""
    cells = moments(df, value, inner, (outer,))
    outers = cells.groupBy(outer).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"))
    total = outers.agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"))
    a = outers.crossJoin(F.broadcast(total)).agg(F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_g"), 2)).alias("ss_outer"))
    b = cells.join(F.broadcast(outers), outer).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_m"), 2)).alias("ss_inner"), F.sum(F.coalesce("var", F.lit(0.0)) * (F.col("n") - 1)).alias("ss_resid"))
    out = a.crossJoin(b).withColumn("ss_total", F.col("ss_outer") + F.col("ss_inner") + F.col("ss_resid"))
    return out.withColumn("eta2_outer", F.try_divide("ss_outer", "ss_total")).withColumn("eta2_inner", F.try_divide("ss_inner", "ss_total"))


def two_way(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Type II table (term, ss, dof, f, eta2, p) of two factors and their interaction.

    The model is fitted on cell means and counts, of which there are few.
    """
    cells = moments(df, value, b, (a,)).withColumnsRenamed({a: "_a", b: "_b"}).select(F.col("_a").cast("string"), F.col("_b").cast("string"), "n", "mean", "var")

    def fit(batches):
        import numpy as np
        import pandas as pd

        t = pd.concat(list(batches))
        n, y = t["n"].to_numpy(float), t["mean"].to_numpy(float)
        one = lambda c: pd.get_dummies(t[c], drop_first=True).to_numpy(float).reshape(len(t), -1)
        base, xa, xb = np.ones((len(t), 1)), one("_a"), one("_b")

        def left(*parts):
            x = np.hstack((base, *parts)) * np.sqrt(n)[:, None]
            beta = np.linalg.lstsq(x, y * np.sqrt(n), rcond=None)[0]
            return float(((y * np.sqrt(n) - x @ beta) ** 2).sum()), np.linalg.matrix_rank(x)

        ra, rb, rab = left(xa), left(xb), left(xa, xb)
        inside = float((t["var"].fillna(0) * (n - 1)).sum())
        rows = [(a, rb[0] - rab[0], rab[1] - rb[1]), (b, ra[0] - rab[0], rab[1] - ra[1]), (f"{a}:{b}", rab[0], len(t) - rab[1]), ("residual", inside, int(n.sum()) - len(t))]
        total = float((n * (y - (n * y).sum() / n.sum()) ** 2).sum()) + inside
        yield pd.DataFrame([(k, s, float(d), s / total if total else None) for k, s, d in rows], columns=["term", "ss", "dof", "eta2"])

    table = cells.coalesce(1).mapInPandas(fit, "term string, ss double, dof double, eta2 double")
    rest = table.where("term = 'residual'").select(F.col("ss").alias("_s"), F.col("dof").alias("_d"))
    out = table.crossJoin(F.broadcast(rest)).withColumn("f", F.when(F.col("term") != "residual", F.try_divide(F.try_divide(F.col("ss"), F.col("dof")), F.try_divide(F.col("_s"), F.col("_d")))))
    return out.withColumn("p", p_f(F.col("f"), F.col("dof"), F.col("_d"))).drop("_s", "_d")


def games_howell(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group_a, group_b, diff, se, t, dof, p): pairs without equal variances, p from the studentised range."""
    stats = moments(df, value, group).where("n > 1")
    stats = saved(stats, "moments")
    pairs = group_pairs(stats, group).crossJoin(F.broadcast(stats.agg(F.count("*").alias("k"))))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    out = pairs.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("se", F.sqrt((va + vb) / 2)).withColumn("t", F.try_divide(F.abs("diff"), F.sqrt(va + vb))).withColumn("dof", dof)
    return out.withColumn("p", p_range(F.col("t") * F.sqrt(F.lit(2.0)), F.col("k"), F.col("dof"))).select(f"{group}_a", f"{group}_b", "diff", "se", "t", "dof", "p")


def posthoc(df: DataFrame, value: str, group: str) -> DataFrame:
    """Pair statistics of four post-hoc tests with their p-values: Tukey (q), Tamhane T2 (t), Dunn (z, also by Holm), Mann-Whitney (u, also by Bonferroni)."""
    counted = saved(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_rows")), "counted")
    stats = saved(moments(df, value, group).where("n > 1"), "moments")
    pooled = stats.agg((F.sum(F.col("var") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("mse"), F.sum(F.col("n") - 1).alias("dfw"), F.count("*").alias("k"))
    sums, ties = rank_sums(counted, value, group, weight="_rows")
    full = stats.join(sums.select(group, "rank_sum"), group)
    pairs = group_pairs(full, group).crossJoin(F.broadcast(pooled)).crossJoin(F.broadcast(ties))
    inv = 1 / F.col("n_a") + 1 / F.col("n_b")
    n = F.col("total").cast("double")
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = pairs.withColumns(
        {
            "tukey_q": F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), F.sqrt(F.col("mse") / 2 * inv)),
            "tamhane_t": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb)),
            "tamhane_dof": F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)),
            "dunn_z": F.try_divide(F.col("rank_sum_a") / F.col("n_a") - F.col("rank_sum_b") / F.col("n_b"), F.sqrt((n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * inv)),
        }
    )
    m = F.col("k") * (F.col("k") - 1) / 2
    out = out.withColumn("tukey_p", p_range(F.col("tukey_q"), F.col("k"), F.col("dfw")))
    out = out.withColumn("tamhane_p", 1 - F.pow(1 - p_t(F.col("tamhane_t"), F.col("tamhane_dof")), m))
    out = out.withColumn("dunn_p", p_normal(F.col("dunn_z"))).join(_mann_whitney_of_counts(counted, value, group), [f"{group}_a", f"{group}_b"]).withColumn("mw_p_bonferroni", F.least(F.lit(1.0), F.col("mw_p") * m))
    names = [f"{group}_a", f"{group}_b", "tukey_q", "tukey_p", "tamhane_t", "tamhane_dof", "tamhane_p", "dunn_z", "dunn_p", "mw_u", "mw_p", "mw_p_bonferroni"]
    return holm(out.select(*names), "dunn_p", "dunn_p_holm", tie=(f"{group}_a", f"{group}_b"))


def mann_whitney_pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group_a, group_b, mw_u, mw_p) of all pairs: u of the first group, two-sided normal p with ties and continuity correction.

    A distinct value is ranked once for each pair that its group is in, with the number
    of rows that have it, so there are as many copies of the distinct values as groups
    less one, however often a value occurs.
    """
    return _mann_whitney_of_counts(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_rows")), value, group)


def _mann_whitney_of_counts(rows: DataFrame, value: str, group: str) -> DataFrame:
    """``mann_whitney_pairs`` of (group, value, _rows)."""
    a, b = f"{group}_a", f"{group}_b"
    pairs = group_pairs(rows.select(group).distinct(), group)
    either = (F.col(group) == F.col(a)) | (F.col(group) == F.col(b))
    sums, ties = rank_sums(rows.join(F.broadcast(pairs), either), value, group, (a, b), "_rows")  # as many pairs as groups have
    own = lambda c, k: F.max(F.when(F.col(group) == F.col(k), F.col(c)))
    one = sums.groupBy(a, b).agg(own("n", a).alias("_na"), own("n", b).alias("_nb"), own("rank_sum", a).alias("_ra")).join(ties, [a, b])
    n, na, nb = F.col("total").cast("double"), F.col("_na"), F.col("_nb")
    u = F.col("_ra") - na * (na + 1) / 2
    spread = na * nb / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(u, na * nb - u) - na * nb / 2 - 0.5, F.sqrt(spread))
    return one.select(a, b, u.alias("mw_u"), F.least(F.lit(1.0), F.when(z > 0, p_normal(z)).otherwise(1.0)).alias("mw_p"))


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(u, z, p) of groups ``a`` and ``b``, normal approximation with ties and without continuity correction."""
    two = df.where(F.col(group).isin(a, b))
    sums, ties = rank_sums(two, value, group)
    one = sums.agg(F.max(F.when(F.col(group) == a, F.col("n"))).alias("na"), F.max(F.when(F.col(group) == b, F.col("n"))).alias("nb"), F.max(F.when(F.col(group) == a, F.col("rank_sum"))).alias("ra")).crossJoin(F.broadcast(ties))
    n = F.col("total").cast("double")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    spread = F.col("na") * F.col("nb") / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    out = one.select(u.alias("u"), F.try_divide(u - F.col("na") * F.col("nb") / 2, F.sqrt(spread)).alias("z"))
    return out.withColumn("p", p_normal(F.col("z")))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman, pearson_p): over rows with both values; ranks are averages of ties."""
    both = saved(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), "both")
    out = average_rank(saved(average_rank(both, x, "_x"), "ranked"), y, "_y").agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_x", "_y").alias("spearman"))
    t = F.col("pearson") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("pearson") * F.col("pearson")))
    return out.withColumn("pearson_p", p_t(t, F.col("n") - 2))


def line_fit(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def origin_slope(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, r2, n): slope through the origin and R2 against the mean, from sums of one pass; groups of two rows and more."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.var_pop(y).alias("vy"), F.count("*").alias("n"))
    k = F.try_divide(F.col("xy"), F.col("xx"))
    rest = F.col("yy") - 2 * k * F.col("xy") + k * k * F.col("xx")
    return s.where("n > 1").select(*keys, k.alias("k"), (1 - F.try_divide(rest, F.col("vy") * F.col("n"))).alias("r2"), "n")


def residuals(df: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """``residual`` of each row from its group's slope through the origin."""
    fit = origin_slope(df, x, y, keys).select(*keys, F.col("k").alias("_k"))
    return df.join(fit, list(keys)).withColumn("residual", F.col(y) - F.col("_k") * F.col(x)).drop("_k")


def huber_fit(df: DataFrame, x: tuple[str, ...], y: str, intercept: bool = True, ridge: float = 1e-4):
    """A robust linear model (Huber loss)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=list(x), outputCol="features").transform(df.where(F.col(y).isNotNull()).dropna(subset=list(x)))
    return LinearRegression(featuresCol="features", labelCol=y, loss="huber", regParam=ridge, standardization=False, fitIntercept=intercept).fit(data)


#: Rows of a permutation test that one task holds, about.
BUCKET_ROWS = 50_000
#: Weights that a task draws at once, and bytes of sums that it holds.
DRAWN, HELD_BYTES = 1 << 20, 64 << 20
#: Rows of one group that one task adds up where there are many groups; a larger group is dealt to several.
GROUP_ROWS = 1 << 20
#: Replicates in one row on their way to where a group's sums meet.
PIECE = 256


def bootstrap_ci(df: DataFrame, value: str, keys: tuple[str, ...], row_id: str, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, n, mean, low, high): percentile interval of the mean.

    Weights are exponential, a function of seed, row and replicate, so a lost task
    gives the same numbers again; rows of a group should differ in ``row_id``. No row
    is copied for a replicate. Few groups: a task holds their sums for all its rows and
    passes each on once, whatever the size of its batches. More groups than
    ``HELD_BYTES`` of sums: rows are sorted by group first, a task holds some groups and
    finishes those that it has whole; only groups of more than ``GROUP_ROWS`` rows are
    dealt to several tasks, whose sums then meet. NaN and infinite values take no part;
    a single value is its own interval; null keys are a group.
    """
    x = F.col(value).cast("double")
    key = F.col(row_id).cast("long") if df.schema[row_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(row_id)
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, key.alias("_h"), x.alias("_x"))
    room = max(1, HELD_BYTES // (16 * replicates))
    few = not keys or rows.select(*keys).distinct().limit(room + 1).count() <= room
    if few:
        rows = rows.withColumn("_parts", F.lit(0))
    else:
        large = saved(rows.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_parts")).where("_parts > 1"), "large-groups")
        rows = _with_parts(rows, large, keys)
        rows = rows.repartition(*keys, F.pmod("_h", "_parts")).sortWithinPartitions(*keys)
    sums = rows.mapInArrow(_sums_of_replicates(keys, replicates, level, seed, room), _replicate_schema(rows, keys))
    together = sums.repartition(*keys) if keys else sums.repartition(1)  # one vector a task
    schema = T.StructType([*(rows.schema[k] for k in keys), *_INTERVAL])
    return together.sortWithinPartitions(*keys, "piece").mapInArrow(_merged_replicates(keys, replicates, level), schema)


_INTERVAL = [T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("mean", "low", "high"))]


def _replicate_schema(rows: DataFrame, keys: tuple[str, ...]) -> T.StructType:
    vectors = (T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("w", "wx"))
    return T.StructType([*(rows.schema[k] for k in keys), *_INTERVAL, T.StructField("piece", T.IntegerType()), *vectors])


def _with_parts(rows: DataFrame, large: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``_parts``: how many tasks share the row's group."""
    if not large.limit(1).count():
        return rows.withColumn("_parts", F.lit(1))
    return join_groups(rows, large, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def _interval(w: np.ndarray, wx: np.ndarray, n: int, s: float, level: float) -> tuple[int, float, float, float]:
    low, high = np.quantile(wx / w, [(1 - level) / 2, (1 + level) / 2]).tolist() if n > 1 else (s, s)
    return n, s / n, low, high


def _sums_of_replicates(keys: tuple[str, ...], replicates: int, level: float, seed: int, room: int):
    """A function for mapInArrow: the groups' intervals where the task has all their rows, else their sums in pieces."""

    def add(batches):
        held: dict[tuple, list] = {}
        last, kinds = None, None

        def give(groups):
            rows = []
            for g in groups:
                n, s, w, wx, parts = held.pop(g)
                if parts == 1:
                    rows.append((*g, *_interval(w, wx, n, s, level), 0, None, None))
                else:
                    rows += [(*g, n if at == 0 else 0, s if at == 0 else 0.0, None, None, at, w[at : at + PIECE], wx[at : at + PIECE]) for at in range(0, replicates, PIECE)]
            for at in range(0, len(rows), 1000):
                yield pa.record_batch([pa.array([r[i] for r in rows[at : at + 1000]], k) for i, k in enumerate(kinds)], [*keys, "n", "mean", "low", "high", "piece", "w", "wx"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [*(batch.schema.field(k).type for k in keys), pa.int64(), *[pa.float64()] * 3, pa.int32(), *[pa.list_(pa.float64())] * 2]
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            code: dict[tuple, int] = {}
            which = np.array([code.setdefault(g, len(code)) for g in names])
            order = np.argsort(which, kind="stable")
            ends = np.cumsum(np.bincount(which))
            h, v, parts = batch.column("_h").to_numpy()[order], batch.column("_x").to_numpy()[order], batch.column("_parts").to_numpy()[order]
            for g, a, b in zip(code, [0, *ends[:-1].tolist()], ends.tolist()):
                if g not in held:
                    if len(held) >= room:  # only where rows come group by group, or where vectors meet again later
                        yield from give([k for k in held if k != last])
                    held[g] = [0, 0.0, np.zeros(replicates), np.zeros(replicates), int(parts[a])]
                last, own = g, held[g]
                own[0] += b - a
                own[1] += float(v[a:b].sum())
                step = max(1, DRAWN // replicates)
                for at in range(a, b, step):
                    drawn = exponentials(h[at : min(b, at + step)], replicates, seed)
                    own[2] += drawn.sum(axis=0)
                    own[3] += v[at : min(b, at + step)] @ drawn
        if held:
            yield from give(list(held))

    return add


def _merged_replicates(keys: tuple[str, ...], replicates: int, level: float):
    """A function for mapInArrow over rows sorted by group and piece: finished groups as they are, the others' sums added up."""

    def merge(batches):
        held, n, s, w, wx, out, kinds = None, 0, 0.0, None, None, [], None

        def close():
            if held is not None and w is not None:
                out.append((*held, *_interval(w, wx, n, s, level)))

        for batch in batches:
            kinds = kinds or [*(batch.schema.field(k).type for k in keys), pa.int64(), *[pa.float64()] * 3]
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            plain = list(zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "low", "high", "piece"))))
            sums, sums_x = batch.column("w"), batch.column("wx")
            for i, (g, (count, mean, low, high, piece)) in enumerate(zip(names, plain)):
                if g != held:
                    close()
                    held, n, s, w, wx = g, 0, 0.0, None, None
                if low is not None:
                    out.append((*g, count, mean, low, high))
                    continue
                if w is None:
                    w, wx = np.zeros(replicates), np.zeros(replicates)
                n, s = n + count, s + mean
                w[piece : piece + PIECE] += sums[i].values.to_numpy()
                wx[piece : piece + PIECE] += sums_x[i].values.to_numpy()
            if out:
                yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [*keys, "n", "mean", "low", "high"])
                out = []
        close()
        if out:
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [*keys, "n", "mean", "low", "high"])

    return merge


def permutation_test(df: DataFrame, value: str, group: str, a, b, row_id: str, permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """(diff, n, p): how often a random split of the two groups' rows differs in its means as much as the groups do.

    Rows go by their hash to buckets of bounded size. How many rows of each bucket
    a permutation calls group ``a`` is drawn first, from the sizes of the buckets
    alone; each bucket then draws that many of its rows. Only a sum for each bucket
    and permutation is shuffled. Draws depend on the seed, row ids and values only.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select((F.col(group) == a).alias("a"), F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), F.col(row_id)).alias("h"))
    rows = saved(rows, "rows")
    real = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("a").cast("long")), F.lit(0)).alias("na"), F.sum("v").alias("s"), F.sum(F.when(F.col("a"), F.col("v"))).alias("sa")).first()
    n, na = real["n"], real["na"]
    if not 0 < na < n:
        return df.sparkSession.createDataFrame([(None, n, None)], "diff double, n long, p double")
    buckets = -(-n // BUCKET_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)))
    sizes = dict(tuple(r) for r in dealt.groupBy("bucket").count().collect())  # a row for each bucket
    order = sorted(sizes)
    drawn = np.random.default_rng(seed).multivariate_hypergeometric([sizes[k] for k in order], na, size=permutations, method="marginals")
    shared = df.sparkSession.sparkContext.broadcast({k: drawn[:, i] for i, k in enumerate(order)})

    def draw(key, table):
        bucket = key[0].as_py()
        place = np.lexsort((table["v"].to_numpy(), table["h"].to_numpy()))
        v = table["v"].to_numpy()[place]
        rng = np.random.default_rng((seed, bucket))
        sums = np.empty(permutations)
        for i, k in enumerate(shared.value[bucket].tolist()):
            sums[i] = v[rng.permutation(len(v))[:k]].sum() if 2 * k <= len(v) else v.sum() - v[rng.permutation(len(v))[: len(v) - k]].sum()
        return pa.table({"rep": np.arange(permutations), "sa": sums})

    sums = dealt.groupBy("bucket").applyInArrow(draw, "rep long, sa double").groupBy("rep").agg(F.sum("sa").alias("sa"))
    diff = real["sa"] / na - (real["s"] - real["sa"]) / (n - na)
    moved = F.col("sa") / na - (real["s"] - F.col("sa")) / (n - na)
    hit = (F.abs(moved) >= abs(diff) - 1e-12).cast("long")
    return sums.agg(F.lit(diff).alias("diff"), F.lit(n).cast("long").alias("n"), ((F.sum(hit) + 1) / (F.count("*") + 1)).alias("p"))


def jarque_bera(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, statistic, p): normality from skewness and kurtosis."""
    s = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"))
    out = s.withColumn("statistic", F.col("n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)).drop("_s", "_k")
    return out.withColumn("p", p_chi2(F.col("statistic"), F.lit(2.0)))


def choose_test(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """One row: normality and equal variances, the test they call for, its p-value, and whether pairs should be compared."""
    df = saved(df.select(value, group), "rows")
    normal = jarque_bera(df, value, group).agg(F.min("p").alias("least_normal_p"))
    equal = levene(df, value, group).select(F.col("p").alias("levene_p"))
    a, k = anova(df, value, group).select(F.col("p").alias("anova_p")), kruskal(df, value, group).select(F.col("p").alias("kruskal_p"))
    one = normal.crossJoin(equal).crossJoin(a).crossJoin(k)
    plain = (F.coalesce("least_normal_p", F.lit(1.0)) > alpha) & (F.col("levene_p") > alpha)
    one = one.withColumn("chosen", F.when(plain, "anova").otherwise("kruskal")).withColumn("p", F.when(plain, F.col("anova_p")).otherwise(F.col("kruskal_p")))
    return one.withColumn("compare_pairs", F.col("p") < alpha)


def chosen_pairs(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """(group_a, group_b, test, p, significant) of the post-hoc test that follows the chosen one: Tukey after ANOVA, Dunn by Holm after Kruskal-Wallis; no rows where that finds no difference."""
    df = saved(df.select(value, group), "rows")
    pairs = posthoc(df, value, group).crossJoin(F.broadcast(choose_test(df, value, group, alpha).select("chosen", "compare_pairs"))).where("compare_pairs")
    tukey = F.col("chosen") == "anova"
    out = pairs.select(f"{group}_a", f"{group}_b", F.when(tukey, "tukey").otherwise("dunn").alias("test"), F.when(tukey, F.col("tukey_p")).otherwise(F.col("dunn_p_holm")).alias("p"))
    return out.withColumn("significant", F.col("p") < alpha)
