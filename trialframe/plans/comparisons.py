"""Queries on group comparisons.

The SQL takes tail probabilities by Simpson's rule over the densities, each in a
variable in which it is smooth.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trialframe.functions.draws import exponential_sql, start_sql
from trialframe.operators import stats
from trialframe.operators.common import ZONE
from trialframe.plans.registry import query
from trialframe.plans.views import PLANTS, plants, r6, s6


def _integral(f: str, to: str, panels: int = 2000) -> str:
    """The integral of ``f``, an expression in s, from 0 to ``to``."""
    at = f"(i * ({to}) / {panels}.0)"
    weight = f"CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({to}) / {3 * panels}.0 * list_sum(list_transform(range(0, {panels + 1}), lambda i: {weight} * {f.replace('@s', at)})))"


def sql_normal(z: str) -> str:
    return f"(1 - {_integral('exp(-@s * @s / 2)', f'abs({z})')} * sqrt(2 / pi()))"


def sql_t(t: str, dof: str) -> str:
    front = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return f"(1 - 2 * {front} * {_integral(f'power(1 + @s * @s / {dof}, -({dof} + 1) / 2.0)', f'abs({t})')})"


def sql_chi2(x: str, dof: str) -> str:
    return f"(1 - 2 * exp(-lgamma({dof} / 2.0) - {dof} / 2.0 * ln(2)) * {_integral(f'power(@s, {dof} - 1) * exp(-@s * @s / 2)', f'sqrt({x})')})"


def sql_f(f: str, d1: str, d2: str) -> str:
    front = f"2 * power({d1} / CAST({d2} AS DOUBLE), {d1} / 2.0) * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
    return f"(1 - {front} * {_integral(f'power(@s, {d1} - 1) * power(1 + {d1} * @s * @s / {d2}, -({d1} + {d2}) / 2.0)', f'sqrt({f})')})"


def sql_range(k: str) -> str:
    """Tables for the studentised range of ``k`` means: ``curve`` has the probabilities that k normal values lie within 0, 1, 2, ... hundredths of each other.

    Sums over equal steps: what is summed is smooth and vanishes at both ends.
    """
    half_way = "exp(-power((i - 800.5) / 100.0, 2) / 2)"
    return f"""cells AS (SELECT i, exp(-power((i - 800) / 100.0, 2) / 2) / sqrt(2 * pi()) AS f, (exp(-power((i - 801) / 100.0, 2) / 2) + 4 * {half_way} + exp(-power((i - 800) / 100.0, 2) / 2)) / 600 / sqrt(2 * pi()) AS mass FROM range(1601) t(i)),
normal AS (SELECT i, f, sum(mass) OVER (ORDER BY i) AS below FROM cells),
spread AS (SELECT j, sum({k} * a.f * power(greatest(0, a.below - coalesce(b.below, 0)), {k} - 1)) / 100 AS r FROM normal a CROSS JOIN range(1, 1601) t(j) LEFT JOIN normal b ON b.i = a.i - j GROUP BY j),
curve AS (SELECT list_concat([CAST(0 AS DOUBLE)], list(r ORDER BY j)) AS c FROM spread)"""


def sql_p_range(q: str, dof: str) -> str:
    """The upper tail: the density of the root of a mean square, times ``curve`` between whose points a cubic goes through four."""
    density = f"exp({dof} / 2 * ln({dof}) + ({dof} - 1) * ln(s) - {dof} * s * s / 2 - lgamma({dof} / 2) - ({dof} / 2 - 1) * ln(2))"
    at = lambda k: f"coalesce(c[CAST(b AS BIGINT) + {k + 1}], 1)"
    cubic = f"({at(1)} * u * (u - 2) * (u - 3) / 2 - {at(2)} * u * (u - 1) * (u - 3) / 2 + {at(3)} * u * (u - 1) * (u - 2) / 6 - {at(0)} * (u - 1) * (u - 2) * (u - 3) / 6)"
    points = f"SELECT s, c, b, 100 * {q} * s - b AS u FROM (SELECT s, c, greatest(floor(100 * {q} * s) - 1, 0) AS b FROM (SELECT j / 200.0 AS s FROM range(1, 1201) n(j)), curve)"
    return f"(SELECT 1 - sum({density} / 200 * {cubic}) FROM ({points}))"


MOMENTS = f"{PLANTS}, g AS (SELECT agent, CAST(count(*) AS DOUBLE) AS n, avg(total) AS mean, var_samp(total) AS var FROM plants GROUP BY 1)"
_DOF = "power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1))"


@query(f"""WITH {MOMENTS}, w AS (SELECT a.agent AS agent_a, b.agent AS agent_b, a.mean - b.mean AS diff, (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS t, {_DOF} AS dof FROM g a JOIN g b ON a.agent < b.agent)
SELECT agent_a, agent_b, {', '.join(f'{s6(c)} AS {c}' for c in ('diff', 't', 'dof'))}, {s6(sql_t('t', 'dof'))} AS p FROM w""")
def welch_pairs(spark, sf_dir):
    w = stats.welch_pairs(plants(spark, sf_dir), "total", "agent")
    return w.select("agent_a", "agent_b", *[r6(c).alias(c) for c in ("diff", "t", "dof", "p")])


@query(f"""WITH {PLANTS}, p AS (SELECT experiment, zone, least(1.0, avg(abs(total))) / 100 AS p FROM plants GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, experiment, zone) AS k, count(*) OVER () AS m FROM p),
h AS (SELECT *, max(least(1.0, p * (m - k + 1))) OVER (ORDER BY p, experiment, zone) AS p_holm FROM r)
SELECT experiment, zone, {s6('p')} AS p, {s6('p_holm')} AS p_holm, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM h""")
def holm(spark, sf_dir):
    p = plants(spark, sf_dir).groupBy(*ZONE).agg((F.least(F.lit(1.0), F.avg(F.abs("total"))) / 100).alias("p"))
    return stats.holm(p, "p", tie=ZONE).select(*ZONE, r6("p").alias("p"), r6("p_holm").alias("p_holm"), stats.stars("p").alias("stars"))


ANOVA = f"""{MOMENTS}, t AS (SELECT sum(n * mean) / sum(n) AS grand FROM g), s AS (SELECT sum(n * power(mean - grand, 2)) AS b, sum(var * (n - 1)) AS w, count(*) - 1 AS db, CAST(sum(n) AS BIGINT) - count(*) AS dw FROM g, t)"""


@query(f"WITH {ANOVA} SELECT {s6('b')} AS ss_between, {s6('w')} AS ss_within, db AS df_between, dw AS df_within, {s6('(b / db) / (w / dw)')} AS f, {s6('b / (b + w)')} AS eta2, {s6(sql_f('(b / db) / (w / dw)', 'db', 'dw'))} AS p FROM s")
def anova(spark, sf_dir):
    a = stats.anova(plants(spark, sf_dir), "total", "agent")
    return a.select(r6("ss_between").alias("ss_between"), r6("ss_within").alias("ss_within"), "df_between", F.col("df_within").cast("long").alias("df_within"), r6("f").alias("f"), r6("eta2").alias("eta2"), r6("p").alias("p"))


@query(f"""WITH {MOMENTS}, w AS (SELECT *, n / var AS w FROM g), t AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(w) AS sw, sum(w * mean) / sum(w) AS grand FROM w),
s AS (SELECT k, sum(w * power(mean - grand, 2)) AS num, sum(power(1 - w / sw, 2) / (n - 1)) AS lam FROM w, t GROUP BY k),
x AS (SELECT (num / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * lam) AS f, k - 1 AS df1, (k * k - 1) / (3 * lam) AS df2 FROM s)
SELECT {s6('f')} AS f, df1, {s6('df2')} AS df2, {s6(sql_f('f', 'df1', 'df2'))} AS p FROM x""")
def welch_anova(spark, sf_dir):
    return stats.welch_anova(plants(spark, sf_dir), "total", "agent").select(r6("f").alias("f"), "df1", r6("df2").alias("df2"), r6("p").alias("p"))


@query(f"""WITH {MOMENTS}, w AS (SELECT *, n / var AS w FROM g), t AS (SELECT sum(w * mean) / sum(w) AS grand FROM w), x AS (SELECT (mean - grand) * sqrt(w) AS t, n - 1 AS v FROM w, t),
y AS (SELECT sqrt((v - 0.5) * ln(1 + t * t / v)) AS c, 48 * power(v - 0.5, 2) AS b FROM x),
z AS (SELECT c + (power(c, 3) + 3 * c) / b - (4 * power(c, 7) + 33 * power(c, 5) + 240 * power(c, 3) + 855 * c) / (10 * b * b + 8 * b * power(c, 4) + 1000 * b) AS z FROM y),
x2 AS (SELECT sum(z * z) AS statistic, count(*) - 1 AS dof FROM z) SELECT {s6('statistic')} AS statistic, dof, {s6(sql_chi2('statistic', 'dof'))} AS p FROM x2""")
def alexander_govern(spark, sf_dir):
    return stats.alexander_govern(plants(spark, sf_dir), "total", "agent").select(r6("statistic").alias("statistic"), "dof", r6("p").alias("p"))


@query(f"""WITH {PLANTS}, m AS (SELECT agent, median(total) AS m FROM plants GROUP BY 1), d AS (SELECT agent, abs(total - m) AS d FROM plants JOIN m USING (agent)),
g AS (SELECT agent, CAST(count(*) AS DOUBLE) AS n, avg(d) AS mean, var_samp(d) AS var FROM d GROUP BY 1), t AS (SELECT sum(n * mean) / sum(n) AS grand FROM g),
s AS (SELECT sum(n * power(mean - grand, 2)) AS b, sum(var * (n - 1)) AS w, count(*) - 1 AS db, sum(n) - count(*) AS dw FROM g, t) SELECT {s6('(b / db) / (w / dw)')} AS f, db AS df_between, CAST(dw AS BIGINT) AS df_within, {s6(sql_f('(b / db) / (w / dw)', 'db', 'dw'))} AS p FROM s""")
def levene(spark, sf_dir):
    return stats.levene(plants(spark, sf_dir), "total", "agent").select(r6("f").alias("f"), "df_between", F.col("df_within").cast("long").alias("df_within"), r6("p").alias("p"))


RANKS = f"""{PLANTS}, r AS (SELECT agent, total, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS r FROM plants), rs AS (SELECT agent, CAST(count(*) AS DOUBLE) AS n, sum(r) AS rs FROM r GROUP BY 1),
ties AS (SELECT CAST(sum(c) AS DOUBLE) AS n, sum(power(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM plants GROUP BY total))"""


@query(f"WITH {RANKS}, s AS (SELECT sum(rs * rs / n) AS s, count(*) - 1 AS dof FROM rs), x AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (power(n, 3) - n)) AS h, dof FROM s, ties) SELECT {s6('h')} AS h, dof, {s6(sql_chi2('h', 'dof'))} AS p FROM x")
def kruskal(spark, sf_dir):
    return stats.kruskal(plants(spark, sf_dir), "total", "agent").select(r6("h").alias("h"), "dof", r6("p").alias("p"))


@query(f"""WITH {PLANTS}, g AS (SELECT avg(total) AS g, sum(power(total, 2)) AS q, count(*) AS n FROM plants), o AS (SELECT agent, avg(total) AS m, count(*) AS n FROM plants GROUP BY 1), i AS (SELECT agent, zone, avg(total) AS m, count(*) AS n FROM plants GROUP BY 1, 2),
a AS (SELECT sum(o.n * power(o.m - g.g, 2)) AS so FROM o, g), b AS (SELECT sum(i.n * power(i.m - o.m, 2)) AS si FROM i JOIN o USING (agent)), t AS (SELECT sum(power(total - g.g, 2)) AS st FROM plants, g)
SELECT {s6('so')} AS ss_outer, {s6('si')} AS ss_inner, {s6('st - so - si')} AS ss_resid, {s6('st')} AS ss_total, {s6('so / st')} AS eta2_outer, {s6('si / st')} AS eta2_inner FROM a, b, t""")
def nested_ss(spark, sf_dir):
    n = stats.nested_ss(plants(spark, sf_dir), "total", "agent", "zone")
    return n.select(*[r6(c).alias(c) for c in ("ss_outer", "ss_inner", "ss_resid", "ss_total", "eta2_outer", "eta2_inner")])


#: With a factor of two levels, the model of both main effects is one slope within the other factor's levels.
_TWO_WAY = f"""{PLANTS}, x AS (SELECT agent, experiment % 2 AS half, total AS y FROM plants), m AS (SELECT *, avg(y) OVER (PARTITION BY agent) AS ya, avg(half) OVER (PARTITION BY agent) AS ha, avg(y) OVER (PARTITION BY half) AS yh, avg(y) OVER (PARTITION BY agent, half) AS yc, avg(y) OVER () AS yt FROM x),
q AS (SELECT sum(power(y - ya, 2)) AS ra, sum(power(y - yh, 2)) AS rh, sum(power(y - yc, 2)) AS rc, sum(power(y - yt, 2)) AS st, power(sum((y - ya) * (half - ha)), 2) / sum(power(half - ha, 2)) AS gain, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT agent) AS DOUBLE) AS na, CAST(count(DISTINCT (agent, half)) AS DOUBLE) AS nc FROM m),
terms AS (SELECT unnest(['agent', 'half', 'agent:half', 'residual']) AS term, unnest([rh - (ra - gain), gain, ra - gain - rc, rc]) AS ss, unnest([na - 1, 1, nc - na - 1, n - nc]) AS dof, st, rc, n - nc AS rest FROM q),
tested AS (SELECT *, CASE WHEN term <> 'residual' THEN (ss / dof) / (rc / rest) END AS f FROM terms)"""


@query(f"WITH {_TWO_WAY} SELECT term, {s6('ss')} AS ss, dof, {s6('f')} AS f, {s6('ss / st')} AS eta2, CASE WHEN f IS NOT NULL THEN {s6(sql_f('f', 'dof', 'rest'))} END AS p FROM tested")
def two_way(spark, sf_dir):
    t = stats.two_way(plants(spark, sf_dir).withColumn("half", F.col("experiment") % 2), "total", "agent", "half")
    return t.select("term", r6("ss").alias("ss"), "dof", *[r6(c).alias(c) for c in ("f", "eta2", "p")])


@query(f"""WITH {PLANTS}, r AS (SELECT total, energy, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS a, rank() OVER (ORDER BY energy) + (count(*) OVER (PARTITION BY energy) - 1) / 2.0 AS b FROM plants),
c AS (SELECT count(*) AS n, corr(total, energy) AS r, corr(a, b) AS s FROM r)
SELECT n, {s6('r')} AS pearson, {s6('s')} AS spearman, {s6(sql_t('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'))} AS pearson_p FROM c""")
def correlation(spark, sf_dir):
    return stats.correlation(plants(spark, sf_dir), "total", "energy").select("n", *[r6(c).alias(c) for c in ("pearson", "spearman", "pearson_p")])


SLOPES = f"{PLANTS}, k AS (SELECT agent, sum(initial * final) / sum(initial * initial) AS k, count(*) AS n, var_pop(final) * count(*) AS tot FROM plants GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {SLOPES} SELECT agent, {s6('k.k')} AS k, {s6('1 - sum(power(final - k.k * initial, 2)) / any_value(k.tot)')} AS r2, any_value(k.n) AS n FROM plants JOIN k USING (agent) GROUP BY agent, k.k")
def origin_slope(spark, sf_dir):
    return stats.origin_slope(plants(spark, sf_dir), "initial", "final", ("agent",)).select("agent", r6("k").alias("k"), r6("r2").alias("r2"), "n")


@query(f"WITH {SLOPES} SELECT plant_id, {s6('final - k.k * initial')} AS residual FROM plants JOIN k USING (agent)")
def residuals(spark, sf_dir):
    return stats.residuals(plants(spark, sf_dir), "initial", "final", ("agent",)).select("plant_id", r6("residual").alias("residual"))


@query(f"""WITH {MOMENTS}, {sql_range('(SELECT count(*) FROM g)')}, w AS (SELECT a.agent AS agent_a, b.agent AS agent_b, a.mean - b.mean AS diff, sqrt((a.var / a.n + b.var / b.n) / 2) AS se, abs(a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS t, {_DOF} AS dof FROM g a JOIN g b ON a.agent < b.agent)
SELECT agent_a, agent_b, {', '.join(f'{s6(c)} AS {c}' for c in ('diff', 'se', 't', 'dof'))}, {s6(sql_p_range('(t * sqrt(2))', 'dof'))} AS p FROM w""")
def games_howell(spark, sf_dir):
    g = stats.games_howell(plants(spark, sf_dir), "total", "agent")
    return g.select("agent_a", "agent_b", *[r6(c).alias(c) for c in ("diff", "se", "t", "dof", "p")])


POSTHOC = f"""{RANKS}, g AS (SELECT agent, CAST(count(*) AS DOUBLE) AS n, avg(total) AS mean, var_samp(total) AS var FROM plants GROUP BY 1), p AS (SELECT sum(var * (n - 1)) / sum(n - 1) AS mse FROM g), x AS (SELECT g.*, rs.rs FROM g JOIN rs USING (agent)),
u AS (SELECT a.agent AS agent_a, b.agent AS agent_b, sum(CASE WHEN a.total > b.total THEN 1.0 WHEN a.total = b.total THEN 0.5 ELSE 0.0 END) AS u FROM plants a JOIN plants b ON a.agent < b.agent GROUP BY 1, 2),
pt AS (SELECT agent_a, agent_b, sum(power(c, 3) - c) AS t FROM (SELECT u.agent_a, u.agent_b, total, count(*) AS c FROM u JOIN plants ON agent IN (u.agent_a, u.agent_b) GROUP BY 1, 2, 3) GROUP BY 1, 2),
y AS (SELECT a.agent AS agent_a, b.agent AS agent_b, abs(a.mean - b.mean) / sqrt(p.mse / 2 * (1 / a.n + 1 / b.n)) AS tukey_q, (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS tamhane_t, {_DOF} AS tamhane_dof,
(a.rs / a.n - b.rs / b.n) / sqrt((ties.n * (ties.n + 1) / 12 - ties.t / (12 * (ties.n - 1))) * (1 / a.n + 1 / b.n)) AS dunn_z, u.u AS mw_u,
(greatest(u.u, a.n * b.n - u.u) - a.n * b.n / 2 - 0.5) / sqrt(a.n * b.n / 12 * (a.n + b.n + 1 - pt.t / ((a.n + b.n) * (a.n + b.n - 1)))) AS mw_z
FROM x a JOIN x b ON a.agent < b.agent CROSS JOIN p CROSS JOIN ties JOIN u ON u.agent_a = a.agent AND u.agent_b = b.agent JOIN pt ON pt.agent_a = a.agent AND pt.agent_b = b.agent),
ps AS (SELECT *, count(*) OVER () AS m, {sql_t('tamhane_t', 'tamhane_dof')} AS tp, {sql_normal('dunn_z')} AS dunn_p, CASE WHEN mw_z > 0 THEN least(1.0, {sql_normal('mw_z')}) ELSE 1.0 END AS mw_p FROM y),
ranked AS (SELECT *, row_number() OVER (ORDER BY dunn_p, agent_a, agent_b) AS k FROM ps),
pairs AS (SELECT *, 1 - power(1 - tp, m) AS tamhane_p, max(least(1.0, dunn_p * (m - k + 1))) OVER (ORDER BY dunn_p, agent_a, agent_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dunn_p_holm, least(1.0, mw_p * m) AS mw_p_bonferroni FROM ranked)"""
_POSTHOC = ("tukey_q", "tamhane_t", "tamhane_dof", "tamhane_p", "dunn_z", "dunn_p", "dunn_p_holm", "mw_u", "mw_p", "mw_p_bonferroni")


@query(f"""WITH {POSTHOC}, {sql_range('(SELECT count(*) FROM g)')}, left_over AS (SELECT sum(n - 1) AS dfw FROM g) SELECT agent_a, agent_b, {', '.join(f'{s6(c)} AS {c}' for c in _POSTHOC)}, {s6(sql_p_range('tukey_q', 'dfw'))} AS tukey_p FROM pairs CROSS JOIN left_over""")
def posthoc(spark, sf_dir):
    return stats.posthoc(plants(spark, sf_dir), "total", "agent").select("agent_a", "agent_b", *[r6(c).alias(c) for c in (*_POSTHOC, "tukey_p")])


#: Means of all agents under each of the replicates' weights, and the interval that holds 95 of 100.
_RESAMPLED = f"""states AS (SELECT agent, total, {start_sql('plant_id')} AS start FROM plants), replicates AS (SELECT agent, r, sum(w * total) / sum(w) AS m FROM (SELECT agent, total, r, {exponential_sql('start', 'r')} AS w FROM states, range(10000) t(r)) GROUP BY 1, 2),
intervals AS (SELECT agent, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM replicates GROUP BY 1), sizes AS (SELECT agent, count(*) AS n, avg(total) AS mean FROM plants GROUP BY 1)"""


@query(f"WITH {PLANTS}, {_RESAMPLED} SELECT agent, n, {s6('mean')} AS mean, {s6('low')} AS low, {s6('high')} AS high FROM sizes JOIN intervals USING (agent)")
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap_ci(plants(spark, sf_dir), "total", ("agent",), "plant_id", 10_000).select("agent", "n", *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {PLANTS}, {_RESAMPLED}, q AS (SELECT agent, quantile_cont(total, 0.1) AS a, quantile_cont(total, 0.99) AS b FROM plants GROUP BY 1),
t AS (SELECT agent, avg(total) FILTER (total BETWEEN a AND b) AS trimmed_mean, count(*) FILTER (total BETWEEN a AND b) AS n_inside, avg(energy) AS energy FROM plants JOIN q USING (agent) GROUP BY 1)
SELECT agent, {s6('trimmed_mean')} AS trimmed_mean, n_inside, n, {s6('low')} AS low, {s6('high')} AS high, {s6('energy')} AS energy FROM t JOIN sizes USING (agent) JOIN intervals USING (agent)""")
def policy_summary(spark, sf_dir):
    from trialframe.operators.quality import trimmed_mean

    p = plants(spark, sf_dir)
    t = trimmed_mean(p, "total", ("agent",), 0.1, 0.99)
    whole = t.join(stats.bootstrap_ci(p, "total", ("agent",), "plant_id", 10_000).drop("n", "mean"), "agent").join(p.groupBy("agent").agg(F.avg("energy").alias("energy")), "agent")
    return whole.select("agent", r6("trimmed_mean").alias("trimmed_mean"), "n_inside", "n", *[r6(c).alias(c) for c in ("low", "high", "energy")])


@query()
def permutation(spark, sf_dir):
    return stats.permutation_test(plants(spark, sf_dir), "total", "agent", "Constant", "Ramp", "plant_id", 10_000)


@query()
def huber(spark, sf_dir):
    p = plants(spark, sf_dir)
    model = stats.huber_fit(p, ("initial",), "final")
    return model.transform(p.select("plant_id", array_to_vector(F.array("initial")).alias("features"))).select("plant_id", "prediction")


@query()
def huber_origin(spark, sf_dir):
    p = plants(spark, sf_dir)
    model = stats.huber_fit(p, ("initial",), "final", intercept=False)
    return model.transform(p.select("plant_id", array_to_vector(F.array("initial")).alias("features"))).select("plant_id", "prediction")


def _chosen(alpha: float) -> str:
    return f"""{RANKS}, mm AS (SELECT agent, avg(total) AS m, count(*) AS n FROM plants GROUP BY 1), jb AS (SELECT agent, any_value(mm.n) AS n, avg(power(total - m, 2)) AS m2, avg(power(total - m, 3)) AS m3, avg(power(total - m, 4)) AS m4 FROM plants JOIN mm USING (agent) GROUP BY 1),
np AS (SELECT min(exp(-n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) / 2)) AS p FROM jb),
md AS (SELECT agent, median(total) AS med FROM plants GROUP BY 1), dv AS (SELECT agent, total AS v, abs(total - med) AS d FROM plants JOIN md USING (agent)),
lg AS (SELECT agent, CAST(count(*) AS DOUBLE) AS n, avg(d) AS dm, var_samp(d) AS dvar, avg(v) AS vm, var_samp(v) AS vvar FROM dv GROUP BY 1), lt AS (SELECT sum(n * dm) / sum(n) AS dg, sum(n * vm) / sum(n) AS vg FROM lg),
lf AS (SELECT count(*) - 1 AS db, sum(n) - count(*) AS dw, sum(n * power(dm - dg, 2)) AS bd, sum(dvar * (n - 1)) AS wd, sum(n * power(vm - vg, 2)) AS bv, sum(vvar * (n - 1)) AS wv FROM lg, lt),
kh AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (power(n, 3) - n)) AS h, dof FROM (SELECT sum(rs * rs / n) AS s, count(*) - 1 AS dof FROM rs), ties),
tests AS (SELECT np.p AS least_normal_p, {sql_f('(bd / db) / (wd / dw)', 'db', 'dw')} AS levene_p, {sql_f('(bv / db) / (wv / dw)', 'db', 'dw')} AS anova_p, {sql_chi2('h', 'dof')} AS kruskal_p FROM np, lf, kh),
chosen AS (SELECT *, CASE WHEN least_normal_p > {alpha} AND levene_p > {alpha} THEN 'anova' ELSE 'kruskal' END AS chosen, CASE WHEN least_normal_p > {alpha} AND levene_p > {alpha} THEN anova_p ELSE kruskal_p END AS p FROM tests)"""


_TESTS = ("least_normal_p", "levene_p", "anova_p", "kruskal_p", "p")


@query(f"WITH {_chosen(0.05)} SELECT {', '.join(f'{s6(c)} AS {c}' for c in _TESTS)}, chosen, p < 0.05 AS compare_pairs FROM chosen")
def test_report(spark, sf_dir):
    return stats.choose_test(plants(spark, sf_dir), "total", "agent").select(*[r6(c).alias(c) for c in _TESTS], "chosen", "compare_pairs")


@query(f"WITH {POSTHOC}, {_chosen(0.9).removeprefix(RANKS + ', ')} SELECT agent_a, agent_b, 'dunn' AS test, {s6('dunn_p_holm')} AS p, dunn_p_holm < 0.9 AS significant FROM pairs CROSS JOIN chosen WHERE chosen.p < 0.9 AND chosen.chosen = 'kruskal'")
def chosen_pairs(spark, sf_dir):
    # at this level the data differ; plants of no group are normal, so the pairs are Dunn's
    found = stats.chosen_pairs(plants(spark, sf_dir), "total", "agent", 0.9)
    return found.select("agent_a", "agent_b", "test", r6("p").alias("p"), "significant")
