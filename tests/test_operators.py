import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialframe.functions import special
from trialframe.functions.draws import exponentials
from trialframe.operators import attributes, clean, features, labels, light, order, quality, running, splits, stats, trajectory
from trialframe.operators.common import CHANNELS
from trialframe.sources import scratch

ONE = datetime(2024, 1, 1, 9)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- running values


def series(seed, n=400):
    """(key, time, x, y) rows, one a key and time; one key has most of them."""
    r = random.Random(seed)
    rows = {(r.choice([None, 1, 2, 3, 3, 3, 3, 3, 3]), ONE + timedelta(minutes=r.randrange(2000))): (r.choice([None, r.random()]), r.choice([None, None, 5.0, r.random()])) for _ in range(n)}
    return [(k, t, x, y) for (k, t), (x, y) in rows.items()]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 60), (4, 200)])
def test_runs_hand_on_what_they_end_with(spark, seed, parts):
    rows = series(seed)
    df = frame(spark, rows, "k int, t timestamp, x double, y double").repartition(5)
    got = {(r.k, r.t): (r.x, r.y) for r in running.fill_along(df, ("k",), ("t",), ("x", "y"), parts).collect()}
    made = {"a": ("x", 0.5), "b": ("x", 0.9), "c": ("y", 0.7)}
    traces = {(r.k, r.t): (r.a, r.b, r.c) for r in running.decayed_sums(df, ("k",), "t", made, parts).collect()}
    assert len(got) == len(traces) == len(rows)
    for key in {k for k, *_ in rows}:
        last, past = [None, None], []
        for _, t, x, y in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            for name, (value, beta) in made.items():
                column = [p["xy".index(value)] for p in past]
                weights = [(beta**i, v) for i, v in enumerate(reversed(column)) if v is not None]
                want = sum(w * v for w, v in weights) / sum(w for w, _ in weights) if column and column[-1] is not None else 0.0
                assert traces[key, t]["abc".index(name)] == pytest.approx(want)
            past.append((x, y))
            last = [v if v is not None else old for v, old in zip((x, y), last)]
            assert got[key, t] == tuple(last)


def test_large_keys_are_cut(spark, monkeypatch):
    rows = series(9)
    df = frame(spark, rows, "k int, t timestamp, x double, y double")
    right = df.where("y is not null").select("k", F.col("t").alias("u"), "y")
    left = df.where("x is not null").select("k", "t", "x").unionAll(df.limit(1).select("k", "t", "x"))
    join = lambda: sorted(map(str, attributes.asof_join(left, right, ("k",), "t", "u", ("y",), tolerance_micros=3_600_000_000).collect()))
    fill = lambda: sorted(map(str, clean.forward_fill(df, ("x", "y"), ("k",), "t").collect()))
    plain = join(), fill()
    cut, fill_along = [], running.fill_along
    monkeypatch.setattr(running, "LARGE_KEY", 50)
    for module in (attributes, clean):
        monkeypatch.setattr(module, "fill_along", lambda *a: cut.append(a[1]) or fill_along(*a, parts=40))
    assert (join(), fill()) == plain and cut == [("k",), ("k",)]


# -- light

ACTION = "action_0 double, action_1 double, action_2 double, action_3 double, action_4 double, action_5 double"


def test_basis_vectors_and_mixes(spark):
    r, w, b = (np.array(light.BASIS[n]) for n in ("red_coef", "white_coef", "blue_coef"))
    wanted = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0.5, 0.5, 0), (0.3, 0.3, 0.4), (0, 0, 0)]
    rows = [tuple(float(x) for x in a * r + c * w + d * b) for a, c, d in wanted]
    got = light.action_coefficients(frame(spark, rows, ACTION)).select("red_coef", "white_coef", "blue_coef").collect()
    assert np.allclose([list(x) for x in got], wanted, atol=1e-10)
    back = [np.array(x) @ np.stack((r, w, b)) for x in got]
    assert np.allclose(back, rows, atol=1e-8)


def test_null_channel_gives_null(spark):
    got = light.action_coefficients(frame(spark, [(None, 1.0, 1.0, 1.0, 1.0, 1.0)], ACTION)).first()
    assert got["red_coef"] is None


def test_trace_is_the_recurrence_within_a_zone(spark):
    r = random.Random(1)
    rows = [(1, z, ONE + timedelta(hours=i), r.random() if r.random() > 0.2 else None) for z in (1, 2) for i in range(40)]
    got = light.action_traces(frame(spark, rows, "experiment int, zone int, time timestamp, x double"), ("x",), (0.5, 0.9)).collect()
    have = {(g["zone"], g["time"]): g for g in got}
    for beta in (0.5, 0.9):
        for z in (1, 2):
            n = d = 0.0
            last = None
            for _, _, t, x in (q for q in rows if q[1] == z):
                want = n / d if d and last is not None else 0.0
                assert have[z, t][f"x_trace_{beta:g}"] == pytest.approx(want, abs=1e-9)
                n, d, last = n * beta + (x or 0.0), d * beta + (x is not None), x


def test_plants_of_a_zone_share_a_trace(spark):
    rows = [(1, 1, p, ONE + timedelta(hours=i), float(i)) for i in range(4) for p in (1, 2)]
    got = light.action_traces(frame(spark, rows, "experiment int, zone int, plant_id int, time timestamp, x double"), ("x",), (0.5,)).collect()
    assert len(got) == 8 and len({(g["time"], g["x_trace_0.5"]) for g in got}) == 4


# -- attributes


def test_agents(spark):
    want = {(11, 1): "Uniform_Discrete", (13, 1): "Uniform_Dirichlet", (14, 1): "Constant_White", (14, 2): "InAC_Data_Det", (14, 8): "InAC_GP_Det_Opt0", (14, 7): "Other", (15, 2): "InAC_2", (15, 4): "InAC_4", (99, 1): "Other", (18, 11): "Constant"}
    want |= {(16, z): ("Constant_White", "InAC_Seed7", "InAC_Seed6", "InAC_Seed21")[(z - 1) % 4] for z in range(1, 13)}
    got = attributes.map_agents(frame(spark, list(want), "experiment long, zone long"), attributes.agent_table(spark)).collect()
    assert {(r["experiment"], r["zone"]): r["agent"] for r in got} == want


def test_days_since(spark):
    row = [(datetime(2025, 6, 29, 10), date(2025, 6, 16), date(2025, 6, 19), date(2025, 6, 27), date(2025, 6, 30))]
    df = frame(spark, row, "time timestamp, sterilized_date date, plate_date date, transplant_date date, remove_domes_date date")
    got = attributes.days_since(df, {"a": "sterilized_date", "b": "plate_date", "c": "transplant_date", "d": "remove_domes_date", "e": "absent"}).first()
    assert [got[k] for k in "abcde"] == [13, 10, 2, -1, None]


def test_watering(spark):
    rows = [(11, datetime(2025, 8, d, 12)) for d in (14, 15, 17, 19)] + [(999, datetime(2025, 8, 17))]
    water = [(11, date(2025, 8, 15), 1 / 18), (11, date(2025, 8, 18), 2 / 18)]
    df = frame(spark, rows, "experiment int, time timestamp").withColumn("d", F.to_date("time"))
    got = attributes.asof_join(df, frame(spark, water, "experiment int, at date, liters double"), ("experiment",), "d", "at", ("liters",)).orderBy("experiment", "time").collect()
    assert [r["liters"] for r in got] == [None, 1 / 18, 1 / 18, 2 / 18, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20)), max_size=12))
def test_asof_is_the_naive_scan(spark, left, right):
    base = datetime(2024, 1, 1)
    ls = [(k, i, base + timedelta(minutes=t)) for i, (k, t) in enumerate(left)]
    rs = [(k, 100 + i, base + timedelta(minutes=t)) for i, (k, t) in enumerate(right)]
    got = attributes.asof_join(frame(spark, ls, "k int, i int, t timestamp"), frame(spark, rs, "k int, j int, u timestamp"), ("k",), "t", "u", ("j",), tolerance_micros=5 * 60_000_000).collect()
    for r in got:
        before = [(u, j) for k, j, u in rs if k == r["k"] and u <= r["t"]]
        want = max(before)[1] if before and r["t"] - max(before)[0] <= timedelta(minutes=5) else None
        assert r["j"] == want
    assert len(got) == len(ls)


def test_daylight_saving_is_no_gap(spark):
    times = [datetime(2026, 3, 7, 15), datetime(2026, 3, 8, 15), datetime(2026, 3, 9, 15), datetime(2026, 3, 11, 15)]
    df = frame(spark, [(1, 1, 1, t, 1.0 + i) for i, t in enumerate(times)], "experiment int, zone int, plant_id int, time timestamp, log_clean_area double")
    got = trajectory.truncated_daily(trajectory.daily_reward(df)).orderBy("time").collect()
    assert [r["reward"] for r in got] == [None, 1.0, 1.0, None] and [r["truncated"] for r in got] == [False, False, True, False]
    local = clean.to_local(df).orderBy("time").collect()
    assert [r["local_time"].hour for r in local] == [8, 9, 9, 9]


# -- trajectories

STEP = "experiment int, zone int, plant_id int, time timestamp, log_clean_area double, bolted_pred boolean"


def test_step_reward(spark):
    rows = [(1, 1, p, ONE + timedelta(days=i), v, False) for p, vs in ((0, (1.0, 1.2, 1.5)), (1, (2.0, 2.4, 3.0))) for i, v in enumerate(vs)] + [(1, 1, 2, ONE, 1.0, False), (1, 1, 2, ONE + timedelta(days=1), 2.0, True)]
    got = trajectory.step_reward(frame(spark, rows, STEP)).orderBy("plant_id", "time").collect()
    assert [round(r["reward"], 9) for r in got] == [0, 0.2, 0.3, 0, 0.4, 0.6, 0, 0]
    assert trajectory.step_reward(frame(spark, rows, STEP), null_first=True).where("reward is null").count() == 3


def test_area(spark):
    rows = [(1, 1, ONE, 100.0), (1, 1, ONE, 200.0), (1, 1, ONE + timedelta(hours=1), 0.0), (1, 1, ONE + timedelta(hours=1), 400.0)]
    df = frame(spark, rows, "experiment int, zone int, time timestamp, clean_area double")
    assert sorted(r["mean_clean_area"] for r in trajectory.mean_area(df).collect()) == [150, 150, 200, 200]
    logs = {r["clean_area"]: r["log_clean_area"] for r in trajectory.log_area(df).collect()}
    assert logs[0.0] is None and logs[100.0] == pytest.approx(4.60517018599)
    assert trajectory.log_area(df.withColumnRenamed("clean_area", "area")).where("log_clean_area is null").count() == 1


def stepper(rows):
    """Transitions of one plant, one row after another."""
    out, i, episode, done = [], 0, 0, False
    while i + 1 < len(rows) and not done:
        _, reward, term, trunc = rows[i]
        last = i + 2 >= len(rows)
        out.append((i, rows[i + 1][1] or 0.0, bool(term), bool(trunc) or (last and not term), episode))
        done = bool(term)
        episode += bool(trunc)
        i += 1
    return out


def test_transitions_equal_a_stepper(spark):
    r = random.Random(4)
    plants = {p: [(i, r.choice((None, r.random())), r.choice((None, False, False, False, r.random() < 0.3)), r.choice((None, False, False, True))) for i in range(r.randint(1, 9))] for p in range(120)}
    rows = [(1, 1, p, ONE + timedelta(days=i), rw, t, c, float(i)) for p, rs in plants.items() for i, rw, t, c in rs]
    df = frame(spark, rows, "experiment int, zone int, plant_id int, time timestamp, reward double, terminal boolean, truncated boolean, clean_area double")
    got = {}
    for x in trajectory.build_transitions(df).orderBy("plant_id", "time").collect():
        got.setdefault(x["plant_id"], []).append((int(x["clean_area"]), x["step_reward"], x["terminal"], x["truncated"], x["episode"]))
    assert got == {p: s for p, rs in plants.items() if (s := stepper(rs))}


def test_pareto_equals_the_scan(spark):
    r = random.Random(9)
    rows = [(i, float(r.randint(0, 30)) / 4, float(r.randint(0, 30))) for i in range(80)]
    got = {x["i"] for x in trajectory.pareto_frontier(frame(spark, rows, "i int, x double, y double"), "x", "y", "i").collect()}
    best, want = -math.inf, set()
    for i, x, y in sorted(rows, key=lambda q: (q[1], -q[2], q[0])):
        if y > best:
            want.add(i)
            best = y
    assert got == want


def test_unknown_cadence_is_an_error(spark):
    with pytest.raises(ValueError):
        clean.subsample(frame(spark, [(ONE,)], "time timestamp"), "weekly")


def test_imaging_gaps(spark):
    rows = [(1, 1, p, datetime(2024, 1, d, h), d, f"h{d if d != 3 else 2}{p}", 120.0) for p in (1, 2) for d in (1, 2, 3) for h in (9, 13)]
    got = clean.imaging_gaps(clean.mark_repeated_images(frame(spark, rows, "experiment int, zone int, plant_id int, time timestamp, day int, image_hash string, brightness double"))).collect()
    assert {(r["day"], r["time"].hour) for r in got if r["imaging_gap"]} == {(3, 9)} and len(got) == 10


# -- quality, features


@pytest.mark.parametrize("n", [1, 2, 3, 4, 57, 200])
def test_nearest_rank(spark, n):
    r = random.Random(n)
    v = [r.uniform(-5, 5) if r.random() > 0.2 else 1.5 for _ in range(n)]
    df = frame(spark, [(x,) for x in v] + [(None,)], "v double")
    for q in (0.01, 0.5, 0.99):
        assert quality.nearest_ranks(df, "v", q=q).first()["q"] == sorted(v)[math.floor(q * (n - 1) + 0.5)]


def test_iqr_and_finite(spark):
    df = frame(spark, [("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 1.0), ("b", 99.0)], "g string, v double")
    assert sorted(r["v"] for r in quality.iqr_filter(df, "v", ("g",)).collect()) == [1, 1, 2, 3, 4, 99]
    bad = frame(spark, [(float("nan"), [1.0]), (1.0, [float("inf"), 2.0]), (None, None)], "x double, a array<double>")
    assert {r[0]: r[1] for r in quality.finite_check(bad, ("x",), ("a",)).collect()} == {"x": 1, "a": 1}
    assert [r["s"] for r in quality.minmax_scale(frame(spark, [(2.0,), (2.0,)], "v double"), "v", "s").collect()] == [0.5, 0.5]


def test_pca_reconstructs(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 3)) @ r.normal(size=(3, 8)) + 5
    df = frame(spark, [(i, [float(c) for c in row]) for i, row in enumerate(x)], "i int, a array<double>")
    models = features.fit_pca(df, "a", 3)
    got = np.array([q["pca"] for q in features.pca_project(df, "a", models).orderBy("i").collect()])
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    ratio = [q["ratio"] for q in features.pca_variance(df, models).orderBy("component").collect()]
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:3])


def test_stats_of_features(spark):
    df = frame(spark, [(1, float("nan"), [1.0, 2.0]), (3, 2.0, [3.0, 2.0]), (None, 4.0, None)], "a int, b double, v array<double>").withColumn("s", F.lit("x"))
    got = {r["metric"]: r for r in features.norm_stats(df, ("a", "b", "s", "absent")).collect()}
    assert set(got) == {"a", "b"} and got["b"]["mean"] == 3 and got["a"]["std"] == pytest.approx(math.sqrt(2))
    v = features.vector_stats(df, "v").orderBy("dim").collect()
    assert [r["std"] for r in v] == [1.0, 0.0]
    z = features.standardise(df, "v", features.vector_stats(df, "v")).where("v is not null").orderBy("a").collect()
    assert z[0]["standardised"] == [-1.0, 0.0]


def test_score_rows(spark):
    df = frame(spark, [([1.0, 2.0],), (None,)], "v array<double>")
    got = features.score_rows(df, "v", lambda m: m.sum(axis=1) / 10).collect()
    assert [r["bolted_prob"] for r in got] == [pytest.approx(0.3), None]


# -- labels, splits


def test_key_codec_round_trip(spark):
    df = frame(spark, [(11, 2, 3, ONE)], "experiment long, zone long, plant_id long, time timestamp")
    name = df.select(labels.encode_key().alias("name"))
    back = labels.decode_key(name, "name").first()
    assert (back["experiment"], back["zone"], back["plant_id"], back["time"]) == (11, 2, 3, ONE)
    assert labels.decode_key(frame(spark, [("a_b",), (None,)], "name string"), "name").where("time is null and zone is null").count() == 2


def test_repeated_labels_do_not_repeat_rows(spark):
    df = frame(spark, [(1, 5), (2, 6)], "k int, old int")
    lab = frame(spark, [(1, 9), (1, 8)], "k int, old int")
    assert sorted((r["k"], r["old"]) for r in labels.merge_labels(df, lab, ("k",)).collect()) == [(1, 8), (2, 6)]


def test_folds_keep_groups_whole(spark):
    df = frame(spark, [(g, i) for g in range(9) for i in range(g + 1)], "g int, i int")
    got = splits.group_folds(df, ("g",)).collect()
    load = [sum(r["n"] for r in got if r["fold"] == f) for f in range(5)]
    assert len(got) == 9 and max(load) - min(load) <= 9 and sum(load) == 45
    assert splits.group_folds(df.where("g < 3"), ("g",)).count() == 0


def test_samples(spark):
    df = spark.range(200)
    a = {r[0] for r in splits.hash_sample(df, ("id",), 50, 1).collect()}
    assert len(a) == 50 and a == {r[0] for r in splits.hash_sample(df.repartition(7), ("id",), 50, 1).collect()}
    t = {r[0] for r in splits.target_sample(df, F.col("id") < 30, ("id",), 50).collect()}
    assert len(t) == 50 and set(range(30)) <= t


# -- statistics


def test_tail_probabilities():
    # tabulated values
    assert special.t_two_sided([2.228, 12.706, 0.0], [10, 1, 5]) == pytest.approx([0.05, 0.05, 1.0], abs=2e-4)
    assert special.f_upper([4.256, 3.49, 0.0], [2, 3, 2], [9, 12, 9]) == pytest.approx([0.05, 0.05, 1.0], abs=2e-4)
    assert special.chi2_upper([3.841, 18.307, 0.0], [1, 10, 3]) == pytest.approx([0.05, 0.05, 1.0], abs=2e-4)
    assert special.normal_two_sided([1.959964, 0.0]) == pytest.approx([0.05, 1.0], abs=1e-6)
    assert special.studentised_range_upper([3.877, 4.327, 3.014], [3, 4, 2], [10, 10, 15]) == pytest.approx([0.05, 0.05, 0.05], abs=1e-3)


def groups(spark, seed=0, n=30):
    r = np.random.default_rng(seed)
    kinds = (("a", 0, 1), ("b", 0.4, 1.5), ("c", 1.2, 0.8))
    rows = [(k * n + i, g, float(np.round(r.normal(m, s), 3))) for k, (g, m, s) in enumerate(kinds) for i in range(n)]
    return rows, frame(spark, rows, "i int, g string, v double")


def test_group_tests_against_numpy(spark):
    rows, df = groups(spark)
    v = {g: np.array([x for _, h, x in rows if h == g]) for g in "abc"}
    for r in stats.welch_pairs(df, "v", "g").collect():
        a, b = v[r["g_a"]], v[r["g_b"]]
        assert r["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)))
        assert 0 <= r["p"] <= 1
    f = stats.anova(df, "v", "g").first()
    every = np.concatenate(list(v.values()))
    between = sum(len(x) * (x.mean() - every.mean()) ** 2 for x in v.values())
    assert f["ss_between"] == pytest.approx(between) and f["ss_between"] + f["ss_within"] == pytest.approx(((every - every.mean()) ** 2).sum())
    assert stats.choose_test(df, "v", "g").first()["chosen"] in ("anova", "kruskal")
    assert stats.two_way(df.withColumn("h", F.col("i") % 2), "v", "g", "h").count() == 4


def test_ranks_and_mann_whitney(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 4.0), ("b", None)], "g string, v double")
    sums, ties = stats.rank_sums(df, "v", "g")
    assert {r["g"]: r["rank_sum"] for r in sums.collect()} == {"a": 3.5, "b": 6.5} and tuple(ties.first()) == (4, 6)
    assert stats.mann_whitney(df, "v", "g", "a", "b").first()["u"] == 0.5


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_holm_is_monotone(spark, ps):
    got = stats.holm(frame(spark, [(i, p) for i, p in enumerate(ps)], "i int, p double"), "p", tie=("i",)).orderBy("p", "i").collect()
    adjusted = [r["p_holm"] for r in got]
    assert adjusted == sorted(adjusted) and all(r["p"] <= r["p_holm"] <= 1 for r in got)


@pytest.mark.parametrize("large,ranges", [(1 << 20, 256), (5, 4), (0, 2), (50, 256)])
def test_quantiles_of_groups_of_any_size(spark, monkeypatch, large, ranges):
    monkeypatch.setattr(order, "RANGES", ranges)
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([1, None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(3)), None])) for _ in range(700)]
    rows += [("one", 1, 2.5), ("same", 1, 3.0), ("same", 1, 3.0), ("nan", 2, float("nan")), ("nan", 2, 1.0), ("none", 3, None)]
    df = frame(spark, rows, "g string, h int, v double").repartition(6)
    quantiles = {"q0": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "x": 0.975, "q10": 1.0}
    got = {(r.g, r.h): [r[n] for n in quantiles] for r in order.group_quantiles(df, "v", ("g", "h"), quantiles, large).collect()}
    want = df.where("v is not null").groupBy("g", "h").agg(F.percentile("v", F.array(*map(F.lit, quantiles.values()))).alias("q")).collect()
    assert {k: str(v) for k, v in got.items()} == {(r.g, r.h): str(r.q) for r in want}
    whole = order.group_quantiles(df.where("v is not null and not isnan(v)"), "v", (), quantiles, large).first()
    assert [whole[n] for n in quantiles] == pytest.approx(np.quantile([v for _, _, v in rows if v is not None and v == v], list(quantiles.values())))


def test_a_large_group_is_held_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "LARGE_GROUP", 1000)
    df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.xxhash64("id").cast("double").alias("v"), F.lit(5.0).alias("same"))
    plans = []
    monkeypatch.setattr(order, "saved", lambda d, name: plans.append((name, d)) or scratch.saved(d, name))
    found = order.group_quantiles(df, "v", ("g",), {"m": 0.5})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(_v") == 1 and "LeftAnti" in plan  # of the groups that are not large, of which there are none
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert {r.g: r.m for r in found.collect()} == want
    assert {r.g: r.m for r in order.group_quantiles(df, "same", ("g",), {"m": 0.5}).collect()} == {0: 5.0, 1: 5.0}


def clouds(seed, n=600, width=8, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[np.minimum(rng.integers(0, 20, n), 11)] + spread * rng.normal(size=(n, width))  # one cloud has many of the rows
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(n, [0.0] * width), (n + 1, x[0].tolist()), (n + 2, None)]


@pytest.mark.parametrize("cells,probes", [(1, 1), (16, 1), (40, 3)])
def test_index_finds_what_all_pairs_find(spark, monkeypatch, cells, probes):
    monkeypatch.setattr(features, "QUERY_NUMBERS", 100)
    df = frame(spark, clouds(cells), "k long, v array<double>")
    queries = df.where("k % 20 = 0 or k > 598")
    want = sorted(map(tuple, features.neighbours(df, queries, "k", "v", 10).collect()))
    index = features.build_index(df, "k", "v", cells)
    assert index.rows.count() == 602 and sorted(map(tuple, features.indexed_neighbours(index, queries, "k", "v", 10, probes).collect())) == want
    assert features.indexed_neighbours(index, queries.limit(0), "k", "v", 10).count() == 0
    assert sorted(map(tuple, features.indexed_neighbours(index, queries, "k", "v", 900, probes).collect())) == sorted(map(tuple, features.neighbours(df, queries, "k", "v", 900).collect()))


def test_index_without_a_second_look_has_its_recall(spark):
    df = frame(spark, clouds(7, 2000), "k long, v array<double>")
    queries = df.where("k % 20 = 0")
    want = {(r["query"], r["neighbour"]) for r in features.neighbours(df, queries, "k", "v").collect()}
    index = features.build_index(df, "k", "v", 32)
    found = {(r["query"], r["neighbour"]) for r in features.indexed_neighbours(index, queries, "k", "v", probes=4, exact=False).collect()}
    assert len(found & want) >= 0.9 * len(want)
    empty = features.build_index(df.limit(0), "k", "v")
    assert features.indexed_neighbours(empty, queries, "k", "v").count() == 0


def test_bootstrap_and_permutation(spark):
    rows, df = groups(spark, 3, 40)
    got = {r["g"]: r for r in stats.bootstrap_ci(df, "v", ("g",), "i", 400).collect()}
    for g in "abc":
        x = np.array([q for _, h, q in rows if h == g])
        half = 1.96 * x.std() / math.sqrt(len(x))
        assert got[g]["low"] < x.mean() < got[g]["high"] and abs((got[g]["high"] - got[g]["low"]) / 2 - half) < 0.4 * half
    again = {r["g"]: r for r in stats.bootstrap_ci(df.repartition(3), "v", ("g",), "i", 400).collect()}
    assert all(again[g]["low"] == pytest.approx(got[g]["low"]) for g in "abc")
    assert stats.permutation_test(df, "v", "g", "a", "c", "i", 200).first()["p"] < 0.02
    same = df.withColumn("g", F.when(F.col("i") % 2 == 0, "x").otherwise("y"))
    assert stats.permutation_test(same, "v", "g", "x", "y", "i", 200).first()["p"] > 0.02


def weighted_interval(rows, replicates):
    """The interval of (id, value) rows by plain numpy."""
    if len(rows) == 1:
        return rows[0][1], rows[0][1]
    w = exponentials(np.array([i for i, _ in rows], np.int64), replicates)
    m = (w * np.array([v for _, v in rows])[:, None]).sum(axis=0) / w.sum(axis=0)
    return np.quantile(m, 0.025), np.quantile(m, 0.975)


@pytest.mark.parametrize("held,large", [(1 << 26, 1 << 20), (1, 1 << 20), (16 * 50 * 3, 7), (1, 2)])
def test_bootstrap_of_many_and_large_groups(spark, monkeypatch, held, large):
    monkeypatch.setattr(stats, "HELD_BYTES", held)
    monkeypatch.setattr(stats, "GROUP_ROWS", large)
    rng = random.Random(2)
    rows = [(i, None if g == 0 else f"g{g}", g % 3, rng.gauss(g, 1)) for i, g in enumerate([rng.choice([0, 1, 1, 1, 1, *range(30)]) for _ in range(600)])]
    df = frame(spark, [*rows, (9999, "g1", 1, float("nan")), (9998, "g1", 1, None)], "i int, g string, h int, v double")
    got = stats.bootstrap_ci(df.repartition(5), "v", ("g", "h"), "i", 50).collect()
    groups = {}
    for i, g, h, v in rows:
        groups.setdefault((g, h), []).append((i, v))
    assert {(r.g, r.h): r.n for r in got} == {k: len(v) for k, v in groups.items()} and len(got) == len(groups)
    for r in got:
        own = groups[r.g, r.h]
        assert (r.low, r.high) == pytest.approx(weighted_interval(own, 50)) and r["mean"] == pytest.approx(np.mean([v for _, v in own]))
    one = stats.bootstrap_ci(df, "v", (), "i", 600).first()
    assert (one.low, one.high) == pytest.approx(weighted_interval([(i, v) for i, _, _, v in rows], 600))
    assert stats.bootstrap_ci(df.limit(0), "v", ("g",), "i", 50).count() == 0


def test_what_resampling_passes_on_grows_with_tasks_and_not_batches(spark):
    rows = frame(spark, [(i, "ab"[i % 2], float(i)) for i in range(500)], "i int, g string, v double").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = stats.bootstrap_ci(rows, "v", ("g",), "i", 600)
        found.collect()
        each = rows.select("g", F.col("i").cast("long").alias("_h"), F.col("v").alias("_x"), F.lit(0).alias("_parts"))
        passed = each.mapInArrow(stats._sums_of_replicates(("g",), 600, 0.95, 0, 9), stats._replicate_schema(each, ("g",)))
        assert passed.count() == 2 * 2 * 3  # tasks, groups, pieces
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rank_sums_take_numbers_of_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(4)) for _ in range(300)]
    df = frame(spark, rows, "g string, v int")
    sums, ties = stats.rank_sums(df, "v", "g")
    weighted, weighted_ties = stats.rank_sums(df.groupBy("g", "v").agg(F.count("*").alias("w")), "v", "g", weight="w")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, weighted.collect())) and tuple(ties.first()) == tuple(weighted_ties.first())
    pair = {(r.g_a, r.g_b): r.mw_u for r in stats.mann_whitney_pairs(df, "v", "g").collect()}
    for a, b in ("ab", "ac", "bc"):
        assert pair[a, b] == sum((x > y) + 0.5 * (x == y) for g, x in rows if g == a for h, y in rows if h == b)
    plan = stats.mann_whitney_pairs(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_studentised_range_at_known_points():
    for q, k, df, p in ((3.877676, 3, 10, 0.05), (4.327, 4, 10, 0.05), (3.633, 4, 1e6, 0.05), (1e-9, 4, 70, 1.0)):  # upper 5 % points of the tables
        assert special.studentised_range_upper(q, k, df)[0] == pytest.approx(p, abs=1e-4)


def test_huber_resists_an_outlier(spark):
    df = frame(spark, [(float(i), 2.0 * i + 1 + (500.0 if i == 7 else 0.01 * (-1) ** i)) for i in range(40)], "x double, y double")
    assert stats.huber_fit(df, ("x",), "y").coefficients[0] == pytest.approx(2, abs=0.05)
    flat = stats.huber_fit(df, ("x",), "y", intercept=False)
    assert flat.intercept == 0 and flat.coefficients[0] == pytest.approx(2.03, abs=0.05)


def test_channels_are_named():
    assert CHANNELS[0] == "action_0" and len(CHANNELS) == 6


def test_registered_resampling_is_the_surveys(spark, monkeypatch):
    from trialframe.plans import comparisons, registry

    rows = [(i, ("Constant", "Ramp")[i % 2], 10.0 * (i % 2) + i / 100, 1.0) for i in range(60)]
    monkeypatch.setattr(comparisons, "plants", lambda spark, sf_dir: spark.createDataFrame(rows, "plant_id long, agent string, total double, energy double"))
    assert registry.QUERIES["permutation"](spark, "").first()["p"] == pytest.approx(1 / 10_001)
    drawn, bootstrap_ci = [], stats.bootstrap_ci
    monkeypatch.setattr(stats, "bootstrap_ci", lambda *a: drawn.append(a[4]) or bootstrap_ci(*a))
    for name in ("bootstrap_ci", "policy_summary"):
        assert registry.QUERIES[name](spark, "").count() == 2
    assert drawn == [10_000, 10_000]


def test_search_holds_few_scores_at_once():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(10_000, 8)), 1)
    x[5_000:] = x[:5_000]  # every score twice at least
    x[17, 2] = np.nan
    keys = rng.permutation(10_000).astype(np.int64)
    ids, q = keys[:1_500], x[:1_500]
    cells = np.sort(rng.integers(0, 5, 10_000)).astype(np.int32)
    batch = pa.record_batch([pa.array(keys), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64())), pa.array(cells)], ["key", "v", "cell"])
    results = []
    for search, held in ((features._nearest, (ids, q)), (features._nearest_in_cells, (ids, q, np.ones((1_500, 5), bool)))):
        tracemalloc.start()
        found = list(search(SimpleNamespace(value=held), 15)(iter([batch.slice(0, 4_000), batch.slice(4_000)])))[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20  # all scores of a batch are 72 MB
        results.append(found.to_pandas())
    for i in (0, 1, 16, 18, 1_499):
        score = np.round(x @ q[i], 6)
        order = [j for j in np.lexsort((keys, -score)) if keys[j] != ids[i] and np.isfinite(score[j])][:15]
        for found in results:
            mine = found[found["query"] == ids[i]]
            assert mine["neighbour"].tolist() == keys[order].tolist() and mine["similarity"].tolist() == score[order].tolist()
    assert not (results[0]["query"] == ids[17]).any()
