import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialframe.llm import ngram_join as nj
from trialframe.llm.components import components
from trialframe.llm.words import shingle_sets

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute(rows, width, percent):
    """{row number: component}, rows being (id, text)."""
    s = sets_of([t for _, t in rows], width)
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations([(r[0], k) for k, r in enumerate(rows) if r[0] is not None], 2):
        if s[x] and s[y] and 100 * len(s[x] & s[y]) >= percent * len(s[x] | s[y]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return [(None if i is None else (find(i) if s[k] else i), len(s[k])) for k, (i, _) in enumerate(rows)]


def made(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 90))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 5))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, component_id string, n int")
    return [(r["doc_id"], r["component_id"], r["n_shingles"]) for r in nj.ngram_jaccard_join(df, **kw).collect()]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rows = made(width) + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "two words"), (906, "a b c"), (None, "a b c"), (907, "x " * 30_000), (908, "X " * 30_001)]
    want = sorted((i, c, n) for (i, _), (c, n) in zip(rows, brute(rows, width, percent)) if i is not None)
    got = run(spark, rows, width=width, percent=percent)
    assert sorted(g for g in got if g[0] is not None) == want
    assert [g for g in got if g[0] is None] == [(None, None, 1)]


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nj, "SMALL_BUCKET", 3)
    monkeypatch.setattr(nj, "BLOCK_COST", 900)
    rows = made(11, 120)
    want = sorted((i, c, n) for (i, _), (c, n) in zip(rows, brute(rows, 3, 90)))
    assert sorted(run(spark, rows, width=3, percent=90)) == want


@pytest.mark.parametrize("n,cost", [(5_000, 1 << 19), (900, 30_000)])
def test_thousands_of_short_near_copies(spark, monkeypatch, n, cost):
    monkeypatch.setattr(nj, "BLOCK_COST", cost)
    r = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):  # every one has two words of its own
        w = list(common)
        for at in r.sample(range(60), 2):
            w[at] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(9_000 + i, " ".join([*common[:30], *(f"far{i}x{k}" for k in range(30))])) for i in range(50)]  # half the same
    got = run(spark, rows, width=5, percent=70)
    s = sets_of([t for _, t in rows], 5)
    first = [i for i in range(1, n) if 100 * len(s[0] & s[i]) >= 70 * len(s[0] | s[i])]
    component = {i: c for i, c, _ in got}
    assert len(first) > n / 50 and all(component[i] == 0 for i in first)
    assert all(component[9_000 + i] == 9_000 + i for i in range(50))
    for i in r.sample(range(n), 30):  # alone only where no text is near
        near = [j for j in range(n) if j != i and 100 * len(s[i] & s[j]) >= 70 * len(s[i] | s[j])]
        assert all(component[j] == component[i] for j in near)


def test_one_id_with_several_texts(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(2, text("a")), (2, text("b")), (1, text("a")), (3, text("b").replace("b7", "q")), (4, text("c"))]
    assert sorted((i, c) for i, c, _ in run(spark, rows, width=3, percent=80)) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4)]


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v")]
    assert sorted(run(spark, rows)) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 2)]
    assert run(spark, []) == []


def test_sketches_never_hide_a_link():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(len(a) * r.uniform(0, 0.2)) :], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.2))).astype(np.uint64))))
        if nj.reaches(a, b, 80):
            assert nj.may_reach(nj.sketch(a), nj.sketch(b), len(a), len(b), 80)


def test_shingles_match_words():
    texts = ["A b\tC d", "one two", "", "ÀB àb x y", "  lead trail  ", "Z" * 9000 + " q r s"]
    got = [len(s) for s in shingle_sets(pa.array(texts, pa.large_string()), 3)]
    assert got == [len(s) for s in sets_of(texts, 3)]


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 2), (20, 21), (21, 21), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, w long")).collect()}
    assert got == {**{i: 2 for i in (2, 3, 5, 9)}, 20: 20, 21: 20, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "u long, w long")).count() == 0


def test_components_that_are_not_reached_are_an_error(spark, monkeypatch):
    from trialframe.llm import components

    path = spark.range(1, 400).select((F.col("id") * 7919 % 400).alias("u"), ((F.col("id") + 1) * 7919 % 400).alias("w"))
    assert components.components(path).select("component").distinct().count() == 1
    monkeypatch.setattr(components, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="2 rounds"):
        components.components(path)


def test_members_that_their_first_one_connects_are_not_sent_again(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for _ in range(119):
        words = list(base)
        for at in rng.choice(300, 3, replace=False):
            words[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    sent = []
    verify = nj._verify_blocks
    monkeypatch.setattr(nj, "_verify_blocks", lambda members, *rest: (sent.append(members.count()), verify(members, *rest))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = nj.ngram_jaccard_join(df, width=3, percent=90).collect()
    assert {r["component_id"] for r in got} == {0} and sent == [0]
