import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialframe.llm import collocations as col


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", text)]


def brute(rows, width=3, least=10, inside=50, top=2000):
    counts, out = {}, []
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for p in pieces(text):
            for m in range(1, width + 1):
                own.update(tuple(p[i : i + m]) for i in range(len(p) - m + 1))
    for lang, own in counts.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        candidates = {g: c for g, c in own.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in candidates.items():
            within = lambda h, g=g: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            if any(len(h) > len(g) and 100 * b >= inside * a and within(h) for h, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["a", "the", "The", "of", "é", "x", "new", "york", "city", "𝔘n"]
    return [("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


@pytest.mark.parametrize("seed,chunk,bucket,heavy,slice_bytes", [(1, 10**6, 10**6, 256, 1 << 21), (2, 7, 50, 3, 5), (3, 1, 1, 1000, 1), (4, 40, 300, 8, 64)])
def test_counts_equal_brute_force(spark, monkeypatch, seed, chunk, bucket, heavy, slice_bytes):
    monkeypatch.setattr(col, "SLICE_BYTES", slice_bytes)
    rows = texts(seed, 150)
    docs = frame(spark, rows)
    words = col.word_counts(docs, chunk_words=chunk)
    found = col.phrase_counts(docs, words, chunk_words=chunk, bucket_words=bucket, heavy=heavy)
    want = {}
    for text, lang in rows:
        for p in pieces(text):
            for m in (1, 2, 3):
                for i in range(len(p) - m + 1):
                    key = (lang or "und", " ".join(p[i : i + m]), m)
                    want[key] = want.get(key, 0) + 1
    assert {(r.lang, r.word, 1): r.f for r in words.collect()} == {k: v for k, v in want.items() if k[2] == 1}
    assert sorted(((r.lang, r.phrase, r.words), r.a) for r in found.collect()) == sorted((k, v) for k, v in want.items() if k[2] > 1 and v >= 10)


def test_collocations_equal_brute_force(spark):
    rows = [*texts(5, 200), ("new york city. " * 40, "en"), (None, "en"), ("", None), ("...", "fr"), ("only once here", "de"), *[("same same same same", "fr")] * 5]
    got = col.collocations(frame(spark, rows).withColumn("f", F.lit("clash")).withColumn("phrase", F.lit(1)), top=25)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(rows, top=25)
    wide = col.collocations(frame(spark, rows), width=4, least=5, inside=80)
    assert sorted(tuple(r) for r in wide.collect()) == brute(rows, width=4, least=5, inside=80)


def test_no_rows_and_no_phrases(spark):
    assert col.collocations(frame(spark, [("a b", "en")]).limit(0)).count() == 0
    assert col.collocations(frame(spark, [("a b", "en"), (None, None)])).count() == 0


def test_a_long_text_and_large_numbers(spark):
    text = "big cat " * 150_000
    rows = col.collocations(frame(spark, [(text, "en")])).collect()
    assert [tuple(r) for r in rows] == brute([(text, "en")])


def test_scores_are_exact_beyond_64_bits(spark):
    r = random.Random(1)
    rows = [(a, r.randint(a, 10**15), r.randint(a, 10**15)) for a in (10, 3_000_000_000, 10**15, *(r.randint(10, 10**15) for _ in range(200)))]
    got = spark.createDataFrame(rows, "x long, y long, z long").select("*", col.exact_score("x", "y", "z").alias("s")).collect()
    assert all(g.s == 1_000_000 * g.x * g.x // (g.y * g.z) for g in got) and len(got) == len(rows)


@pytest.mark.parametrize("seed", range(20))
def test_prefixes_of_the_quicksort(seed):
    r = np.random.default_rng(seed)
    n, width = int(r.integers(0, 300)), 4
    keys = r.integers(0, 6, (n, width)).astype(np.int32)
    keys[:, 0] += 1
    for k in range(1, width):
        keys[keys[:, k - 1] == 0, k] = 0
    weights = r.integers(1, 4, n)
    want = Counter()
    for row, w in zip(keys.tolist(), weights.tolist()):
        for d in range(2, width + 1):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    got = {}
    for d, pointers, sizes in col.frequent_prefixes(keys, weights, 10, 2):
        for p, w in zip(pointers, sizes.tolist()):
            assert tuple(keys[p, :d].tolist()) not in got
            got[tuple(keys[p, :d].tolist())] = w
    assert got == {k: v for k, v in want.items() if v >= 10}


def test_wide_keys_are_counted_without_packing():
    columns = [np.asarray([3, 3, 1, 3]), np.asarray([5, 5, 5, 4]), np.asarray([1, 1, 1, 1])]
    for sizes in ([4, 6, 2], [1 << 30, 1 << 30, 1 << 30]):
        rows, n = col._distinct([c.astype(np.int64).copy() for c in columns], sizes)
        assert rows.tolist() == [[1, 5, 1], [3, 4, 1], [3, 5, 1]] and n.tolist() == [1, 1, 2]


def test_texts_in_a_sliced_array():
    whole = pa.array(["skip me", "One two.three", "", "four"], pa.large_string()).slice(1)
    got = [(w.to_pylist(), r.tolist(), n.tolist()) for w, r, n in col.words_and_pieces(whole)]
    assert got == [(["one", "two", "three", "four"], [0, 0, 0, 2], [True, False, True, True])]
