import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trialframe.llm import packing, tokens
from trialframe.llm.packing import best_fit_packing, pack_documents, plan_bins
from trialframe.llm.queries import tokenizer_file

ODD = [None, "", " \t\n", "It's DON'T we'll 12345 a.b,c <|endoftext|> x<|startoftext|>y", "Σίσυφος ΟΔΟΣ İstanbul ŁÓDŹ naïvé é e ́", "🙂🙂  x y\x85z\x1cq", "don't 's 'tis ''s 'S", "ﬁ Ⅷ ½ x² ǅ ß ẞ", "a" * 5000, "́abc ﻿ zero​width", "....!!! $$$ a$$$b", "word, " * 5000]


def check_bins(counts, bins, capacity):
    used = Counter()
    for times, shape in bins:
        assert times > 0 and sum(n * k for n, k in shape) <= capacity
        for n, k in shape:
            used[n] += times * k
    assert used == Counter({n: c for n, c in counts.items() if c})


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice((7, 64, 300))
    counts = Counter(r.randint(1, capacity) for _ in range(r.choice((0, 1, 5, 400))))
    bins = plan_bins(dict(counts), capacity)
    check_bins(counts, bins, capacity)
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    big = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert sum(t for t, _ in bins) <= 1.25 * max(bound, big) + 2


def test_exact_complements_fill_bins():
    assert plan_bins({10: 3}, 10) == [(3, [(10, 1)])]
    for counts in ({6: 5, 4: 5}, {5: 4}, {5: 3, 3: 3, 2: 3}, {4: 2, 3: 2, 2: 2, 1: 2}):
        bins = plan_bins(counts, 10)
        check_bins(counts, bins, 10)
        assert all(sum(n * k for n, k in shape) == 10 for _, shape in bins)


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(tokens.token_pieces(rows, tokenizer_file(), with_ids=True).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(got[r["doc_id"]]) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got[r["doc_id"]] += r["ids"]
    for i, x in enumerate(ODD):
        assert got[i] == [*t.encode(x or "", add_special_tokens=False).ids, 0]


def test_table_of_words_may_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    w = tokens.WordIds(tokenizer_file())
    r = random.Random(1)
    vocabulary = ["one", "two", "Three", "four!", "(five)", "six-seven", "8nine", "été", "x" * 50, "..."]
    for _ in range(60):
        texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 6))) for _ in range(3)]
        ids, ends = w.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_documents(spark):
    r = random.Random(4)
    texts = [*ODD, *[" ".join(r.choice(("alpha", "beta", "gamma,", "Delta.")) for _ in range(r.randint(0, 300))) for _ in range(200)]]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x"), (None, "one two", 1, "x")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset int, sequence_id string"), tokenizer_file(), 256).collect()
    by = defaultdict(list)
    for p in out:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(p["length"] for p in out)
    assert len(by) <= 1.02 * total / 256 + 2
    assert len({p["doc_id"] for p in out}) == len(texts) + 1


def test_packing_edges(spark, monkeypatch):
    schema = "doc_id long, piece int, length long, ids_crc32 long, offset string"
    assert best_fit_packing(spark.createDataFrame([], schema), 10).count() == 0
    same = spark.createDataFrame([(1, 0, 4, 9, "z")] * 5, schema)
    out = best_fit_packing(same, 10).collect()
    assert len(out) == 5 and len({(r["sequence_id"], r["offset"]) for r in out}) == 5 and len({r["sequence_id"] for r in out}) == 3
    for parts in (1, 2, 3):
        monkeypatch.setattr(packing, "RANK_ROWS", parts)
        r = random.Random(parts)
        rows = [(i if i % 7 else None, 0, r.choice((1, 2, 3, 7, 10)), 9, "z", i, 1, "p") for i in range(200)]
        out = best_fit_packing(spark.createDataFrame(rows, f"{schema}, rank int, size int, before string"), 10).collect()
        assert sorted(x["rank"] for x in out) == list(range(200)) and len({(x["sequence_id"], x["offset"]) for x in out}) == 200
        filled = defaultdict(list)
        for x in out:
            filled[x["sequence_id"]].append((x["offset"], x["length"]))
        for own in filled.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 10
    with pytest.raises(ValueError):
        best_fit_packing(spark.createDataFrame([(1, 0, None, 9, "z")], schema), 10)
    with pytest.raises(ValueError):
        best_fit_packing(spark.createDataFrame([(1, 0, 11, 9, "z")], schema), 10)


def test_packing_query_against_the_tokenizer_and_the_bound(spark):
    from tokenizers import Tokenizer

    from trialframe.llm.queries import op3_best_fit_packing

    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(tokenizer_file())
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[r["doc_id"], k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    got = op3_best_fit_packing(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    # no packing has fewer sequences than the tokens fill, or than there are pieces over half a sequence
    bound = max(-(-sum(n for _, n, _ in want.values()) // 2048), sum(n > 1024 for _, n, _ in want.values()))
    assert len({r["sequence_id"] for r in got}) <= bound + 1
