import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import repair, sharding

# -- conversation repair


def cheapest(symbols):
    """The least (cost, edits) over all ways to edit, by trying them."""
    best = (10**9, "")
    grammar, start = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")

    def go(i, roles, cost, edits, inserts):
        nonlocal best
        if cost > best[0] or not start.match(roles):
            return
        if i == len(symbols) and grammar.match(roles):
            best = min(best, (cost, edits))
        if inserts < 2:
            for role in "ua":
                go(i, roles + role, cost + 3, edits + "I", inserts + 1)
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, roles, cost + 4, edits + "D", 0)
            if s:
                more = 3 * ((s - 1) % 2)
                go(i + 1, roles + "sua?"[(s - 1) // 2], cost + more, edits + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 3 + more, edits + "R", 0)

    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_edits_are_the_cheapest_and_least(seed):
    r = random.Random(seed)
    symbols = [r.randrange(repair.SYMBOLS) for _ in range(r.randint(0, 5))]
    assert repair.least_edits(symbols) == cheapest(symbols)


def test_every_block_is_its_symbols_one_by_one():
    t = repair.tables()
    assert len(t.vectors) < 100 and len(t.block[0]) == repair.SYMBOLS**repair.BLOCK
    r = random.Random(0)
    for _ in range(2000):
        v, symbols = r.randrange(len(t.vectors)), [r.randrange(repair.SYMBOLS) for _ in range(repair.BLOCK)]
        now, paid = v, 0
        for s in symbols:  # the last row of the conversation first
            now, paid = t.step[now][s], paid + t.paid[now][s]
        code = sum(s * repair.SYMBOLS**k for k, s in enumerate(symbols))
        assert (t.block[v][code], t.block_paid[v][code]) == (now, paid)


def repaired(rows):
    """What ``repair_digests`` should give for one conversation's rows (turn, role, text), by the single-symbol steps."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
    seen, faults = set(), []
    for t, r, x in rows:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    cost, audit = repair.least_edits([repair.symbol(f, r) for f, (_, r, _) in zip(faults, rows)])
    out, i = [], 0
    for e in audit:
        want = "assistant" if out and out[-1][0].startswith("u") else "user"
        if e == "I":
            out.append((want, ""))
            continue
        if e != "D":
            out.append((rows[i][1] if e == "K" else want, rows[i][2]))
        i += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


ODD = {
    None: [(None, None, None), (1, "user", "Hi."), (1, "user", "Hi."), (None, "user", "Hi.")],
    1: [(0, "system", "Be kind."), (1, "user", "Question?"), (2, "assistant", "Answer!")],
    2: [(5, "assistant", "no end"), (5, "tool", "x."), (7, "", "y."), (2**62, "user", "\t\n ")],
    3: [(0, "user", "é" * 200_000 + ".")],
    4: [(k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3001)],
    5: [(k, "user", "the same") for k in range(500)],
}


@pytest.mark.parametrize("batch", [3, 1000])
def test_conversations_are_repaired(spark, monkeypatch, batch):
    monkeypatch.setattr(repair, "bounded_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch))
    r = random.Random(batch)
    made = {k: [(r.choice([None, *range(6)]), r.choice([None, "", "system", "user", "assistant", "tool"]), r.choice([None, "", "a.", "b", "c? ", "a."])) for _ in range(r.randint(1, 9))] for k in range(100, 180)}
    given = ODD | made
    turns = spark.createDataFrame([(k, *row) for k, rows in given.items() for row in rows], "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(7), "s": F.lit("x"), "f": F.lit(None)})
    got = {row[0]: tuple(row)[1:] for row in repair.repair_digests(turns).collect()}
    assert got == {k: repaired(rows) for k, rows in given.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def test_edits_give_the_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "more"), (2, 0, "assistant", " ")], "conv_id long, turn long, role string, text string")
    rows = repair.repair_conversations(turns).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "K", "", 0, "user", "user", "Hi.", 6),
        (1, 1, "R", "truncated", 1, "user", "assistant", "more", 6),
        (2, 0, "D", "blank", 0, "assistant", None, None, 4),
    ]
    assert repair.repair_conversations(turns.limit(0)).count() == 0 == repair.repair_digests(turns.limit(0)).count()


# -- sharding


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 16, 17, 1000, 65537])
def test_the_permutation_and_its_inverse(total):
    numbers = np.arange(total)
    places = sharding.permute(numbers, total, 5)
    assert sorted(places.tolist()) == numbers.tolist()
    assert (sharding.permute(places, total, 5, back=True) == numbers).all()
    if total > 100:
        assert (places != sharding.permute(numbers, total, 6)).mean() > 0.9
        assert abs(np.corrcoef(numbers, places)[0, 1]) < 0.1


def test_large_numbers():
    total = 10**17 + 3
    for number in (0, 1, total - 1, 12345678901234567):
        shard, slot = sharding.shard_and_slot(number, total, 24, 1)
        assert sharding.row_at(shard, slot, total, 24, 1) == number and shard + 24 * slot < total


def documents(spark):
    rows = [*((k, f"text {k}") for k in range(200)), *[(7, "copy")] * 40, (None, None), (None, ""), (None, "é"), (3, "long " * 100_000), *((9, f"other {k}") for k in range(60))]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_shards_are_even_and_slots_gapless(spark):
    rows, docs = documents(spark)
    out = sharding.shard_rows(docs.withColumns({"size": F.lit("clash"), "order_id": F.lit(1)}), 7, seed=3).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in out))) == sorted(map(str, ((i, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x in rows)))
    slots = [sorted(r.slot for r in out if r.shard == s) for s in range(7)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert all(sharding.shard_and_slot(r.row_number, len(rows), 7, 3) == (r.shard, r.slot) for r in out)
    order = sorted(out, key=lambda r: r.row_number)
    assert [r.row_number for r in order] == list(range(len(rows))) and [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_the_assignment_depends_on_the_rows_alone(spark):
    _, docs = documents(spark)
    one, two = (sorted(map(str, sharding.shard_rows(d, 5).collect())) for d in (docs.coalesce(1), docs.repartition(9)))
    assert one == two
    assert sharding.shard_rows(docs.limit(0), 5).count() == 0


def test_shards_are_written_in_order(spark, tmp_path):
    rows, docs = documents(spark)
    out = sharding.shard_rows(docs.withColumn("shard", F.lit("old")), 3, keep=("doc_id", "text", "shard"))
    assert "_shard" in out.columns
    sharding.write_shards(sharding.shard_rows(docs, 3, keep=("doc_id", "text")), str(tmp_path / "s"), file_rows=50)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(map(str, rows))
    files = back.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("shard").alias("s")).collect()
    assert all(f.n <= 50 and f.b - f.a + 1 == f.n and f.s == 1 for f in files)


def test_enumeration_covers_all_edits():
    assert {e for n in range(4) for s in itertools.product(range(9), repeat=n) for e in repair.least_edits(list(s))[1]} == set("DIKR")
