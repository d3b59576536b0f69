"""Best-fit packing with exact-complement hashing.

Packing looks at lengths only, so the plan is made on the histogram of lengths:
at most ``capacity`` numbers, whatever the size of the corpus. The plan is a list
of bin shapes with multiplicities. Rows find their bin by their rank among the
rows of their length, which needs no task to hold a length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.store import save, small, unused

#: Rows of one length that are ranked in one part, about.
RANK_ROWS = 100_000
#: Rows of counts by length and part that may be broadcast.
BROADCAST_COUNTS = 1 << 18


def _pairs(there: np.ndarray, top: int, total: int) -> list[int]:
    """The smaller of two available lengths of at most ``top`` that add up to ``total``."""
    low, high = max(1, total - top), total // 2
    if high < low:
        return []
    return (np.flatnonzero(there[low : high + 1] & there[total - high : total - low + 1][::-1]) + low).tolist()


def _exact(counts: np.ndarray, first: int, gap: int) -> tuple[int, ...] | None:
    """One to three available lengths, each at most ``first``, that add up to ``gap``; ``first`` itself is taken once."""
    left = counts.copy()
    left[first] -= 1
    top = min(first, gap)
    if gap <= first and left[gap] > 0:
        return (gap,)
    there = (left[: top + 1] > 0).astype(np.int64)
    for c in _pairs(there, top, gap):
        if c != gap - c or left[c] > 1:
            return (gap - c, c)
    for a in np.flatnonzero(there[: gap - 1])[::-1].tolist():  # the largest of three
        if 3 * a < gap:
            break
        for c in _pairs(there, a, gap - a):
            need: dict[int, int] = {}
            for x in (a, gap - a - c, c):
                need[x] = need.get(x, 0) + 1
            if all(left[x] >= k for x, k in need.items()):
                return (a, gap - a - c, c)
    return None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin shapes ``(how many bins, [(length, how many in each bin), ...])`` for lengths 1 to ``capacity``.

    Lengths go from long to short. While one, two or three available lengths fill
    a length's gap exactly, such bins are made, as many at a time as the counts
    allow; what has no exact complement goes by best fit, longest first, into the
    bin whose gap it fills best.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        bins.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    rest: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while left[length] and (found := _exact(left, length, capacity - length)):
            shape: dict[int, int] = {}
            for x in (length, *found):
                shape[x] = shape.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in shape.items())
            for x, k in shape.items():
                left[x] -= times * k
            bins.append((times, list(shape.items())))
        if left[length]:
            rest.append((length, int(left[length])))
            left[length] = 0
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length, n in rest:
        while n:
            gap = min((g for g in open_ if g >= length), default=capacity)
            if gap in open_ and open_[gap]:
                have, shape = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            else:
                have, shape = n, []
            each = min(gap // length, n)
            times = min(have, n // each)
            if shape and times < have:
                open_.setdefault(gap, []).append((have - times, shape))
            n -= times * each
            open_.setdefault(gap - each * length, []).append((times, [*shape, (length, each)]))
    return bins + [b for kind in open_.values() for b in kind]


def _slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, sequence, how many in each bin, offset), sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, shape in bins:
        offset = 0
        for length, each in shape:
            rows.append((length, taken.get(length, 0), sequence, each, offset))
            taken[length] = taken.get(length, 0) + times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_fit_packing(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of columns of those names.

    No sequence exceeds ``capacity`` and offsets leave no gap. ``length`` must be
    1 to ``capacity``, others and nulls are an error. Rows that tie on all of
    ``order``, such as repeated rows, are packed each for itself and may change
    places; nulls in other columns do no harm. No rows give no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    counts = {r[0]: int(r[1]) for r in pieces.groupBy(length).count().limit(capacity + 1).collect()}
    wrong = [x for x in counts if x is None or not 1 <= x <= capacity]
    if wrong:
        raise ValueError(f"lengths outside 1..{capacity}: {wrong[:5]}")
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_bins({int(x): n for x, n in counts.items()}, capacity)))

    # the rows of a length go by their hash to parts of bounded size, each ranked for itself after those before it
    size, parts, part, n, rank, before = unused(names, "size", "parts", "part", "n", "rank", "before")
    many = pieces.sparkSession.createDataFrame([(int(x), -(-c // RANK_ROWS)) for x, c in counts.items()], f"{size} long, {parts} long")  # at most ``capacity`` rows
    dealt = pieces.join(F.broadcast(many), F.col(length).cast("long") == F.col(size)).withColumn(part, F.pmod(F.xxhash64(*order), F.col(parts)))
    sizes = dealt.groupBy(size, part).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = save(sizes.select(size, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before)), "sizes")
    own = Window.partitionBy(size, part).orderBy(*order)
    ranked = dealt.withColumn(rank, F.row_number().over(own)).join(F.broadcast(sizes) if small(sizes, BROADCAST_COUNTS) else sizes, [size, part])
    ranked = ranked.select(*names, (F.col(rank) - 1 + F.col(before)).alias(rank))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        key = (table[:, 0] << 42) + table[:, 1] if len(table) else np.empty(0, np.int64)
        for batch in batches:
            n, rank = batch.column(names.index(length)).to_numpy().astype(np.int64), batch.column(len(names)).to_numpy()
            at = np.searchsorted(key, (n << 42) + rank, "right") - 1
            row = table[at]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * n
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ranked.select(*names).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all token pieces of ``docs``.

    A null or empty text is a document of the end mark alone, a longer one than a
    sequence is cut into pieces. Repeated rows and rows of null id are packed each for
    itself; pieces of equal length are interchangeable. Other columns take no part,
    whatever their names, and no rows give none.
    """
    from trialframe.llm.tokens import token_pieces

    return best_fit_packing(save(token_pieces(docs, tokenizer_file, capacity=capacity), "pieces"), capacity)
