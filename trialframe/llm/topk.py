"""Exact top-k inner products from an impact-ordered index, score at a time.

Candidates are indexed in blocks. In each dimension a block's vectors are listed
by quantised value; such a list is a posting segment, and its impact for a query
is the most that its vectors can add to the score beyond the least of that
dimension. A query takes the segments by falling impact. After each step, what a
vector has collected and the most it may still collect bound its score; once few
vectors can still belong to the best k, these are scored exactly. No segment is
left out without that proof.

The index is built and saved once; queries pass through it in batches of bounded
size. Vectors whose products a double might not hold exactly are scored apart, in
whole numbers of any size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches, save

#: Candidates in one block of the index, and numbers of queries that are broadcast at once (32 MB).
BLOCK, QUERY_NUMBERS = 16_384, 1 << 22
#: Values that share a segment, segments steps, and candidates that are scored without more steps.
WIDTH, STEPS, FEW = 8, 8, 512


def ordinary(x: np.ndarray) -> np.ndarray:
    """Which rows are small enough for the inner product of two of them to be exact in a double."""
    return np.abs(x).max(axis=1, initial=0) <= np.sqrt(2.0**53 / max(1, x.shape[1])) - 1


class Block:
    """The index of some vectors of integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        fits = ordinary(x)
        self.large = [(int(i), [int(c) for c in v]) for i, v in zip(ids[~fits], x[~fits])]
        x = x[fits].astype(np.int64)
        self.ids, self.x = ids[fits], x
        level = x >> (WIDTH.bit_length() - 1)
        posting, start, dim, low, high = [], [0], [], [], []
        for d in range(x.shape[1] if len(x) else 0):
            order = np.argsort(level[:, d], kind="stable").astype(np.int32)
            at = np.flatnonzero(np.diff(level[order, d], prepend=level[order[0], d] - 1))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
                own = x[order[a:b], d]
                start.append(start[-1] + b - a)
                dim.append(d), low.append(own.min()), high.append(own.max())
            posting.append(order)
        self.posting, self.start = np.concatenate(posting) if posting else np.empty(0, np.int32), np.array(start)
        self.dim, self.low, self.high = np.array(dim, np.int64), np.array(low, np.int64), np.array(high, np.int64)
        self.first = np.flatnonzero(np.diff(self.dim, prepend=-1))
        self.exact = x.astype(np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "exact"} | {"x": self.x.astype(np.min_scalar_type(-int(np.abs(self.x).max(initial=1)) - 1))}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.x = self.x.astype(np.int64)
        self.exact = self.x.astype(np.float64)

    def search(self, q: np.ndarray, k: int, own: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of this block's best k for ``q`` without id ``own``, the best first; those below ``floor`` may be left out."""
        found: list[tuple[int, int]] = []
        if ordinary(q[None])[0]:
            if len(self.ids):
                score, ids = self.best(q.astype(np.int64), k, own, floor)
                found = list(zip(score.tolist(), ids.tolist()))
            rest = self.large
        else:
            rest = [*self.large, *zip(self.ids.tolist(), self.x.tolist())]
        if rest:
            whole = [int(c) for c in q]
            found += [(sum(a * b for a, b in zip(whole, v)), i) for i, v in rest if i != own]
            found.sort(key=lambda r: (-r[0], r[1]))
        return found[:k]

    def best(self, q: np.ndarray, k: int, own: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of this block's best k for ``q`` without id ``own``; those below ``floor`` may be left out."""
        n, dims = self.x.shape
        bound = np.maximum(q[self.dim] * self.low, q[self.dim] * self.high)
        least = np.minimum.reduceat(bound, self.first)
        impact = bound - least[self.dim]
        order = np.argsort(-impact, kind="stable")
        size = np.cumsum((self.start[1:] - self.start[:-1])[order])
        cut = np.searchsorted(size, size[-1] * np.arange(1, STEPS + 1) // STEPS) + 1
        got, seen = np.zeros(n), np.zeros(n)
        base, at = int(least.sum()), 0
        alive = np.arange(n)
        for to in cut.tolist():
            if to <= at:
                continue
            step = order[at:to]
            where = np.concatenate([self.posting[self.start[s] : self.start[s + 1]] for s in step])
            weight = np.repeat(impact[step].astype(np.float64), self.start[step + 1] - self.start[step])
            got += np.bincount(where, weight, n)
            seen += np.bincount(where, minlength=n)
            at = to
            if at >= len(order):
                break
            rest = impact[order[at]]  # the most that any segment still adds
            if floor is None or to == cut[0]:
                likely = np.argpartition(-got, min(4 * k, n - 1))[: 4 * k + 1]
                floor = self._floor(q, likely, k, own, floor)
            if floor is not None:
                alive = np.flatnonzero(base + got + (dims - seen) * rest >= floor)
                if len(alive) <= FEW:
                    break
        else:
            alive = np.arange(n)
        if at >= len(order) and floor is not None:
            alive = np.flatnonzero(base + got >= floor)
        score = (self.exact[alive] @ q.astype(np.float64)).astype(np.int64)
        ids = self.ids[alive]
        kept = ids != own
        score, ids = score[kept], ids[kept]
        top = np.lexsort((ids, -score))[:k]
        return score[top], ids[top]

    def _floor(self, q, likely, k, own, floor):
        score = np.sort((self.exact[likely] @ q.astype(np.float64))[self.ids[likely] != own])[::-1]
        if len(score) < k:
            return floor
        return int(score[k - 1]) if floor is None else max(floor, int(score[k - 1]))


def _vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    kind = dict(df.dtypes)[vector]
    whole = "double" in kind or "float" in kind or "decimal" in kind
    return df.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>" if whole else "array<long>").alias("v")).where("i is not null and v is not null")


def _matrix(lists, size: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, size)


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(size, block): blocks of at most ``BLOCK`` vectors of one length, saved in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(size: int):
            parts = held.pop(size)
            block = pickle.dumps(Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), protocol=5)
            return pa.record_batch([pa.array([size], pa.int32()), pa.array([block], pa.binary())], ["size", "block"])

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for size in np.unique(lengths).tolist():
                fits = pa.array(lengths == size)
                held.setdefault(size, []).append((np.asarray(batch.column(0).filter(fits)), _matrix(batch.column(1).filter(fits), size) if size else np.zeros((int((lengths == 0).sum()), 0))))
                if sum(len(p[0]) for p in held[size]) >= BLOCK:
                    yield flush(size)
        for size in list(held):
            yield flush(size)

    bounded_batches(vectors.sparkSession)
    return save(_vectors(vectors, vec_id, vector).mapInArrow(build, "size int, block binary"), "index")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best candidates, ties to the smaller id.

    ``vectors`` and ``queries`` have ids and arrays of whole numbers, as integers or
    doubles, however large; vectors of different lengths never meet. A query's own
    id is no candidate. Rows with a null id or array take no part; of repeated ids
    each row is a candidate, and equal query rows are one query. A score among the
    best that does not fit a long is an error. Queries go in batches of bounded
    size, each through the index that is built once. No rows give no rows; other
    columns take no part.
    """
    index = build_index(vectors, vec_id, vector)
    queries = _vectors(queries, vec_id, vector).distinct()
    found = None
    for size, count in sorted(tuple(r) for r in queries.groupBy(F.size("v")).count().collect()):  # a row for each length of vector
        parts = max(1, -(-count * max(1, size) // QUERY_NUMBERS))
        for part in range(parts):
            own = queries.where((F.size("v") == size) & (F.pmod(F.xxhash64("i"), F.lit(parts)) == part))
            table = own.orderBy("i", "v").toArrow().combine_chunks()
            ids, q = table["i"].to_numpy(), np.array(table["v"].to_pylist()).reshape(-1, size)
            shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
            one = index.where(F.col("size") == size).select("block").mapInArrow(_search(shared, k), "query_id long, nth long, vec_id long, score long")
            found = one if found is None else found.unionAll(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            for data in batch.column(0):
                block: Block = pickle.loads(data.as_buffer())
                for at in range(len(ids)):
                    old = best[at]
                    new = block.search(q[at], k, int(ids[at]), old[k - 1][0] if len(old) >= k else None)
                    if new:
                        best[at] = sorted([*old, *new], key=lambda r: (-r[0], r[1]))[:k]
        if any(not -(1 << 63) <= score < 1 << 63 for own in best for score, _ in own):
            raise OverflowError("a score does not fit a long")
        n = [len(own) for own in best]
        # the same id may stand for several query vectors: they are told apart by their number
        nth = np.arange(len(ids)) - np.searchsorted(ids, ids, "left")
        yield pa.record_batch(
            [pa.array(np.repeat(ids, n).astype(np.int64)), pa.array(np.repeat(nth, n).astype(np.int64)), pa.array([i for own in best for _, i in own], pa.int64()), pa.array([s for own in best for s, _ in own], pa.int64())],
            ["query_id", "nth", "vec_id", "score"],
        )

    return search


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, a whole number in a double; vectors that are null or hold nulls, NaN or infinity are left out."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger ones have no fraction

    return vectors.where(F.col(embedding).isNotNull()).where(~odd).select(F.col(vec_id), F.transform(embedding, whole).alias("vector"))
