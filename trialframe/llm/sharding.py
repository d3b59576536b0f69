"""Sharding by a keyed permutation of row numbers.

Rows are numbered in the order of their id and text; a Feistel network over the
bits of a row number, walked along its cycle until it falls below the number of
rows, permutes these numbers. The permuted number's remainder is the shard, its
quotient the slot: both can be computed for any row number, and the row number
for any shard and slot, without reading the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.store import save, unused
from trialframe.llm.words import mix

#: Rounds of the network; four make it a pseudo-random permutation for ideal round functions.
ROUNDS = 6
#: Slots of a shard in one file.
FILE_ROWS = 1 << 20


def round_keys(seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """One 64-bit key for each round of the permutation that ``seed`` names."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, rounds + 1, dtype=np.uint64) + mix(np.asarray([seed % (1 << 64)], np.uint64)))


def half_bits(total: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest network that holds the numbers below ``total``; at least one each."""
    bits = max(2, (total - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: np.ndarray, keys: np.ndarray, bits: tuple[int, int], back: bool) -> np.ndarray:
    """The permutation of all numbers of the network's bits, or its inverse."""
    low = np.uint64(bits[1])
    masks = [np.uint64((1 << b) - 1) for b in bits]
    halves = [x >> low, x & masks[1]]
    order = range(len(keys))
    with np.errstate(over="ignore"):
        for k in reversed(order) if back else order:
            own = k % 2  # left and right change by turns, so that they may differ in width
            halves[own] = halves[own] ^ (mix(halves[1 - own] + keys[k]) & masks[own])
    return (halves[0] << low) | halves[1]


def permute(numbers: np.ndarray, total: int, seed: int, back: bool = False) -> np.ndarray:
    """The place below ``total`` of each number below ``total``; ``back`` gives the number at each place.

    A number that leaves the range walks on along its cycle. The network has less
    than twice as many numbers as the range (four, if there are fewer), and the walk
    ends since the cycle comes back to where it started.
    """
    keys, bits = round_keys(seed), half_bits(total)
    out = _network(np.asarray(numbers, np.uint64), keys, bits, back)
    while len(outside := np.flatnonzero(out >= np.uint64(total))):
        out[outside] = _network(out[outside], keys, bits, back)
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str], out: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with each row's number from 0 in ``order``, and how many there are.

    Rows are written once in ranges of the order; a range's first number is the size
    of those before it. Rows that are equal in the order are told apart by their
    place in the saved input, so that ranges split a key of any number of rows. Only
    the ranges' sizes come to the driver.
    """
    spark = rows.sparkSession
    tie, part, start = unused([*rows.columns, out], "tie", "part", "start")
    still = save(rows, "rows-to-number").withColumn(tie, F.monotonically_increasing_id())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(still.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order], tie).withColumn(part, F.spark_partition_id()), "ranges-of-rows")
    sizes = sorted(tuple(r) for r in ranged.groupBy(part).count().collect())
    starts, total = [], 0
    for k, size in sizes:
        starts.append((k, total))
        total += size
    own = F.row_number().over(Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order], tie))
    first = spark.createDataFrame(starts, f"{part} int, {start} long")
    return ranged.join(F.broadcast(first), part).withColumn(out, F.col(start) + own - 1).drop(part, tie, start), total


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(``keep``, size, text_crc32, row_number, shard, slot) of every row; counts of shards differ by one at most.

    ``size`` is the text's length in UTF-8 plus 8. Row numbers go by id (null first)
    and then by the text's MD5; rows equal in both are interchangeable and have
    numbers of their own, so repeated rows go to different slots. The assignment
    depends on the rows alone, not on files or partitions. A null text is an empty
    one, very long texts are read once and only moved if ``keep`` (by default the id)
    names them. Names that clash are set off by underscores; no rows give no rows.
    """
    keep = (doc_id,) if keep is None else keep
    names = unused([doc_id, *keep], "size", "text_crc32", "row_number", "shard", "slot")
    id_, digest, at = unused([*keep, *names], "order_id", "order_digest", "place")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    thin = docs.select(*keep, F.col(doc_id).alias(id_), F.md5(data).alias(digest), (F.octet_length(data).cast("long") + 8).alias(names[0]), F.crc32(data).alias(names[1]))
    numbered, total = number_rows(thin, [id_, digest], names[2])

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, seed))

    placed = numbered.withColumn(at, place(names[2]))
    return placed.select(*keep, *names[:3], (F.col(at) % shards).cast("int").alias(names[3]), F.expr(f"{at} div {int(shards)}").alias(names[4]))


def shard_and_slot(row_number: int, total: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Where the row of a number is."""
    place = int(permute(np.asarray([row_number]), total, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The number of the row at a shard's slot."""
    return int(permute(np.asarray([slot * shards + shard]), total, seed, back=True)[0])


def write_shards(sharded: DataFrame, path: str, file_rows: int = FILE_ROWS, shard: str = "shard", slot: str = "slot") -> None:
    """Parquet in a folder for each shard, slots in order, at most ``file_rows`` of them in a file."""
    block = unused(sharded.columns, "block")[0]
    rows = sharded.withColumn(block, F.floor(F.col(slot) / file_rows))
    rows.repartition(shard, block).sortWithinPartitions(shard, slot).drop(block).write.option("maxRecordsPerFile", file_rows).partitionBy(shard).parquet(path)
