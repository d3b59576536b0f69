"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words that a fixed mask selects from a window; the
words it passes over may differ between the two sides. The masks are complete:
every overlap that the operator's threshold allows has a seed in common. Test and
training seeds meet in a hash join whose test side is a bounded, broadcast block
of the benchmark, so the documents are never shuffled. Around each hit the words
of both sides are compared along the hit's diagonal.

A benchmark of more than one block is met by few documents: one pass keeps those
with a seed in a Bloom filter of bounded size, and each block is joined with what
that pass has kept, one block after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches, lightly, save, small, unused
from trialframe.llm.words import hash_words, mix, slices, text_column

#: Words that a seed takes (1) and passes over (0): complete for 12 words or more with a fifth replaced.
MASKS = ("11111", "110111")
#: Benchmark words in one block (the seeds of a block take some 50 MB).
BLOCK_WORDS = 500_000
#: Hits that are looked at in one go.
HITS = 200_000
#: Bits of the Bloom filter over the seeds of several blocks, as a power of two (8 MB).
FILTER_BITS = 26
#: Row keys that may be broadcast.
BROADCAST_KEYS = 1 << 18
_TABLE_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plain_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, each row's offsets); words are runs of letters and digits in lower case."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    lists = pc.ascii_split_whitespace(clean)
    flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    at -= at[0]
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    if not full.all():
        flat, at = flat.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[at]
    return hash_words(flat), at


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed of every window of ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, len(mask) * 31 + int(mask, 2), np.uint64)
        for k, taken in enumerate(mask):
            if taken == "1":
                out = (out * _STEP) ^ (h[k : k + n] >> np.uint64(1))
                out += h[k : k + n]
        return mix(out)


def _best_unseen(masks: tuple[str, ...], percent: int, upto: int, ends: bool) -> np.ndarray:
    """Of each length, the largest score (100 - percent a match, -percent a replaced word) of a run that no mask hits; beginning and ending with a match if ``ends``."""
    states = np.arange(1 << max(map(len, masks)))  # matches of the last words as bits
    seen = np.any([(states & int(m, 2)) == int(m, 2) for m in masks], axis=0)
    none = -(1 << 40)
    score = np.where(seen | (states > 1) | (ends & (states == 0)), none, np.where(states == 1, 100 - percent, -percent))
    out = [none]
    for _ in range(upto):
        out.append(int((score[1::2] if ends else score).max()))
        # the two states that differ in the oldest word go on to the same two
        old = np.maximum(*np.split(score, 2))
        score = np.stack((old - percent, old + 100 - percent), axis=1).ravel()
        score[seen] = none
    return np.array(out)


def complete(masks: tuple[str, ...], least: int, percent: int) -> bool:
    """Whether every run of at least ``least`` words that begins and ends with a match and matches in ``percent`` has a mask's words in a row.

    A long run without a seed falls into shorter ones without: where none of n to
    2n - 1 words reaches the percentage, no longer one does.
    """
    upto = max(64, 2 * least)
    loose, tight = (_best_unseen(masks, percent, upto, ends) < 0 for ends in (False, True))
    bound = next((n for n in range(1, upto // 2) if loose[n : 2 * n].all()), None)
    return bound is not None and bool(tight[least : max(bound, least)].all())


def long_masks(least: int, percent: int) -> tuple[str, ...]:
    """``MASKS``, and where they are not complete, the longest row of words that makes them so; one word always does."""
    rows = (MASKS, *((*MASKS, "1" * n) for n in (4, 3, 2)))
    return next((masks for masks in rows if complete(masks, least, percent)), ("1",))


def short_masks(n: int, percent: int) -> list[str]:
    """Masks over all of an item of ``n`` words: the inner words in two parts more than can be replaced, and for each choice of as many parts a mask without them."""
    inner = max(n - 2, 0)
    replaced = min(n * (100 - percent) // 100, inner)
    parts = min(replaced + 2, inner)
    return ["1" * min(n, 1) + "".join("01"[parts * i // inner not in out] for i in range(inner)) + "1" * (n > 1) for out in combinations(range(parts), replaced)]


def item_masks(n: int, short: int, least_words: int, percent: int) -> tuple[str, ...] | list[str]:
    """The masks of an item of ``n`` words."""
    if n < max(short, 1):
        return ()
    return long_masks(least_words, percent) if n >= least_words else short_masks(n, percent)


class _Block:
    """Seeds of some benchmark items, sorted, with a bit table in front."""

    def __init__(self, items: list[tuple[int, np.ndarray]], short: int, least_words: int, percent: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.start = np.concatenate(([0], np.cumsum([len(h) for _, h in items]))).astype(np.int64)
        self.words = np.concatenate([h for _, h in items]) if items else np.empty(0, np.uint64)
        kinds: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        chosen: dict[int, tuple[str, ...] | list[str]] = {}
        for k, (_, h) in enumerate(items):
            n = min(len(h), least_words)
            if n not in chosen:
                chosen[n] = item_masks(n, short, least_words, percent)
            for mask in chosen[n]:
                s = seeds(h, mask)
                kinds.setdefault(mask, []).append((s, self.start[k] + np.arange(len(s))))
        #: by mask: (seeds, places), those of them whose item has another seed just before, each sorted; the seed of the place before each place; a table of bits
        self.masks: dict[str, tuple] = {}
        for mask, parts in kinds.items():
            s, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            first = np.concatenate([np.append(True, p[0][1:] != p[0][:-1])[: len(p[0])] for p in parts])
            before, begins = np.zeros(len(self.words) + 1, np.uint64), np.ones(len(self.words) + 1, bool)
            before[at + 1], begins[at + 1] = s, False
            begins[self.start] = True
            order = np.argsort(s, kind="stable")
            s, at, first = s[order], at[order], first[order]
            bits = min(_TABLE_BITS, 3 + len(s).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(s >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.masks[mask] = (s, at), (s[first], at[first]), before, begins, table

    def hits(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``h``, places among the block's words) where a row of equal seeds on one diagonal begins, some HITS at a time.

        Where a document repeats the seed of the place before, such a row can only
        begin at a place of an item that does not.
        """
        for mask, (every, firsts, before, begins, table) in self.masks.items():
            own = seeds(h, mask)
            if not len(own):
                continue
            likely = np.flatnonzero(table[(own >> np.uint64(65 - len(table).bit_length())).astype(np.int64)] & (row[: len(own)] == row[len(mask) - 1 :]))
            again = (likely > 0) & (row[likely - 1] == row[likely]) & (own[likely - 1] == own[likely])
            for places, (s, at) in ((likely[~again], every), (likely[again], firsts)):
                low, high = np.searchsorted(s, own[places], "left"), np.searchsorted(s, own[places], "right")
                places, low, high = places[high > low], low[high > low], high[high > low]
                upto = np.cumsum(high - low)
                begin = 0
                while begin < len(places):
                    end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
                    n = (high - low)[begin:end]
                    here = np.repeat(places[begin:end], n)
                    there = at[np.repeat(low[begin:end], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                    goes_on = (here > 0) & (row[here - 1] == row[here]) & ~begins[there] & (own[here - 1] == before[there])
                    if not goes_on.all():
                        yield here[~goes_on], there[~goes_on]
                    begin = end


def best_run(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """(start, length) of the longest run that begins and ends with a match and matches in ``percent`` of its words."""
    ends = np.flatnonzero(equal)
    if not len(ends):
        return 0, 0
    run = np.concatenate(([0], np.cumsum(np.where(equal, 100 - percent, -percent))))
    least = np.minimum.accumulate(run)
    start = np.searchsorted(-least, -run[ends + 1], "left")  # the first prefix not above the sum up to here
    start = ends[np.searchsorted(ends, start)]  # and on to a match
    best = int(np.argmax(ends - start))
    return int(start[best]), int(ends[best] + 1 - start[best])


def _overlaps(held: _Block, h: np.ndarray, ends: np.ndarray, least_words: int, percent: int, any_will_do: bool = False) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """{(row, item): (words, -start in the row, start in the item, words that match)} of the rows of one slice; ``any_will_do``: of a row, the first that is found."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    row_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    done: set[int] = set()
    for here, there in held.hits(h, row_of):
        item = np.searchsorted(held.start, there, "right") - 1
        # one look at each diagonal of a row and an item, in the document's order
        for r, k, d in np.unique(np.stack((row_of[here], item, here - there)), axis=1).T.tolist():
            a, b = int(held.start[k]), int(held.start[k + 1])
            old = best.get((r, k), (0, 0, 0, 0))
            low, high = max(int(ends[r]), a + d), min(int(ends[r + 1]), b + d)
            if high - low < max(old[0], 1) or (high - low == old[0] and low - int(ends[r]) >= -old[1]) or r in done:
                continue  # nothing longer or earlier can come of it
            equal = h[low:high] == held.words[low - d : high - d]
            start, n = best_run(equal, percent)
            if n and n >= min(least_words, b - a):
                new = (n, -(low + start - int(ends[r])), low + start - d - a, int(equal[start : start + n].sum()))
                if new > old:
                    best[r, k] = new
                    if any_will_do:
                        done.add(r)
    return best


def _sized(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """The benchmark's (item_id, text), saved, and its number of blocks."""
    keys = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    sized = save(keys.withColumn("w", F.size(F.split("text", r"[^\p{L}\p{N}]+"))), "benchmark")
    return sized, max(1, -(-int(sized.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]) // BLOCK_WORDS))


def _block(sized: DataFrame, k: int, blocks: int, short: int, least_words: int, percent: int):
    """Block ``k``, broadcast."""
    rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
    h, at = plain_words(text_column(rows["text"]))
    items = [(i, h[a:b]) for i, a, b in zip(rows["item_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist())]
    return sized.sparkSession.sparkContext.broadcast(_Block(items, short, least_words, percent))


def _bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each seed in the Bloom filter."""
    return (s >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (mix(s) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _likely(docs: DataFrame, sized: DataFrame, text: str, short: int, least_words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that have a seed in the Bloom filter of all blocks."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ends = plain_words(text_column(batch.column(0)))
            masks: set[str] = set()
            found = [np.empty(0, np.int64)]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                for mask in item_masks(min(b - a, least_words), short, least_words, percent):
                    masks.add(mask)
                    found += _bits(seeds(h[a:b], mask))
            places = np.unique(np.concatenate(found))
            word, bit = places >> 6, np.left_shift(np.int64(1), places & 63)
            yield pa.record_batch([pa.array(word), pa.array(bit), pa.nulls(len(word), pa.string())], ["w", "b", "mask"])
            yield pa.record_batch([pa.nulls(len(masks), pa.int64()), pa.nulls(len(masks), pa.int64()), pa.array(sorted(masks), pa.string())], ["w", "b", "mask"])

    filled = sized.select("text").mapInArrow(fill, "w long, b long, mask string").groupBy("w", "mask").agg(F.bit_or("b").alias("b")).toArrow()  # at most the filter's words, and the masks
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    there = filled.filter(filled["w"].is_valid())
    table[there["w"].to_numpy()] = there["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((table, [m for m in filled["mask"].to_pylist() if m]))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, masks = shared.value
        for batch in batches:
            texts = text_column(batch.column(at))
            likely = np.zeros(len(texts), bool)
            for a, b in slices(texts):
                h, ends = plain_words(texts.slice(a, b - a))
                row = np.repeat(np.arange(a, b), np.diff(ends))
                for mask in masks:
                    own = seeds(h, mask)
                    one, two = _bits(own)
                    hit = (table[one >> 6] >> (one & 63) & 1) & (table[two >> 6] >> (two & 63) & 1)
                    likely[row[np.flatnonzero(hit)]] = True
            yield batch.filter(pa.array(likely))

    return docs.mapInArrow(keep, docs.schema)


_FOUND = ("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = 13, short: int = 1, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_matched) of each document and item that overlap.

    An overlap is a run of aligned words, at least ``least_words`` long or all of
    a shorter item of at least ``short`` words, that begins and ends with a match
    and in which ``percent`` of the words match; the longest of a document and an
    item is given, the earlier one on a tie. Items of fewer words than ``short``
    (without words, as the default is), null and empty texts overlap with nothing.
    Repeated document rows give repeated rows; null ids are kept as they are. Very
    long texts are read whole; other columns of either table take no part, whatever
    their names; an empty table on either side gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sized, blocks = _sized(benchmark, item_id, item_text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if blocks > 1:
        rows = save(_likely(rows, sized, "text", short, least_words, percent), "likely")
    found = None
    for k in range(blocks):
        block = _block(sized, k, blocks, short, least_words, percent)
        part = rows.mapInArrow(_scan(block, least_words, percent), ", ".join(f"{c} long" for c in _FOUND))
        if blocks > 1:  # one block after another lies on driver and executors
            part = save(part, "overlaps")
            block.destroy()
        found = part if found is None else found.unionAll(part)
    return found


def _scan(block, least_words: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in lightly(batches):
            texts, keys = text_column(batch.column(1)), batch.column(0)
            for at, to in slices(texts):
                h, ends = plain_words(texts.slice(at, to - at))
                rows = sorted(_overlaps(held, h, ends, least_words, percent).items())
                yield pa.record_batch(
                    [keys.take(pa.array([at + r for (r, _), _ in rows], pa.int64())), *(pa.array(x, pa.int64()) for x in ([int(held.ids[k]) for (_, k), _ in rows], [-v[1] for _, v in rows], [v[2] for _, v in rows], [v[0] for _, v in rows], [v[3] for _, v in rows]))],
                    list(_FOUND),
                )

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = 13, short: int = 1, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, as ``benchmark_overlaps`` tells; all columns as they are.

    Rows are judged one by one, by their texts: a repeated or null id changes
    nothing, repeated rows stay or go together, null and empty texts stay. No
    rows give no rows, and an empty benchmark takes none away.
    """
    bounded_batches(docs.sparkSession)
    sized, blocks = _sized(benchmark, item_id, item_text)
    if blocks > 1:
        key = F.xxhash64(F.col(text), F.lit(1)), F.xxhash64(F.col(text), F.lit(2))
        likely = _likely(docs.select(F.col(text).alias("text")).where("text is not null"), sized, "text", short, least_words, percent)
        likely = save(likely.select(F.xxhash64("text", F.lit(1)).alias("x"), F.xxhash64("text", F.lit(2)).alias("y"), "text").dropDuplicates(["x", "y"]), "likely")
        numbered = likely.select(F.col("x").alias("doc_id"), "text")
        bad = None
        for k in range(blocks):
            block = _block(sized, k, blocks, short, least_words, percent)
            part = save(numbered.mapInArrow(_scan(block, least_words, percent), ", ".join(f"{c} long" for c in _FOUND)).select("doc_id").distinct(), "overlaps")
            block.destroy()
            bad = part if bad is None else bad.unionAll(part)
        bad = save(likely.join(bad.withColumnRenamed("doc_id", "x").distinct(), "x", "left_semi").select("x", "y"), "bad")
        x, y = unused(docs.columns, "x", "y")
        bad = bad.select(F.col("x").alias(x), F.col("y").alias(y))
        kept = docs.withColumn(x, key[0]).withColumn(y, key[1]).join(F.broadcast(bad) if small(bad, BROADCAST_KEYS) else bad, [x, y], "left_anti")
        return kept.select(*docs.columns)
    block = _block(sized, 0, 1, short, least_words, percent)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in lightly(batches):
            texts = text_column(batch.column(at))
            clean = np.ones(len(texts), bool)
            for a, b in slices(texts):
                h, ends = plain_words(texts.slice(a, b - a))
                clean[[a + r for r, _ in _overlaps(held, h, ends, least_words, percent, any_will_do=True)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
