"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Every word starts a suffix of at most ``width`` words within its piece. Suffixes are
routed to buckets by their two leading words; in a bucket, pointers to them are
parted around a pivot's word into smaller, equal and greater ones, the equal part
goes on with the next word, and the size of an equal part is the number of
occurrences of the words so far. Parts of fewer than ``least`` occurrences are
abandoned at once, whatever would follow.

All parts of a bucket are split in the same pass over its pointers, so the sort is
a few dozen numpy passes instead of a recursion for each phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches, lightly, save, small
from trialframe.llm.words import SLICE_BYTES, hash_words, mix, text_column

#: Words whose suffixes a task gathers before it passes them on, each different one once.
CHUNK_WORDS = 1_000_000
#: Suffixes that a bucket is made for.
BUCKET_WORDS = 1_000_000
#: A word is heavy if its suffixes alone would fill a bucket and it is at least one word in so many; two heavy leading words do not route a suffix alone.
HEAVY = 1 << 16
#: Counted phrases up to which look-ups are broadcast.
BROADCAST_PHRASES = 200_000
#: Bytes of suffixes in one row on their way to a bucket, at most.
ROW_BYTES = 2 << 20

#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pieces_of(texts: pa.LargeStringArray) -> Iterator[tuple[int, int, int]]:
    """(first row, first byte, last byte) of stretches of about SLICE_BYTES that end at a row's end or between words."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, stop = int(ends[0]), int(ends[-1])
    while at < stop:
        to = min(stop, at + SLICE_BYTES)
        while to < stop and _KIND[data[to]] == 0:
            step = np.flatnonzero(_KIND[data[to : to + 4096]])
            to = min(stop, to + (int(step[0]) if len(step) else 4096))
        yield int(np.searchsorted(ends, at, "right")) - 1, at, to
        at = to


def words_and_pieces(texts: pa.LargeStringArray) -> Iterator[tuple[pa.LargeStringArray, np.ndarray, np.ndarray]]:
    """(words, each word's row, whether it starts a piece) of stretches of the texts, A-Z lower-cased.

    A word at the beginning of a stretch starts a piece only if the text or piece
    before it ended there, so phrases go on over stretches.
    """
    texts = pc.ascii_lower(texts)
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row_before, open_break = -1, True
    for _, at, to in _pieces_of(texts):
        kind = _KIND[data[at:to]]
        inside = kind == 0
        begins = np.zeros(to - at + 1, bool)
        own = ends[(ends >= at) & (ends <= to)] - at
        begins[own] = True
        start = inside & begins[:-1]
        start[0] |= inside[0]
        start[1:] |= inside[1:] & ~inside[:-1]
        first = np.flatnonzero(start)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begins[1:-1]
        last = np.flatnonzero(last)
        rows = np.searchsorted(ends, first + at, "right") - 1
        breaks = np.cumsum(kind == 2)
        new = np.empty(len(first), bool)
        if len(first):
            b = breaks[first]
            new[1:] = (b[1:] != b[:-1]) | (rows[1:] != rows[:-1])
            new[0] = open_break or b[0] > 0 or rows[0] != row_before
            row_before, open_break = int(rows[-1]), bool(breaks[-1] > b[-1])
        elif len(breaks):
            open_break = open_break or bool(breaks[-1])
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first + 1, out=offsets[1:])
        yield pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[at:to][inside])), rows, new


class _Chunks:
    """Words of a task's rows, given on some at a time; the last ``width - 1`` words of a chunk open the next one."""

    def __init__(self, width: int, size: int) -> None:
        self.width, self.size, self.held, self.n = width, size, [], 0
        self.langs: dict[str, int] = {}

    def take(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.LargeStringArray, np.ndarray, np.ndarray, int]]:
        """(words, number of each word's language, starts of pieces, words whose suffixes end in the chunk) of batches (text, language)."""
        for batch in batches:
            coded = text_column(batch.column(1)).dictionary_encode()
            number = np.asarray([self.langs.setdefault(x, len(self.langs)) for x in coded.dictionary.to_pylist()], np.int64)
            langs = number[coded.indices.to_numpy()]
            for words, rows, new in words_and_pieces(text_column(batch.column(0))):
                if len(words):
                    self.held.append((words, langs[rows], new))
                    self.n += len(words)
                if self.n >= self.size:
                    yield self._give(self.width - 1)
        if self.n:
            yield self._give(0)

    def kinds(self) -> pa.LargeStringArray:
        """The languages by number."""
        return pa.array(list(self.langs), pa.large_string())

    def _give(self, back: int):
        words, langs, new = pa.concat_arrays([h[0] for h in self.held]), *(np.concatenate([h[i] for h in self.held]) for i in (1, 2))
        done = max(1, len(words) - back)
        self.held = [(pa.concat_arrays([words.slice(done)]), langs[done:], new[done:])] if done < len(words) else []
        self.n = len(words) - done
        return words, langs, new, done


def _coded(words: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """(codes, distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _suffixes(codes: np.ndarray, new: np.ndarray, done: int, width: int) -> list[np.ndarray]:
    """The words at places 0 to width - 1 of each suffix, from 1; 0 where the piece has ended."""
    out, open_ = [codes[:done] + 1], np.ones(done, bool)
    for k in range(1, width):
        there = np.zeros(done, np.int64)
        m = max(0, min(done, len(codes) - k))
        goes = open_[:m] & ~new[k : k + m]
        there[:m] = np.where(goes, codes[k : k + m] + 1, 0)
        open_ = np.concatenate((goes, np.zeros(done - m, bool)))
        out.append(there)
    return out


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, how often each occurs) of columns with values below ``sizes``."""
    space = 1
    for s in sizes:
        space *= s
    if space < 1 << 63:
        packed = columns[0]
        for c, s in zip(columns[1:], sizes[1:]):
            packed = packed * s + c
        packed.sort()
        first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        rest, rows = packed[first], []
        for s in reversed(sizes[1:]):
            rest, own = np.divmod(rest, s)
            rows.append(own)
        rows.append(rest)
        return np.column_stack(rows[::-1]), np.diff(np.concatenate((first, [len(packed)])))
    order = np.lexsort(columns[::-1])
    table = np.column_stack([c[order] for c in columns])
    first = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1))))
    return table[first], np.diff(np.concatenate((first, [len(table)])))


def frequent_prefixes(keys: np.ndarray, weights: np.ndarray, least: int, report: int, split: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a pointer for each part, its weight) of all prefixes of ``report`` keys or more that weigh ``least``.

    ``keys`` has a row for each suffix, 0 past its end. Rows marked in ``split`` have
    others like them elsewhere as far as their first ``report`` keys: prefixes of these
    are given whatever they weigh here. Each pass parts all open parts around their
    middle pointers' keys.
    """
    n, width = keys.shape
    flat, pointer = keys.ravel(), np.arange(n)
    sizes, depth = np.asarray([n] if n else [], np.int64), np.zeros(1 if n else 0, np.int64)
    while len(sizes):
        ends = np.cumsum(sizes)
        begins = ends - sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        pivot = flat[pointer[begins + sizes // 2] * width + depth]
        key = flat[pointer * width + depth[part]]
        side = (key >= pivot[part]).astype(np.int64) + (key > pivot[part])
        group = part * 3 + side
        count = np.bincount(group, minlength=3 * len(sizes))
        weight = np.bincount(group, weights[pointer], minlength=3 * len(sizes)).astype(np.int64)
        place = np.empty(len(pointer), np.int64)
        starts = np.cumsum(count) - count
        for s in range(3):
            mine = side == s
            ahead = np.cumsum(mine) - mine
            place[mine] = starts[group[mine]] + (ahead - ahead[begins][part])[mine]
        moved = np.empty_like(pointer)
        moved[place] = pointer
        new_depth = np.repeat(depth, 3)
        equal = np.arange(len(count)) % 3 == 1
        new_depth[equal] += 1
        alive = weight >= least
        if split is not None:
            marked = np.bincount(group, split[pointer], minlength=len(count)) > 0
            alive |= marked & ((new_depth < report) | equal & (new_depth == report))
        found = equal & alive & (new_depth >= report) & np.repeat(pivot != 0, 3)
        if found.any():
            for d in range(report, width + 1):
                own = np.flatnonzero(found & (new_depth == d))
                if len(own):
                    yield d, moved[starts[own]], weight[own]
        past = new_depth == report if split is not None else np.zeros(len(count), bool)
        alive &= ~(equal & ((new_depth == width) | np.repeat(pivot == 0, 3)))
        alive &= ~(past & equal & (weight < least))
        alive &= count > 0
        keep = np.repeat(alive, count)
        pointer, sizes, depth = moved[keep], count[alive], new_depth[alive]


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, word, f): occurrences of every word in its language (null: ``und``)."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(1, chunk_words)
        for words, langs, _, _ in chunks.take(lightly(batches)):
            (c, names), kinds = _coded(words), chunks.kinds()
            rows, f = _distinct([langs, c], [len(kinds), len(names)])
            for at in range(0, len(f), 50_000):
                own = rows[at : at + 50_000]
                yield pa.record_batch([kinds.take(pa.array(own[:, 0])).cast(pa.string()), names.take(pa.array(own[:, 1])).cast(pa.string()), pa.array(f[at : at + 50_000])], ["lang", "word", "f"])

    found = _texts(docs, text, lang).mapInArrow(count, "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("x"), F.coalesce(F.col(lang), F.lit("und")).alias("l")).where("x <> ''")


def phrase_counts(docs: DataFrame, words: DataFrame, width: int = 3, least: int = 10, text: str = "text", lang: str = "lang", chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS, heavy: int = HEAVY) -> DataFrame:
    """(lang, phrase, words, a) of all phrases of two to ``width`` words that occur ``least`` times in their language.

    ``words`` are the counts of single words (lang, word, f). Tasks pass each
    different suffix of a chunk on once, with its number; suffixes that two heavy
    words lead are spread over buckets by all their words, and the parts of such a
    pair's count are added afterwards. At most ``heavy`` words are heavy, so a pair that
    is not spread has no more suffixes than a bucket is made for, or one in ``heavy``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    total = words.agg(F.sum("f")).first()[0] or 0
    common = words.where(F.col("f") >= max(bucket_words, -(-total // heavy), 1)).select("lang", "word").collect()  # at most ``heavy`` rows
    hot = spark.sparkContext.broadcast({lang: pa.array([r.word for r in common if r.lang == lang], pa.large_string()) for lang in {r.lang for r in common}})
    buckets = max(1, -(-total // bucket_words))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(width, chunk_words)
        for words, langs, new, done in chunks.take(lightly(batches)):
            (c, names), kinds = _coded(words), chunks.kinds()
            rows, n = _distinct([langs[:done], *_suffixes(c, new, done, width)], [len(kinds), *[len(names) + 1] * width])
            pairs = rows[:, 2] > 0
            rows, n = rows[pairs], n[pairs]
            bucket = _buckets(rows, kinds, names, hot.value, buckets)
            order = np.argsort(bucket, kind="stable")
            rows, n, bucket = rows[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(0, np.int64)
            out, held = [], 0
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                step = ROW_BYTES // (4 * (width + 2))
                for at in range(a, b, step):
                    own = np.column_stack((rows[at : min(b, at + step)], n[at : min(b, at + step)])).astype(np.int32)
                    used, places = np.unique(own[:, 1:-1], return_inverse=True)
                    own[:, 1:-1] = places.reshape(len(own), width) + (used[0] > 0)  # past the end stays 0
                    used = used[used > 0]
                    out.append((int(bucket[at]), kinds, names.take(pa.array(used - 1)), own.tobytes()))
                    held += own.nbytes
                    if held >= ROW_BYTES:
                        yield _routed(out)
                        out, held = [], 0
            if out:
                yield _routed(out)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in lightly(batches):
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if held and bucket != now:
                    yield from _sorted(held, width, least, hot.value)
                    held = []
                now = bucket
                held.append((batch.column("langs")[i].values, batch.column("words")[i].values, np.frombuffer(batch.column("suffixes")[i].as_py(), np.int32).reshape(-1, width + 2)))
        if held:
            yield from _sorted(held, width, least, hot.value)

    routed = _texts(docs, text, lang).mapInArrow(route, "bucket long, langs array<string>, words array<string>, suffixes binary")
    counted = routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "lang string, phrase string, words int, a long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _buckets(rows: np.ndarray, kinds: pa.Array, names: pa.Array, hot: dict[str, pa.Array], buckets: int) -> np.ndarray:
    """The bucket of each suffix."""
    own_lang, own_word = hash_words(kinds), np.concatenate((np.zeros(1, np.uint64), hash_words(names)))
    split = _led_by_two(rows, kinds, names, hot)
    with np.errstate(over="ignore"):
        h = mix(own_lang[rows[:, 0]] * _STEP + own_word[rows[:, 1]])
        h = mix(h * _STEP + own_word[rows[:, 2]])
        for k in range(3, rows.shape[1]):
            h = np.where(split, mix(h * _STEP + own_word[rows[:, k]]), h)
    return (h % np.uint64(buckets)).astype(np.int64)


def _led_by_two(rows: np.ndarray, kinds: pa.Array, names: pa.Array, hot: dict[str, pa.Array]) -> np.ndarray:
    """Whether the suffix's two leading words are heavy in its language."""
    split = np.zeros(len(rows), bool)
    for i, kind in enumerate(kinds.to_pylist()):
        if kind in hot:
            heavy = np.concatenate(([False], pc.is_in(names, value_set=hot[kind]).to_numpy(zero_copy_only=False)))
            split |= (rows[:, 0] == i) & heavy[rows[:, 1]] & heavy[rows[:, 2]]
    return split


def _routed(out: list[tuple]) -> pa.RecordBatch:
    def lists(values: list[pa.Array]) -> pa.ListArray:
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([v.cast(pa.string()) for v in values]))

    return pa.record_batch([pa.array([o[0] for o in out], pa.int64()), lists([o[1] for o in out]), lists([o[2] for o in out]), pa.array([o[3] for o in out], pa.binary())], ["bucket", "langs", "words", "suffixes"])


def _sorted(held: list[tuple], width: int, least: int, hot: set) -> Iterator[pa.RecordBatch]:
    """The frequent phrases of one bucket."""
    langs, names = (pa.concat_arrays([h[i].cast(pa.large_string()) for h in held]) for i in (0, 1))
    (l, kinds), (c, names) = _coded(langs), _coded(names)
    keys, weights, at_lang, at_word = [], [], 0, 0
    for own_langs, own_words, table in held:
        keys.append(np.column_stack((l[at_lang : at_lang + len(own_langs)][table[:, 0]] + 1, np.concatenate(([0], c[at_word : at_word + len(own_words)] + 1))[table[:, 1:-1]])).astype(np.int32))
        weights.append(table[:, -1].astype(np.int64))
        at_lang, at_word = at_lang + len(own_langs), at_word + len(own_words)
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    split = _led_by_two(np.column_stack((keys[:, 0] - 1, keys[:, 1:3])), kinds, names, hot)
    for depth, pointers, weight in frequent_prefixes(keys, weights, least, 3, split if split.any() else None):
        for at in range(0, len(pointers), 50_000):
            own = keys[pointers[at : at + 50_000]]
            phrase = pc.binary_join_element_wise(*[names.take(pa.array(own[:, k] - 1)) for k in range(1, depth)], pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.record_batch([kinds.take(pa.array(own[:, 0] - 1)).cast(pa.string()), phrase, pa.array(np.full(len(own), depth - 1, np.int32)), pa.array(weight[at : at + 50_000])], ["lang", "phrase", "words", "a"])


def _words(of: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(of, first, size), " ")


def exact_score(a: str, l: str, r: str) -> Column:
    """a * a / (l * r) in millionths, rounded down, for counts below 10**16; the products have more than 64 bits."""
    wide = [f"cast({c} as decimal(16,0))" for c in (a, a, l, r)]
    return F.expr(f"({wide[0]} * {wide[1]} * 1000000BD) div ({wide[2]} * {wide[3]})")


def collocations(docs: DataFrame, width: int = 3, least: int = 10, inside: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to ``width`` words.

    Texts are split at ``[.,;:!?]`` and line breaks into pieces, these at blanks and tabs
    into words, A-Z lower-cased. A phrase that occurs a times (``least`` or more) and is cut
    into parts that occur l and r times scores a * a / (l * r) in millionths, rounded down,
    for the cut where that is least, the earliest of these. A phrase is dropped if a longer
    one of these phrases holds it and occurs in ``inside`` percent of its places or more.
    Ties in the score go by occurrences, then by the phrase's bytes; ``n`` is the number of
    words of the language. Null texts have no words, a null language is ``und``; repeated
    rows count again, very long texts are read whole, other columns take no part and no
    rows give none.
    """
    words = save(word_counts(docs, text, lang), "word-counts")
    phrases = save(phrase_counts(docs, words, width, least, text, lang), "phrase-counts")
    known = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").unionAll(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    near = F.broadcast if small(known, BROADCAST_PHRASES) else (lambda df: df)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))

    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _words(w, 1, F.col("k")), "right": _words(w, F.col("k") + 1, F.col("words") - F.col("k"))})
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(near(known.select("lang", F.col("part").alias(side), F.col("f").alias(count))), ["lang", side])
    cuts = cuts.withColumn("score", exact_score("a", "l", "r"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(least_cut).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")

    starts = F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)
    longer = phrases.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    held = longer.withColumn("at", F.explode(starts)).select("lang", _words(w, F.col("at"), F.col("size")).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.expr(f"_longer is null or cast(_longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(inside)}"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(n), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
