"""N-gram Jaccard join by grouped prefixes.

Every document is the set of its distinct word shingles. Sets are ordered from
rare to frequent shingles; two sets that reach the threshold share a shingle
within their prefixes. The steps:

1. One pass finds the shingles frequent enough to matter for that order
   (lossy counting with a proven bound on the table, see ``heavy_shingles``).
2. A second pass gives each document its size, fingerprint and prefix.
   Documents of equal sets become one class; classes of equal size and prefix
   become one group.
3. Groups meet in the buckets of their prefix shingles; pairs of groups are
   filtered by size and by position, then expanded to pairs of members. Buckets
   of few members do so in a join. A bucket of many is cut into blocks and dealt
   out as pairs of blocks, each of which filters its groups and expands them
   alike, so that no task holds a bucket and no row is made for each pair.
4. Member pairs are thinned by parity sketches (their differing bits are a lower
   bound of the symmetric difference, so nothing that reaches the threshold is
   lost) and verified exactly on the whole sets. Members of one group are
   verified as a bucket of their own. In large buckets, each member first meets
   one that stands for its bucket; whole sets are sent to pairs of blocks only
   for members that may link and that these links leave in different components.
5. Links become connected components.

Whatever the order, the result is exact: it moves only the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm.components import components
from trialframe.llm.store import bounded_batches, forget, lightly, save, small
from trialframe.llm.words import mix, shingle_sets, slices, text_column

#: At most so many shingles get a counted rank (9 bytes each where they are broadcast).
HEAVY = 1 << 20
#: Shingles that one task counts at once.
CHUNK = 1 << 20
#: A bucket of more members is dealt out in pairs of blocks.
SMALL_BUCKET = 48
#: What a block of a large bucket may cost: a member costs its shingles and EACH, so a block has 2,700 members at most and sets of 4 MB.
#: Every block is sent once for each block that it meets: smaller ones spread better, larger ones are sent less often.
BLOCK_COST, EACH = 1 << 19, 192
#: Rows of ids, sizes and fingerprints that may be broadcast (some 30 MB as a hash table).
BROADCAST_IDS = 1 << 18
_FP2 = np.uint64(0xA0761D6478BD642F)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def heavy_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and ranks (four times the binary logarithm of their counts) of the frequent shingles of all documents.

    A task reports the shingles that make up a ``HEAVY``-th of those it has
    counted. Whatever makes up two ``HEAVY``-ths of the whole is reported and
    kept; at most ``HEAVY`` can be kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = c >= max(2, size / HEAVY)
            yield pa.record_batch([pa.array(h[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["h", "c"])
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([size], pa.int64())], ["h", "c"])

        for batch in lightly(batches):
            for one in shingle_sets(text_column(batch.column(0)), width):
                held.append(one)
                size += len(one)
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    counted = save(docs.select(text).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total = counted.where("h is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    kept = counted.where(F.col("h").isNotNull() & (F.col("c") >= max(2, total / HEAVY))).toPandas()
    forget(counted)
    h, c = kept["h"].to_numpy(np.int64).view(np.uint64), kept["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], np.rint(4 * np.log2(c[order])).astype(np.uint8)


def _fingerprint(one: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(one)).view(np.int64)), int(np.add.reduce(mix(one ^ _FP2)).view(np.int64))


def _prefixes(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, p, prefix, k): p is the prefix's hash, k the set's sketch."""
    frequent = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, text, width))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, ranks = frequent.value
        for batch in lightly(batches):
            texts, ids = text_column(batch.column(1)), batch.column(0)
            for at, to in slices(texts):
                n, f1, f2, p, prefix, k = [], [], [], [], [], []
                for one in shingle_sets(texts.slice(at, to - at), width):
                    n.append(len(one))
                    if not len(one):
                        f1.append(0), f2.append(0), p.append(0), prefix.append(one.view(np.int64)), k.append(b"")
                        continue
                    rank = np.zeros(len(one), np.uint8)
                    if len(heavy):
                        at_ = np.minimum(np.searchsorted(heavy, one), len(heavy) - 1)
                        rank = np.where(heavy[at_] == one, ranks[at_], 0)
                    first = one[np.lexsort((one, rank))[: prefix_length(len(one), percent)]]
                    a, b = _fingerprint(one)
                    f1.append(a), f2.append(b), p.append(_fingerprint(first)[0]), prefix.append(first.view(np.int64)), k.append(sketch(one).tobytes())
                yield pa.record_batch(
                    [ids.slice(at, to - at), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(p, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(k, pa.binary())],
                    ["id", "n", "f1", "f2", "p", "prefix", "k"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "id long, n long, f1 long, f2 long, p long, prefix array<long>, k binary")


def sketch(one: np.ndarray) -> np.ndarray:
    """Parities of the hashes that fall on each of 64 to 65,536 bits, about one or two bits a member."""
    bits = min(1 << 16, max(64, 1 << int(len(one) - 1).bit_length()))
    odd = np.bincount((one & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd)


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        half = x.reshape(2, -1)
        x = half[0] ^ half[1]
    return x


def may_reach(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
    """Whether the sketches leave it possible that the sets reach the threshold."""
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sets(docs: DataFrame, needed: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, s): sets of the classes in ``needed(class, id, f1)``, ``id`` being a document's; a repeated row gives a repeated set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lightly(batches):
            texts, ids, want = text_column(batch.column(1)), batch.column(0), batch.column(2).to_pylist()
            for at, to in slices(texts, 1 << 20):
                keep, s = [], []
                for i, one in enumerate(shingle_sets(texts.slice(at, to - at), width), at):
                    if _fingerprint(one)[0] == want[i]:  # another row of the same id may have another text
                        keep.append(i), s.append(one.tobytes())
                yield pa.record_batch([ids.take(pa.array(keep, pa.int64())), pa.array(s, pa.binary())], ["id", "s"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    if small(needed, BROADCAST_IDS):
        needed = F.broadcast(needed)
    return rows.join(needed, "id").select("class", "text", "f1").mapInArrow(of, "id long, s binary")


def _thin_pairs(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` that the sketches leave possible."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, ka, kb = (batch.column(i).to_pylist() for i in range(2, 6))
            kept = [i for i in range(len(na)) if may_reach(np.frombuffer(ka[i], np.uint8), np.frombuffer(kb[i], np.uint8), na[i], nb[i], percent)]
            kept = pa.array(kept, pa.int64())
            yield pa.record_batch([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])

    one = marks.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"))
    two = marks.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(thin, "a long, b long")


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs(a, b)``, verified on the sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            kept = [i for i in range(batch.num_rows) if reaches(np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64), percent)]
            kept = pa.array(kept, pa.int64())
            yield pa.record_batch([batch.column(0).take(kept), batch.column(1).take(kept)], ["u", "w"])

    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return with_sets.select("a", "b", "sa", "sb").mapInArrow(verify, "u long, w long")


def _deal_blocks(members: DataFrame, percent: int) -> DataFrame:
    """``members(t, own, g, n, pos, id)`` with (x, y, block): each of a bucket's pairs of blocks whose sizes allow a link.

    Blocks are laid out on the members' counts by (bucket, size); a size of many
    members is spread over several blocks by the hash of their id.
    """
    cost = F.col("m") * (F.col("n") + EACH)
    up = F.sum(cost).over(Window.partitionBy("t", "own").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    laid = members.groupBy("t", "own", "n").agg(F.count("*").alias("m"))
    laid = laid.select("t", "own", "n", F.floor((up - cost) / BLOCK_COST).alias("first"), F.floor((up - 1) / BLOCK_COST).alias("last"))
    laid = save(laid, "layout")
    blocks = members.join(F.broadcast(laid) if small(laid, BROADCAST_IDS) else laid, ["t", "own", "n"])
    blocks = blocks.withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1)).drop("first", "last")
    span = laid.select("t", "own", "n", F.explode(F.sequence("first", "last")).alias("block")).groupBy("t", "own", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    one, two = (span.select("t", "own", F.col("block").alias(b), F.col("least").alias(f"least_{b}"), F.col("most").alias(f"most_{b}")) for b in "xy")
    paired = one.join(two, ["t", "own"]).where((F.col("x") <= F.col("y")) & (F.col("most_x") * 100 >= F.col("least_y") * percent))
    dealt = paired.select("t", "own", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return blocks.join(dealt, ["t", "own", "block"])


class _Pair:
    """A pair of blocks (or one block twice), sorted by block, size, group and id."""

    def __init__(self, key: tuple[pa.Scalar, ...], table: pa.Table, value: str, percent: int):
        self.own, self.apart, self.percent = key[1].as_py(), key[2].as_py() != key[3].as_py(), percent
        columns = {c: table[c].to_numpy() for c in ("block", "n", "g", "id")}
        order = np.lexsort((columns["id"], columns["g"], columns["n"], columns["block"]))
        self.rows = table.drop_columns(["block", "x", "y", value]).take(pa.array(order))
        self.n, self.group, self.ids = (columns[c][order] for c in ("n", "g", "id"))
        self.pos = table["pos"].to_numpy()[order]
        self.values = [table[value][int(i)].as_buffer() for i in order]
        self.left = int((columns["block"] == key[2].as_py()).sum()) if self.apart else len(order)

    def partners(self, marks: list[np.ndarray], label: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Members of the first block, each with the later ones that size, position and sketches leave possible, the likest first.

        Groups are filtered once for all their members. Members of equal ``label``
        (which may change meanwhile) are left out.
        """
        n, percent = self.n, self.percent
        narrow = min(map(len, marks))
        folded = np.stack([_fold(m, narrow) for m in marks])
        runs = np.flatnonzero(np.diff(self.group[: self.left], prepend=self.group[0] - 1)) if self.left else []
        for at, to in zip(runs, [*runs[1:], self.left]):
            group = np.arange(self.left if self.apart else at if self.own else to, len(n))
            a, b = n[at], n[group]
            rest = np.minimum(a - self.pos[at], b - self.pos[group]) + np.minimum(self.pos[at], self.pos[group])
            fits = (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (rest * (100 + percent) >= (a + b) * percent)
            group = group[fits if self.own else fits & (self.group[group] != self.group[at])]
            for i in range(at, to if len(group) else at):
                after = group if self.apart else group[group > i]
                if label is not None:
                    after = after[label[after] != label[i]]
                if not len(after):
                    continue
                differ = np.bitwise_count(folded[after] ^ folded[i]).sum(axis=1, dtype=np.int64)
                possible = differ * (100 + percent) <= (n[after] + n[i]) * (100 - percent)
                after = after[possible][np.argsort(differ[possible], kind="stable")]
                if narrow < len(marks[i]):
                    after = np.array([j for j in after.tolist() if may_reach(marks[i], marks[j], int(n[i]), int(n[j]), percent)], np.int64)
                if len(after):
                    yield i, after


def _thin_blocks(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The ``members`` to whom size, position and sketches leave a partner in their bucket; a row for each at most, not for each pair.

    Where members have a ``label``, a partner is one of another label.
    """

    def thin(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pair = _Pair(key, table, "k", percent)
        kept = np.zeros(len(pair.ids), bool)
        label = pair.rows["label"].to_numpy() if "label" in names else None
        for i, after in pair.partners([np.frombuffer(x, np.uint8) for x in pair.values], label):
            kept[i] = True
            kept[after] = True
            if kept.all():
                break
        return pair.rows.filter(pa.array(kept)).select(names)

    names = [c for c in ("t", "own", "g", "n", "pos", "id", "label") if c in members.columns]
    rows = _deal_blocks(members, percent).join(marks.select("id", "k"), "id").select(*names, "block", "x", "y", "k")
    return rows.groupBy("t", "own", "x", "y").applyInArrow(thin, members.select(*names).schema).distinct()


def _verify_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the ``members`` of large buckets: with those of equal ``label`` taken as connected, a spanning forest for each pair of blocks."""

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pair = _Pair(key, table, "s", percent)
        held = [np.frombuffer(x, np.uint64) for x in pair.values]
        label = pair.rows["label"].to_numpy().copy()
        u, w = [], []
        for i, after in pair.partners([sketch(one) for one in held], label):
            for j in after.tolist():
                if label[j] != label[i] and reaches(held[i], held[j], percent):
                    label[label == label[j]] = label[i]
                    u.append(int(pair.ids[i])), w.append(int(pair.ids[j]))
            if (label == label[0]).all():
                break
        return pa.table({"u": pa.array(u, pa.int64()), "w": pa.array(w, pa.int64())})

    rows = _deal_blocks(members, percent).join(sets, "id").select("t", "own", "g", "n", "pos", "id", "label", "block", "x", "y", "s")
    return rows.groupBy("t", "own", "x", "y").applyInArrow(verify, "u long, w long")


def _each_once(members: DataFrame) -> DataFrame:
    """Of buckets with the same members, one."""
    same = members.groupBy("t", "own").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.count("*").alias("c"))
    once = same.groupBy("own", "x", "y", "c").agg(F.min("t").alias("t")).select("t", "own")
    return members.join(once, ["t", "own"]).select(*members.columns)


def _hubs(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each member b the smallest of its buckets' first members that the sketches leave possible."""
    first = members.groupBy("t", "own").agg(F.min("id").alias("a"))
    pairs = members.join(first, ["t", "own"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    return _thin_pairs(pairs, marks, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def _still_apart(members: DataFrame, reached: DataFrame) -> DataFrame:
    """``members`` of the buckets that hold more than one component, with their component as ``label``."""
    labelled = members.join(reached, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed = labelled.groupBy("t", "own").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least < _most")
    return labelled.join(mixed.select("t", "own"), ["t", "own"]).select(*members.columns, "label")


def ngram_jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``.

    Words are what stands between ASCII white space, with A-Z lower-cased; a
    text of fewer than ``width`` words is one shingle. Two rows link when their
    sets' Jaccard similarity is at least ``percent``/100. ``class_id`` is the
    smallest id with an equal set, ``component_id`` the smallest id that links
    reach. Texts without words (null, empty, white space) link with nothing and
    keep their own id. Rows of equal id are joined in one component only where
    their sets link; a row of null id is returned with nulls for class and
    component. Input columns other than the two named take no part.

    Only components are given. Links are neither returned nor counted: in large
    buckets a pair already connected is not verified, which leaves the components
    as they are and a spanning forest of the links.
    """
    bounded_batches(docs.sparkSession)
    table = save(_prefixes(docs, doc_id, text, width, percent), "prefixes")
    full = table.where("id is not null and n > 0")
    repeats = table.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0
    classes = full.groupBy("n", "f1", "f2").agg(F.min("id").alias("doc"), F.first("p").alias("p"))
    # a class is known by its document; only where ids repeat, and so may stand for several sets, by a hash
    classes = save(classes.withColumn("id", F.xxhash64("doc", "n", "f1", "f2") if repeats else F.col("doc")), "classes")
    groups = classes.groupBy("n", "p").agg(F.min("id").alias("g"), F.count("*").alias("members"))
    member = classes.join(groups, ["n", "p"]).select("g", "id", "n", "members")
    few_classes = small(classes, BROADCAST_IDS)

    def bounded(rows: DataFrame, few: bool) -> DataFrame:
        return F.broadcast(rows) if few else rows

    own_row = classes.select(F.col("id").alias("class"), F.col("doc").alias("id"), "n", "f1", "f2")
    reps = full.join(bounded(own_row, few_classes), ["id", "n", "f1", "f2"]).select(F.col("class").alias("id"), "n", "p", "prefix", "k")
    reps = reps.dropDuplicates(["id"]) if repeats else reps
    marks = reps.select("id", "n", "k")

    # group rows by prefix shingle, with the bucket's number of members; counted first, so that no task needs a whole bucket
    listed = reps.join(bounded(groups.withColumnRenamed("g", "id"), few_classes), ["id", "n", "p"])
    listed = listed.select(F.col("id").alias("g"), "n", "members", F.posexplode("prefix").alias("pos", "t"))
    counts = save(listed.groupBy("t").agg(F.count("*").alias("groups"), F.sum("members").alias("size")).where("groups > 1").select("t", "size"), "counts")
    bucket = save(listed.join(counts, "t"), "buckets")
    forget(counts)
    few = bucket.where(F.col("size") <= SMALL_BUCKET)
    one, two = few.alias("one"), few.alias("two")
    up = F.least("one.n", "two.n") * 100 >= F.greatest("one.n", "two.n") * percent
    rest = F.least(F.col("one.n") - F.col("one.pos"), F.col("two.n") - F.col("two.pos")) + F.least("one.pos", "two.pos")
    near = rest * (100 + percent) >= (F.col("one.n") + F.col("two.n")) * percent
    found = one.join(two, (F.col("one.t") == F.col("two.t")) & (F.col("one.g") < F.col("two.g")) & up & near)
    group_pairs = found.select(F.col("one.g").alias("g"), F.col("two.g").alias("h")).distinct()
    inner = member.select("g", F.col("id").alias("a"))
    pairs = group_pairs.join(inner, "g").join(inner.select(F.col("g").alias("h"), F.col("a").alias("b")), "h").select("a", "b")
    pairs = save(_thin_pairs(pairs, marks, percent), "pairs")

    # large buckets, each set of groups once, and the members of one group
    many = bucket.where(F.col("size") > SMALL_BUCKET)
    alike = many.groupBy("t").agg(F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y"), F.count("*").alias("c"))
    alike = save(alike.groupBy("x", "y", "c").agg(F.min("t").alias("t")).select("t"), "alike")
    many = many.join(bounded(alike, small(alike, BROADCAST_IDS)), "t")
    large = many.drop("members").join(member, ["g", "n"]).select("t", F.lit(False).alias("own"), "g", "n", "pos", "id")
    own = member.where("members > 1").select(F.col("g").alias("t"), F.lit(True).alias("own"), "g", "n", F.lit(0).alias("pos"), "id")
    members = save(large.unionAll(own), "members")
    thinned = save(_thin_blocks(members, marks, percent), "thinned")
    # what is left of the buckets of near copies is the same members again and again: each set of them once
    large = save(_each_once(thinned), "blocks")
    hubs = save(_hubs(large, marks, percent), "hubs")
    near_pairs = pairs.unionAll(hubs)

    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).unionAll(large.select("id")).distinct()
    needed = save(classes.join(ids, "id").select(F.col("id").alias("class"), F.col("doc").alias("id"), "f1"), "needed")
    sets = _sets(docs, needed, doc_id, text, width)
    sets = save(sets.dropDuplicates(["id"]) if repeats else sets, "sets")
    # whole sets go to pairs of blocks only for members that may link and are not connected by then
    first = save(components(_verify_pairs(near_pairs, sets, percent)), "reached")
    apart = save(_still_apart(large, first), "apart")
    apart_thinned = save(_thin_blocks(apart, marks, percent), "apart")
    own_sets = sets.join(F.broadcast(apart_thinned.select("id").distinct()), "id", "left_semi") if small(apart_thinned, BROADCAST_IDS) else sets
    links = _verify_blocks(_each_once(apart_thinned), own_sets, percent)
    reached = components(first.select(F.col("id").alias("u"), F.col("component").alias("w")).unionAll(links))
    for done in (alike, members, thinned, pairs, large, hubs, needed, sets, bucket, first, apart, apart_thinned):
        forget(done)
    label = classes.join(reached, "id", "left").select("n", "f1", "f2", F.col("doc").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    if repeats:
        least = label.groupBy("component_id").agg(F.min("class_id").alias("least"))
        label = label.join(least, "component_id").withColumn("component_id", F.col("least")).drop("least")
    some = table.where("n > 0").select("id", "n", "f1", "f2").join(label, ["n", "f1", "f2"], "left")
    alone = table.where("n = 0").select("n", "f1", "f2", "id", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    out = some.select("n", "f1", "f2", "id", "class_id", "component_id").unionAll(alone)
    known = F.col("id").isNotNull()
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("component_id")).alias("component_id"))
