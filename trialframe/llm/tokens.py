"""Token pieces of documents, with one tokenizer per Python worker.

White space always separates tokens in the vocabularies used here, so a text's
ids are the ids of its words one after another. Each distinct word of a slice is
looked up in the worker's table, by its 64-bit hash, and goes to the tokenizer only
when it is new. The table is a few numpy arrays, some 30 bytes a word.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches, lightly
from trialframe.llm.words import hash_words, slices, text_column

#: Words that a worker remembers at most, the latest used ones.
REMEMBERED = 1_000_000
#: New words that go to the tokenizer at once.
NEW_WORDS = 8_192
#: Bytes of text whose words are looked up at once; a larger slice repeats fewer words.
SLICE = 2 << 20
#: Marks between which a word's letters may stand; each is a token run of its own.
_MARKS = ".,;:!?\"()[]{}#$%&*|-/+=<>~^_`@\\"
#: Letters whose lower case depends on their place or is longer than one letter.
_ODD = frozenset("Σİ")


class WordIds:
    """Ids of words by the tokenizer in ``file``."""

    _open: dict[str, WordIds] = {}

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.flat = np.empty(0, np.uint32)  # ids of all words
        self.keys = np.empty(0, np.uint64)  # sorted hashes; of each, its place and number of ids, and when it was last used
        self.start, self.size, self.used = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.now = 0

    @classmethod
    def of(cls, file: str) -> WordIds:
        if file not in cls._open:
            cls._open[file] = cls(file)
        return cls._open[file]

    def _parts(self, word: str) -> tuple[str, ...]:
        """Marks before, letters in lower case, marks after; any other word is one part."""
        core = word.strip(_MARKS)
        if not core.isalpha() or not _ODD.isdisjoint(core) or any(a in word for a in self.added):
            return (word,)
        at = word.find(core)
        return tuple(x for x in (word[:at], core.lower(), word[at + len(core) :]) if x)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there) of each hash."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def _add(self, h: np.ndarray, ids: list[bytes]) -> None:
        h, first = np.unique(h, return_index=True)
        ids = [ids[i] for i in first.tolist()]
        size = np.fromiter((len(x) >> 2 for x in ids), np.int32, len(ids))
        start = (len(self.flat) + np.cumsum(size) - size).astype(np.int32)
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), np.uint32)))
        at = np.searchsorted(self.keys, h)
        self.keys, self.start, self.size = np.insert(self.keys, at, h), np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.used = np.insert(self.used, at, self.now)

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        parts = [self._parts(w) for w in words]
        pieces = list({x for p in parts for x in p})
        hashes = hash_words(pa.array(pieces, pa.large_string()))
        at, there = self._find(hashes)
        ids: dict[str, bytes] = {pieces[i]: self.flat[self.start[k] : self.start[k] + self.size[k]].tobytes() for i, k in zip(np.flatnonzero(there).tolist(), at[there].tolist())}
        ask = np.flatnonzero(~there)
        some = [pieces[i] for i in ask.tolist()]
        for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            ids[x] = array("I", e.ids).tobytes()
        new = np.concatenate((hashes[ask], h))
        made = [ids[pieces[i]] for i in ask.tolist()] + [b"".join([ids[x] for x in p]) for p in parts]
        self._add(new, made)

    def _forget(self) -> None:
        """Leaves the half of the table that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        self.keys, self.size, self.used, start = self.keys[keep], self.size[keep], self.used[keep], self.start[keep]
        end = np.cumsum(self.size, dtype=np.int64)
        place = np.repeat(start - (end - self.size), self.size) + np.arange(int(end[-1]) if len(end) else 0)
        self.flat, self.start = self.flat[place], (end - self.size).astype(np.int32)

    def look_up(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, number of ids) of each of the distinct ``words``."""
        self.now += 1
        if len(self.keys) > REMEMBERED:
            self._forget()
        h = hash_words(words)
        at, there = self._find(h)
        if not there.all():
            new = np.flatnonzero(~there)
            for begin in range(0, len(new), NEW_WORDS):  # strings and encodings are far larger than ids
                some = new[begin : begin + NEW_WORDS]
                self._learn(words.take(pa.array(some)).to_pylist(), h[some])
            at, _ = self._find(h)
        self.used[at] = self.now
        return self.start[at], self.size[at]

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's offsets among them)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        at = np.asarray(lists.offsets).astype(np.int64)
        at -= at[0]
        begin, size = self.look_up(coded.dictionary)
        which = np.asarray(coded.indices)
        n = size[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat(begin[which] - ends[:-1].astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.flat[place] if len(which) else np.empty(0, np.uint32)
        return ids, ends[at]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have about SLICE bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def token_pieces(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``.

    A document is its token ids and then ``end_id``; one longer than ``capacity``
    is cut into pieces of ``capacity`` ids, of which the last may be shorter.
    A null text is an empty one: a document of one id. Null and repeated ids are
    kept as they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_file)
        for batch in lightly(_joined(batches), WordIds):
            texts, keys = text_column(batch.column(1)), batch.column(0).to_pylist()
            for at, to in slices(texts, SLICE):
                ids, ends = words.encode(texts.slice(at, to - at))
                out: list[list] = [[], [], [], [], []]
                pieces = []
                for i in range(to - at):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        piece = own[k : k + capacity]
                        for column, value in zip(out, (keys[at + i], k // capacity, k, len(piece), zlib.crc32(piece.tobytes()))):
                            column.append(value)
                        if with_ids:
                            pieces.append(piece)
                columns = [pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, schema)
