"""Word and shingle hashing over Arrow batches.

Texts stay in Arrow buffers: Arrow's kernels split and lower-case the words,
and everything after that is numpy on whole slices of some megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes that are hashed at once; some ten numbers of eight bytes are held for each.
HASH_BYTES = 1 << 19

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64, kept for slices of the usual size."""
    if _kept and len(_kept[0]) >= n:
        return _kept[0][:n], _kept[1][:n]
    size = max(n, HASH_BYTES + 1)
    made = []
    with np.errstate(over="ignore"):
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
    if n <= HASH_BYTES + 1:
        _kept[:] = made
    return made[0][:n], made[1][:n]


def text_column(column) -> pa.LargeStringArray:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to


def split_words(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, and each row's offsets among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets -= offsets[0]
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return flat, offsets


def hash_words(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes: differences of a running polynomial over the bytes, then mixed with the length."""
    out = np.empty(len(words), np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + HASH_BYTES, "right")) - 1)
            low, e = ends[at], ends[at : to + 1] - ends[at]
            up, down = _powers(int(e[-1]))
            run = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum((data[low : low + e[-1]].astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
            run = run[e]
            size = np.diff(e)
            start = np.minimum(e[:-1], max(0, int(e[-1]) - 1))
            out[at:to] = mix((run[1:] - run[:-1]) * (down[start] if len(down) else np.uint64(0)) + size.astype(np.uint64) * _STEP)
            at = to
    return out


def word_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, each row's offsets among them)."""
    words, offsets = split_words(texts)
    return hash_words(words), offsets


def shingle_sets(texts: pa.LargeStringArray, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes.

    A row with fewer words than ``width`` has its whole sequence as its one
    shingle; a row without words has none.
    """
    for at, to in slices(texts):
        h, offsets = word_hashes(texts.slice(at, to - at))
        rolled = h.copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                rolled[:-k or None] = mix(rolled[:-k or None] * _STEP + np.uint64(k)) + h[k:] if len(h) > k else rolled[:-k or None]
            rolled = mix(rolled)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if b - a >= width:
                    yield np.unique(rolled[a : b - width + 1])
                elif b > a:
                    one = np.uint64(b - a)
                    for x in h[a:b]:
                        one = mix(one * _STEP + x)
                    yield np.asarray([one], np.uint64)
                else:
                    yield np.empty(0, np.uint64)
