"""Licence scans with a positional rare-token index.

The index holds, for each known licence text, its mandatory phrases and the
rarest word of each with its place. A file's places of these words are looked up,
all of them, and the phrases verified around them. Every word of the template
votes for each place that has the mandatory phrases around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches
from trialframe.llm.words import hash_words, slices, text_column

#: Phrases whose every place is counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licences; label, notice, mandatory phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
)

#: Words around a place in which a mandatory phrase may stand, beyond the template's own length.
SLACK = 12

_TABLE = np.full(256, 32, np.uint8)
_TABLE[48:58] = np.arange(48, 58)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def licence_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, each row's offsets): runs of a-z, 0-9 and letters beyond ASCII, A-Z lower-cased."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_TABLE[data]))
    lists = pc.ascii_split_whitespace(plain)
    flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    at -= at[0]
    full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    if not full.all():
        flat, at = flat.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[at]
    return hash_words(flat), at


def _hash(phrase: str) -> np.ndarray:
    return licence_words(pa.array([phrase], pa.large_string()))[0]


class Index:
    """Templates with their mandatory phrases, and the rarest word of each phrase by inverse document frequency among the templates."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [(_hash(p), label) for p, label in phrases.items()]
        texts = [_hash(text) for _, text, _ in templates]
        holders: dict[int, int] = {}
        for words in texts:
            for w in set(words.tolist()):
                holders[w] = holders.get(w, 0) + 1
        idf = {w: float(np.log((1 + len(texts)) / n)) for w, n in holders.items()}

        def key(phrase: str) -> tuple[np.ndarray, np.uint64, int]:
            words = _hash(phrase)
            at = max(range(len(words)), key=lambda i: idf.get(int(words[i]), np.inf))
            return words, words[at], at

        #: label, words, and of each mandatory phrase: words, rarest word, its place in the phrase
        self.templates = [(label, words, [key(p) for p in keys]) for (label, _, keys), words in zip(templates, texts)]
        #: looked up first: the rarest word of every first phrase; without one of them no template can match
        self.anchors = np.unique(np.array([k[1] for _, _, keys in self.templates for k in keys[:1]], np.uint64))
        self.known = np.unique(np.array([k[1] for _, _, keys in self.templates for k in keys], np.uint64))

    def scan(self, words: np.ndarray) -> dict[str, float]:
        """Labels of the templates found among a file's words, with the share of the template's words that stand in place."""
        found: dict[str, float] = {}
        k = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        at = np.flatnonzero(self.known[k] == words)
        own = words[at]
        for label, template, keys in self.templates:
            size = len(template)
            # shifts (file place less template place) from -size to len(words), with every phrase around them
            fits = np.ones(len(words) + size + 1, bool)
            for phrase, rarest, inside in keys:
                start = at[own == rarest] - inside
                start = start[(start >= 0) & (start + len(phrase) <= len(words))]
                for i, w in enumerate(phrase):
                    start = start[words[start + i] == w]
                if not len(start):
                    break
                low, high = np.maximum(start + len(phrase) - SLACK, 0), np.minimum(start + SLACK + size + 1, len(fits))
                fits &= np.cumsum(np.bincount(low, minlength=len(fits) + 1) - np.bincount(high, minlength=len(fits) + 1))[:-1] > 0
            else:
                shift = np.flatnonzero(fits) - size
                votes = np.zeros(len(shift), np.int64)
                for i, w in enumerate(template):
                    place = shift + i
                    inside = (place >= 0) & (place < len(words))
                    votes[inside] += words[place[inside]] == w
                best = int(votes.max(initial=0))
                if best >= min(2, size):
                    found[label] = max(found.get(label, 0.0), best / size)
        return found


def occurrences(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand one after another."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = words[:n] == phrase[0]
    for k in range(1, len(phrase)):
        hit = hit & (words[k : k + n] == phrase[k])
    return np.flatnonzero(hit)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    The base counts all places of ``phrases``; first_word and last_word are the
    smallest and largest start among them, null without any. ``labels`` adds what
    the index finds. ``score`` is the largest share of a found template, at least
    a half where a base phrase stands, else 0. Null and empty texts have no words,
    very long ones are scanned whole. Every row is scanned for itself, so repeated rows
    and null ids give rows of their own; labels that tie are all given. Other columns
    take no part, whatever their names, and no rows give none.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, phrases))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, keys = text_column(batch.column(1)), batch.column(0)
            for at, to in slices(texts):
                words, ends = licence_words(texts.slice(at, to - at))
                rows = to - at
                places: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in index.phrases:
                    start = occurrences(words, phrase)
                    row = np.searchsorted(ends, start, "right") - 1
                    inside = start + len(phrase) <= ends[row + 1] if len(row) else np.empty(0, bool)
                    for r, s in zip(row[inside].tolist(), start[inside].tolist()):
                        places.setdefault(r, []).append((s - int(ends[r]), label))
                k = np.minimum(np.searchsorted(index.anchors, words), len(index.anchors) - 1)
                likely = set((np.searchsorted(ends, np.flatnonzero(index.anchors[k] == words), "right") - 1).tolist())
                more = {r: index.scan(words[ends[r] : ends[r + 1]]) for r in likely}
                base = [sorted({label for _, label in places.get(r, ())}) for r in range(rows)]
                columns = [
                    keys.slice(at, rows),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([len(places.get(r, ())) for r in range(rows)], pa.int64()),
                    pa.array([min((s for s, _ in places[r])) if r in places else None for r in range(rows)], pa.int64()),
                    pa.array([max((s for s, _ in places[r])) if r in places else None for r in range(rows)], pa.int64()),
                    pa.array([",".join(b) for b in base], pa.string()),
                    pa.array([",".join(sorted({*b, *more.get(r, ())})) for r, b in enumerate(base)], pa.string()),
                    pa.array([max([0.0, *([0.5] if b else []), *more.get(r, {}).values()]) for r, b in enumerate(base)], pa.float64()),
                ]
                yield pa.record_batch(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
