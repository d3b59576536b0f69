"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes the usual disguises: compatibility forms, letters of other
alphabets that look Latin, digits and signs that stand for letters. The lexicon is
learned from labels: whole words, and long beginnings of words where most that
begins so is toxic, whatever follows. Words and phrases around an entry that are
mostly seen in clean documents are exceptions. Matches are normalised by the
text's length and calibrated to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.fit import fit_logistic, predict
from trialframe.llm.store import bounded_batches, forget, lightly, save
from trialframe.llm.words import text_column

#: Letters of other alphabets and the Latin letters they look like.
_LOOK_ALIKE = ("абвгеёікмнопрстухцјѕԁһвαβεηικνορτυχγωѵո", "a6breeikmhonpctyxujsdhbabenikvoptuxyvvn")
#: Digits and signs written for letters; l, i and 1 become one letter.
_STANDS_FOR = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
_FOLD = {ord(a): b for a, b in zip(*_LOOK_ALIKE)} | {ord(a): b for a, b in _STANDS_FOR.items()}
_SIGN = re.compile(r"(?<=[^\W\d_])[$!|](?=[^\W\d_])")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BREAK = re.compile(r"[\W\d_]+")

_PLAIN = {i: " " for i in range(128) if not chr(i).isalpha()} | {k: v for k, v in _FOLD.items() if k < 128}

#: Labelled rows that are used to learn at most; taken by the hash of their id.
FIT_ROWS = 20_000
#: A document uses a term that makes up this share of its words.
SHARE = 0.005
#: Toxic documents that must use a lexicon entry, and how many times likelier its use must be there.
LEAST_DOCS, LEAST_RATIO = 3, 12.0
#: Letters of a beginning of a word, at least and at most.
BEGINNING = 5, 9
#: Terms that one task counts at once.
HELD_TERMS = 200_000
_WIDTH = 5  # features


def fold(text: str) -> str:
    """Folded words with single spaces between and around them."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: "s" if m[0] == "$" else "i", text)
    if text.isascii():
        return f" {' '.join(text.translate(_PLAIN).split())} "
    return f" {_BREAK.sub(' ', text.translate(_FOLD)).strip()} "


def _used_terms(folded: str) -> list[str]:
    """Words (with both spaces) and beginnings (with the space before) that make up SHARE of the text's words."""
    counts = Counter(folded.split())
    least = SHARE * sum(counts.values())
    terms: Counter[str] = Counter()
    for w, n in counts.items():
        terms[f" {w} "] += n
        for k in range(BEGINNING[0], min(BEGINNING[1], len(w)) + 1):
            terms[f" {w[:k]}"] += n
    return [t for t, n in terms.items() if n >= least]


@dataclass
class Lexicon:
    """Entries with weights, exceptions, and a calibration."""

    weights: dict[str, float]
    exceptions: set[str]
    model: tuple | None = None
    _machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "model": self.model, "_machine": None}

    def machine(self):
        if self._machine is None:
            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                if phrase not in self.weights:
                    made.add_word(phrase, (len(phrase), None))
            made.make_automaton()
            self._machine = made if len(made) else ()
        return self._machine

    def matches(self, folded: str) -> dict[int, float]:
        """Weights by the place where a match begins; matches inside an exception are left out."""
        machine = self.machine()
        if not machine:
            return {}
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if spared and found:
            found = {at: w for at, w in found.items() if not any(a <= at < b for a, b in spared)}
        return found

    def features(self, text: str) -> list[float]:
        """Whether anything matches, the share of words that do, their mean weight, their number, their weight in all."""
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return [0.0] * _WIDTH
        words, hits, total = max(1, folded.count(" ") - 1), len(found), sum(found.values())
        return [1.0, math.log(max(100 * hits / words, 0.01)), total / hits, math.log1p(hits), min(total, 6.0)]

    def surroundings(self, text: str) -> set[str]:
        """Each matched word, and it with the word before and the word after."""
        folded = fold(text)
        out = set()
        for at in self.matches(folded):
            end = folded.index(" ", at + 1)
            out.add(folded[at : end + 1])
            if end + 1 < len(folded):
                out.add(folded[at : folded.index(" ", end + 1) + 1])
            if at:
                out.add(folded[folded.rindex(" ", 0, at) : end + 1])
        return out


def _sample(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """At most FIT_ROWS labelled ids outside the held-out third, by hash; an id with several labels has their rounded mean."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    return one.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(_y, text) of the sample, one row an id; of a repeated id the text of the smallest hash."""
    sample = F.broadcast(_sample(labels, doc_id, label))  # FIT_ROWS rows at most
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(sample, "_id")
    return rows.groupBy("_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("_y", "text")


def held_out(doc_id):
    """Whether the crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def choose_entries(best: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of the entries to keep of (term, toxic documents, log ratio), the best supported first.

    A term adds nothing after its own beginning. A beginning is too wide after
    terms that account for much of its toxic documents with a larger ratio.
    """
    weights: dict[str, float] = {}
    covered: Counter[str] = Counter()
    for term, docs, ratio in best:
        begins = [term[:k] for k in range(1 + BEGINNING[0], len(term))]
        if any(b in weights for b in begins) or (not term.endswith(" ") and covered[term] >= 0.3 * docs):
            continue
        weights[term] = min(8.0, ratio)
        for b in begins:
            covered[b] += docs
    return weights


def _counted(rows: DataFrame, terms) -> DataFrame:
    """(term, a, b): toxic and clean documents of ``rows(y, text)`` for each of a document's ``terms``; the empty term counts them all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def flush():
            for y, own in enumerate(seen):
                yield pa.record_batch([pa.array(list(own), pa.string()), pa.array([y] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["term", "y", "n"])
                own.clear()

        for batch in lightly(batches):
            for y, t in zip(batch.column(0).to_pylist(), text_column(batch.column(1)).to_pylist()):
                seen[y].update(terms(t))
                seen[y][""] += 1
                if len(seen[0]) + len(seen[1]) > HELD_TERMS:
                    yield from flush()
        yield from flush()

    a, b = (F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)) for y in (1, 0))
    return rows.mapInArrow(count, "term string, y int, n long").groupBy("term").agg(a.alias("a"), b.alias("b"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Entries that far more toxic than clean documents use, over whole texts of the labelled rows.

    A term is kept if its likelihood ratio exceeds the number of terms tried, so
    that chance leaves about one at most. ``exceptions`` are phrases that are
    spared whatever the labels say. Without usable labels the lexicon is empty and
    every score the base rate.
    """
    rows = save(labelled(docs, labels, doc_id, text, label), "labelled")
    counted = save(_counted(rows, lambda t: _used_terms(fold(t))), "terms")
    totals = counted.where("term = ''").first()
    toxic, clean = (totals["a"], totals["b"]) if totals else (0, 0)
    a, b = F.col("a"), F.col("b")
    tried = counted.where((F.col("term") != "") & (a >= LEAST_DOCS))
    share = (toxic + 0.5) / (toxic + clean + 1)
    surprise = a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    ratio = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
    best = tried.where((ratio >= LEAST_RATIO) & (surprise >= math.log(max(2, tried.count())))).select("term", "a", F.log(ratio).alias("w")).collect()  # terms of FIT_ROWS rows
    best.sort(key=lambda r: (-r["a"] * r["w"], -len(r["term"]), r["term"]))
    spared = {fold(p) for p in exceptions}
    found = Lexicon(choose_entries([(r["term"], int(r["a"]), float(r["w"])) for r in best]), spared)
    if found.weights:
        first = docs.sparkSession.sparkContext.broadcast(found)
        around = _counted(rows, lambda t: first.value.surroundings(t))
        harmless = around.where((F.col("term") != "") & (b >= 2) & (a * (clean + 1.0) <= b * (toxic + 1.0))).collect()  # of FIT_ROWS rows
        found = Lexicon(found.weights, spared | {r["term"] for r in harmless} - set(found.weights))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t) for t in text_column(batch.column(1)).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(0)], ["x", "y"])

    got = rows.mapInArrow(measure, "x array<double>, y int").toPandas()  # FIT_ROWS rows at most
    for done in (counted, rows):
        forget(done)
    x = np.stack(got["x"].to_numpy()) if len(got) else np.empty((0, _WIDTH))
    found.model = fit_logistic(x, got["y"].to_numpy(np.float64) if len(got) else np.empty(0))
    return found


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1; null and empty texts get the score of a text without matches.

    A column of that name is replaced; all others are kept as they are. Texts of any
    length are read whole; ties, repeated rows and null ids are scored like others;
    no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    docs = docs.drop(score)
    names = docs.columns
    at = [n.lower() for n in names].index(text.lower())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in lightly(batches):
            x = np.array([held.features(t) for t in text_column(batch.column(at)).to_pylist()]).reshape(-1, _WIDTH)
            yield pa.record_batch([*batch.columns, pa.array(predict(held.model, x))], [*names, score])

    return docs.mapInArrow(measure, docs.withColumn(score, F.lit(0.0)).schema)
