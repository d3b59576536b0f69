"""Quality by hierarchical empirical Bayes.

A classifier gives each document evidence; grouped aggregation gives each host
and each path within a host a posterior mean, shrunk towards the level above as
much as the spread between the groups of that level says. A document's score
combines its own evidence with what the other documents of its path say: its own
is taken out of its site's sums, so that it counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.fit import fit_logistic, predict
from trialframe.llm.store import bounded_batches, lightly, save, small, unused
from trialframe.llm.toxicity import labelled
from trialframe.llm.words import hash_words, slices, split_words, text_column

#: Host and path rows that may be broadcast.
BROADCAST_SITES = 200_000
_NAMES = ("upper", "digit", "mark", "bang", "bar", "high", "words", "length", "distinct", "longest", "lines")
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((range(65, 91), range(48, 58), b"#$%&*@^~<>{}[]\\_=+", b"!?", b"|", range(128, 256)), 1):
    _KINDS[list(_bytes)] = _kind


def text_features(texts: pa.LargeStringArray) -> np.ndarray:
    """One row of shares, counts and ratios for each text; the numbers say how text is made, not what it is about."""
    out = []
    for at, to in slices(texts):
        part = texts.slice(at, to - at)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        size = np.maximum(np.diff(ends), 1)
        kinds = _KINDS[data]
        share = [np.diff(np.concatenate(([0], np.cumsum(kinds == k)))[ends]) / size for k in range(1, 7)]
        lines = 1 + np.diff(np.concatenate(([0], np.cumsum(data == 10)))[ends])
        words, own = split_words(part)
        h, n = hash_words(words), np.diff(own)
        distinct, longest = np.ones(len(n)), np.zeros(len(n))
        for i, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist())):
            if b > a:
                _, c = np.unique(h[a:b], return_counts=True)
                distinct[i], longest[i] = len(c) / (b - a) ** 0.8, c.max() / (b - a)
        out.append(np.column_stack((*share, np.log1p(n), np.diff(ends) / np.maximum(n, 1), distinct, longest, n / lines)))
    x = np.concatenate(out) if out else np.empty((0, len(_NAMES)))
    return np.column_stack((x, np.minimum(x[:, 7], 40) ** 2, np.log1p(x[:, 7]), np.log1p(x[:, 10])))


def learn_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality"):
    """The classifier, fitted on at most ``toxicity.FIT_ROWS`` labelled rows; without labels it gives one half."""
    rows = labelled(docs, labels, doc_id, text, label)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(list(text_features(text_column(batch.column(1)))), pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(measure, "y int, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.empty((0, len(_NAMES) + 3))
    return fit_logistic(x, got["y"].to_numpy(np.float64) if len(got) else np.empty(0))


def with_evidence(docs: DataFrame, model, text: str = "text", evidence: str = "evidence", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with the classifier's probability of good quality."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep if keep is not None else docs.columns)
    out = docs.select(*names).withColumn(evidence, F.lit(0.0)).schema
    rows = docs.select(*[F.col(c) for c in names], F.col(text).alias(unused([*names, evidence], "text")[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lightly(batches):
            yield pa.record_batch([*batch.columns[:-1], pa.array(predict(shared.value, text_features(text_column(batch.columns[-1]))))], [*names, evidence])

    return rows.mapInArrow(measure, out)


def _strength(level: DataFrame) -> float:
    """How many documents the level above counts as, by the method of moments over ``level(n, s, q, above)``: number, sum and sum of squares of evidence.

    The spread of the groups' means beyond what the variance within them explains
    is the spread between groups; no such spread gives a strong prior.
    """
    mean = F.col("s") / F.col("n")
    row = level.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(mean - F.col("above"), 2)).alias("between"),
        F.sum(F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0))).alias("within"),
        F.count("*").alias("groups"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 100.0
    within = max(row["within"] / max(row["n"] - row["groups"], 1), 1e-6)
    spread = max(0.0, (row["between"] - row["groups"] * within) / row["n"])
    return float(min(1e4, max(2.0, within / max(spread, 1e-9))))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, host_n, host_s) of ``evidence(host, path, p)``, the global mean, and the strengths of the prior over hosts and of a host over its paths."""
    p = F.col("p")
    paths = save(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "paths")
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    prior = (total[0] + 0.5) / (total[1] + 1) if total[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    over_hosts = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.col("host_q").alias("q"), F.lit(prior).alias("above")))
    hosts = hosts.withColumnRenamed("host", "_h")
    both = paths.join(F.broadcast(hosts) if small(hosts, BROADCAST_SITES) else hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h", "host_q")
    posterior = (F.col("host_s") + over_hosts * prior) / (F.col("host_n") + over_hosts)
    over_paths = _strength(both.select("n", "s", "q", posterior.alias("above")))
    return both.drop("q"), prior, over_hosts, over_paths


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", keep: tuple[str, ...] | None = None, names: tuple[str, str, str, str] = ("evidence", "host_posterior", "path_posterior", "quality_score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with the four of ``names``, each from 0 to 1.

    ``host`` and ``path`` name the columns of a document's site and of its part of
    the site; nulls are a site of their own. The posteriors are what the site says
    without the document itself: an only document has those of the level above.
    Null and empty texts are scored as empty ones, very long ones whole; repeated
    rows and repeated or null ids are rows like others. Columns of the four names
    are replaced, all others of ``keep`` stay; every row is kept, and no rows give
    none. Texts are scored once and written with the kept columns to the shared
    folder.
    """
    evidence, host_posterior, path_posterior, score = names
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    own, site = unused([*docs.columns, *names], "host", "path"), unused([*docs.columns, *names], "site_host", "site_path", "n", "s", "host_n", "host_s")
    model = learn_quality(docs, labels, doc_id, text, label)
    rows = docs.select("*", F.col(host).alias(own[0]), F.col(path).alias(own[1]))
    scored = save(with_evidence(rows, model, text, evidence, (*kept, *own)), "evidence")
    sums, prior, over_hosts, over_paths = site_sums(scored.select(F.col(own[0]).alias("host"), F.col(own[1]).alias("path"), F.col(evidence).alias("p")))
    sums = save(sums.select(*[F.col(c).alias(n) for c, n in zip(("host", "path", "n", "s", "host_n", "host_s"), site)]), "sites")
    if small(sums, BROADCAST_SITES):
        sums = F.broadcast(sums)
    scored = scored.join(sums, F.col(site[0]).eqNullSafe(F.col(own[0])) & F.col(site[1]).eqNullSafe(F.col(own[1])), "left")
    n, s, host_n, host_s = (F.col(c) for c in site[2:])
    p = F.col(evidence)
    of_host = (host_s - p + over_hosts * prior) / (host_n - 1 + over_hosts)
    of_path = (s - p + over_paths * F.col(host_posterior)) / (n - 1 + over_paths)

    def logit(x):
        x = F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(x / (1 - x))

    out = scored.withColumn(host_posterior, of_host).withColumn(path_posterior, of_path)
    total = logit(p) + logit(F.col(path_posterior)) - logit(F.lit(prior))
    return out.withColumn(score, 1 / (1 + F.exp(-total))).select(*kept, *names)
