"""The corpus pipeline: stages over the documents table, each on all that its predecessor kept.

All stages but the last return the columns of documents; the last returns the
packed pieces of what is left. No stage replaces a column of its input, whatever
its name, and all of them give no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.decontaminate import decontaminate
from trialframe.llm.ngram_join import BROADCAST_IDS, ngram_jaccard_join
from trialframe.llm.packing import pack_documents
from trialframe.llm.quality import quality_scores
from trialframe.llm.queries import GOOD, TOXIC, tokenizer_file
from trialframe.llm.store import forget, save, small, unused
from trialframe.llm.toxicity import learn_lexicon, toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the lexicon is learned from the labels of those given.

    Null and empty texts score as texts without a match and stay unless the base
    rate alone is above the threshold; very long texts are read whole. Rows are
    judged one by one: repeated rows, ties and repeated or null ids go or stay
    together with their text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused(docs.columns, "toxicity")[0]
    return toxicity_scores(docs, learn_lexicon(docs, labels), score=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality; source is the site, lang its path.

    Null and empty texts are scored as empty ones, very long ones whole; a null
    source or lang is a site of its own. Rows are judged one by one: a score of
    exactly the threshold stays, repeated rows count as documents of their site.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = unused(docs.columns, "evidence", "host_posterior", "path_posterior", "quality_score")
    return quality_scores(docs, labels, names=tuple(names)).where(F.col(names[3]) >= GOOD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near copies (five words, 0.8).

    Texts without words (null, empty, white space) are copies of nothing and stay,
    as do documents of null id; very long texts are compared whole. Where ids
    repeat, rows count, not ids: of the rows of the smallest id in a component one
    stays, of equal rows the first in the order of their other columns, and a row
    of the same id with another text is untouched.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _drop_near_copies_of_rows(docs)
    found = ngram_jaccard_join(docs.select("doc_id", "text"), width=5, percent=80)
    gone = save(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    if small(gone, BROADCAST_IDS):
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _drop_near_copies_of_rows(docs: DataFrame) -> DataFrame:
    """The same for ids that repeat: id and text make a row's key; of the smallest id of a component the smallest key stays."""
    key, rest = unused(docs.columns, "key", "rest")
    rows = docs.where("doc_id is not null").withColumn(key, F.xxhash64("doc_id", "text"))
    found = ngram_jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80)
    found = found.select(F.col("doc_id").alias(key), F.col("component_id").alias("component")).distinct().join(rows.select(key, "doc_id").distinct(), key)
    stay = save(found.groupBy("component").agg(F.min(F.struct("doc_id", key)).alias("row")).select(F.col("row")[key].alias(key)), "first-copies")
    if small(stay, BROADCAST_IDS):
        stay = F.broadcast(stay)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = rows.join(stay, key, "left_semi").groupBy(key, "doc_id").agg(F.first("text").alias("text"), F.min(F.struct(F.lit(0).alias(key), *others)).alias(rest))
    one = one.select("doc_id", "text", *[F.col(rest)[c].alias(c) for c in others])
    return docs.where("doc_id is null").unionByName(one.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts have none and stay; very long texts are read whole. Rows
    are judged one by one by their text: ties, repeated rows and repeated or null
    ids change nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its place in a sequence of 2048 tokens.

    A null or empty text is a document of the end mark alone; a longer one than a
    sequence is cut into pieces. Repeated rows and rows of repeated or null id are
    packed each for itself; pieces that tie may change places.
    """
    return pack_documents(docs, tokenizer_file(), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: Fitted scores, connected components and a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
