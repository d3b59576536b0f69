"""Tables written between the jobs of one operator.

They go to the folder that the session names in ``spark.checkpoint.dir``, which
driver and executors share. A session on one machine (master ``local``) that names
none gets a folder for temporary files; on a cluster that is an error.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_saved: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='trialframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of some megabytes at most, so that neither side of a task holds much of its input.

    Set for the session, as plans are made when results are asked for.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _saved.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes a saved table that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _saved[:] = [x for x in _saved if x is not df]


def forget_all() -> None:
    """Deletes every table still saved; for the end of a job, when no result is read any more."""
    for df in list(_saved):
        forget(df)


def unused(columns, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def lightly(batches: Iterable, keep: type | None = None) -> Iterator:
    """``batches``, one after another, for a task that is to hold no more memory than it needs.

    A Python worker serves one stage after another: before the first batch, a
    tokenizer's table that earlier stages have left goes, unless it is that of
    ``keep``. Before the first and after each, memory that is free but held returns
    to the machine.
    """
    import pyarrow as pa

    tokens = sys.modules.get("trialframe.llm.tokens")
    if tokens is not None and keep is not tokens.WordIds:
        tokens.WordIds._open.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)

    give_back()
    for batch in batches:
        yield batch
        del batch
        give_back()
