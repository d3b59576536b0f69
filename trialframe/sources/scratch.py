"""Folders for files that a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; a session on one machine may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='trialframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def forget_all(spark: SparkSession) -> None:
    """Deletes everything that ``scratch`` and ``saved`` have named; for the end of a job, as results read some of it until they are written."""
    for path in _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _made.clear()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for what is needed more than once: the plan before it is not run again."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def name_files(spark: SparkSession, root: str, pattern: str, target: str, name) -> None:
    """Moves the files under ``root`` that match ``pattern`` to ``target``, each to ``name(path)``, with a number where that is taken; few a partition."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(target))
    for found in fs.globStatus(path(f"{root}/{pattern}")):
        at = found.getPath()
        to = path(f"{target}/{name(at.toString())}")
        fs.mkdirs(to.getParent())
        stem, dot, ending = to.toString().rpartition(".")
        k = 0
        while fs.exists(to):
            k += 1
            to = path(f"{stem}-{k}{dot}{ending}")
        fs.rename(at, to)
