"""The text operators' queries give the rows of their SQL; what lies around them."""

import types

import duckdb
import pytest

from trialframe.llm import queries, store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_the_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = c.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in result.description)
    at = [[d[0] for d in result.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == want


def test_a_cluster_needs_a_shared_folder():
    def session(master, at=None):
        conf = types.SimpleNamespace(get=lambda *_: at, set=lambda *_: None)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        store.shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError):
        store.shared_dir(session("local-cluster[2,1,1024]"))
    assert store.shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert store.shared_dir(session("local[4]")).startswith("file:///")


def test_saved_tables_can_be_deleted(spark):
    import os

    one, two = store.save(spark.range(3), "one"), store.save(spark.range(4), "two")
    store.forget(one)
    at = two._saved_at.removeprefix("file://")
    assert not os.path.exists(one._saved_at.removeprefix("file://")) and two.count() == 4
    store.forget_all()
    assert not os.path.exists(at) and not store._saved


def test_unused_names():
    assert store.unused(["a", "_A", "n"], "a", "n", "x", "a") == ["__a", "_n", "x", "___a"]
