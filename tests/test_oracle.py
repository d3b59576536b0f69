"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

from trialframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_the_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda rs, cols: sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in rs), key=str)
    assert rows(got.collect(), got.columns) == rows(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
